"""Personal data: patterns propose, checksums confirm, words nearby move the score. DataFrame and SQL
functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need


@dataclass(frozen=True)
class Kind:
    """``pattern`` must match like the plain form in ``plain``; possessive quantifiers and the looks
    behind only spare the engine from trying again what cannot match. ``hint`` is text without which there is no match."""

    name: str
    plain: str
    pattern: str
    hint: str
    score: float
    words: tuple[str, ...] = field(default=())


# The base kinds' patterns, and words that make a kind likelier.
KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@", 0.9, ("mail", "contact", "write")),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, ("ip", "host", "server", "address")),
    Kind("card", r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]", 0.8, ("card", "visa", "credit", "payment")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, ("phone", "call", "tel", "mobile")),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.9, ("iban", "bank", "account", "transfer")),
)
BASE = ("email", "ip", "card", "phone")
#: Characters before a match that are looked at, and the gaps and matches that surely hold as many.
NEAR, PIECES = 40, 20
SPAN = "struct<kind: string, start: bigint, end: bigint, score: double, text: string>"

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def luhn(match: str) -> str:
    """SQL: the digits of ``match`` pass Luhn's checksum."""
    digits = f"reverse(regexp_replace({match}, '[^0-9]', ''))"
    return f"""(aggregate(transform(split({digits}, ''), (d, i) -> if(i % 2 = 1, cast(d as int) * 2 - if(cast(d as int) > 4, 9, 0), cast(d as int))), 0, (a, d) -> a + coalesce(d, 0)) % 10 = 0)"""


def mod97(match: str) -> str:
    """SQL: the letters and digits of ``match``, its first four moved behind, are 1 modulo 97."""
    plain = f"replace({match}, ' ', '')"
    turned = f"concat(substring({plain}, 5), substring({plain}, 1, 4))"
    return f"""(aggregate(split({turned}, ''), 0, (a, c) -> if(c = '', a, if(c >= 'A', (a * 100 + ascii(c) - 55) % 97, (a * 10 + cast(c as int)) % 97))) = 1)"""


def _confirmed(kind: str, m: str) -> str:
    count = f"length(regexp_replace({m}, '[^0-9]', ''))"
    return {
        "email": "true",
        "ip": f"{m} rlike r'^{_PART}([.]{_PART}){{3}}$'",
        "card": f"({count} BETWEEN 16 AND 19 AND {luhn(m)})",
        "phone": f"{count} BETWEEN 8 AND 15",
        "iban": mod97(m),
    }[kind]


def _spans(kind: Kind) -> Column:
    """Confirmed matches as array of (kind, start, end, score, text).

    Matches and the gaps before them are listed alike. Where each ends is a running sum, made by
    adding what stands 1, 2, 4, ... places before: n log n steps for n matches, and no array grows
    step by step. What stands before a match is taken from the last few gaps and matches."""
    p = kind.pattern.replace("'", "\\'")
    words = "|".join(kind.words)
    before = f"right(concat(array_join(slice(z.tails, greatest(i - {PIECES}, 0) + 1, least(i, {PIECES})), ''), x.gap), {NEAR})"
    near = f"if({before} rlike '(?i){words}', {1 - kind.score:.2f} / 2, 0.0)"
    found = f"""
      CASE WHEN text rlike r'{kind.hint}' THEN
        transform(
          transform(
            transform(array(arrays_zip(split(text, r'{p}', -1), regexp_extract_all(text, r'{p}', 0))), l -> transform(l, y -> named_struct('gap', y.`0`, 'hit', y.`1`))),
            l -> named_struct(
              'pieces', l,
              'tails', transform(l, x -> right(concat(x.gap, coalesce(x.hit, '')), {NEAR})),
              'ends', aggregate(sequence(0, cast(ceil(log2(size(l))) as int)), transform(l, x -> cast(length(x.gap) + coalesce(length(x.hit), 0) as bigint)),
                (a, k) -> transform(a, (x, i) -> x + coalesce(get(a, i - shiftleft(1, k)), 0L))))),
          z -> filter(
            transform(z.pieces, (x, i) -> if(x.hit IS NOT NULL AND {_confirmed(kind.name, "x.hit")},
              named_struct('kind', '{kind.name}', 'start', z.ends[i] - length(x.hit), 'end', z.ends[i], 'score', cast({kind.score} + {near} as double), 'text', x.hit),
              cast(null as {SPAN}))),
            s -> s IS NOT NULL))[0]
      ELSE cast(array() as array<{SPAN}>) END"""
    return F.expr(found)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in every text.

    Base kinds email, ip, card and phone: leftmost matches that don't overlap, dropped unless their
    check holds (parts up to 255; 16 to 19 digits passing Luhn; 8 to 15 digits). One kind is added:
    iban, confirmed by its remainder modulo 97. A span's score is its kind's, raised halfway to 1 if
    a word that goes with the kind stands within 40 characters before it; no span is dropped for its score.

    Returns id (named ``id_col``) and ``spans``: array of (kind, start, end, score, text), kinds in
    the order above, then by start; positions are code points, the end is exclusive. Null and empty
    texts have no spans; null ids and repeated rows are rows like any other. Other columns are not read.
    """
    need(docs, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", *(_spans(k).alias(k.name) for k in KINDS))
    return rows.select(F.col("id").alias(id_col), F.concat(*(F.col(k.name) for k in KINDS)).alias("spans"))


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, digest of their spans, all spans as text and the highest score."""
    found = find_pii(docs, id_col, text_col)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("max_score"))
