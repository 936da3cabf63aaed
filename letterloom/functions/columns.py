"""Functions on columns: built-in expressions where Spark has them, else Arrow-batched Python."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.message import header_fields, parse_header_block, parse_message, parse_parts, unflow
from . import addresses, charset, dates, html, render, transfer, words
from .jstext import WS
from .schemas import ADDRESSES, HEADER_FIELDS, MESSAGE, PARTS, STRUCTURED

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _kept_null(f: Callable) -> Callable:
    return lambda x, *more: None if x is None else f(x, *more)


def _structured(text: str) -> dict:
    value, params = words.parse_structured(text)
    return {"value": value, "params": params}


def _decode_bytes(data: bytes, label: str | None) -> str:
    return charset.decode_charset(bytes(data), label)


#: Functions in Python by their SQL name: (function, type of the result).
PYTHON = {
    "decode_words": (words.decode_words, "string"),
    "decode_word": (lambda text, label, encoding: words.decode_word(label, encoding, text), "string"),
    "is_encoded_words_only": (words.is_encoded_words_only, "boolean"),
    "decode_percent": (words.decode_percent, "string"),
    "strip_comments": (words.strip_comments, "string"),
    "parse_structured_header": (_structured, STRUCTURED),
    "parse_addresses": (addresses.parse_addresses, ADDRESSES),
    "find_address": (lambda t: (lambda at: t[at[0] : at[1]] if at else None)(addresses.find_address(t)), "string"),
    "decode_charset": (_decode_bytes, "string"),
    "decode_base64_lenient": (transfer.decode_base64_lenient, "binary"),
    "decode_qp": (transfer.decode_qp, "binary"),
    "decode_base64_body": (lambda t: transfer.base64_body(transfer.split_lines(t.encode())), "binary"),
    "html_to_text": (html.html_to_text, "string"),
    "decode_html_entities": (html.decode_html_entities, "string"),
    "unflow": (unflow, "string"),
    "fold_lines": (render.fold_lines, "string"),
    "parse_email_date": (dates.iso_date, "string"),
    "parse_email": (parse_message, f"struct<{MESSAGE}>"),
    "parse_email_headers": (parse_header_block, f"struct<{HEADER_FIELDS}>"),
    "parse_email_parts": (parse_parts, PARTS),
}


#: Bytes of an Arrow batch: a Python worker holds one, and what is made of it.
ARROW_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session by their bytes, as rows may be whole texts; a lower bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = spark.conf.get(key, None)
    if bound is None or not 0 < _bytes(bound) <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def _bytes(text: str) -> int:
    """A size as Spark's settings write it."""
    m = re.fullmatch(r"([0-9]+)([kmgtp]?)b?", text.strip().lower())
    return int(m[1]) << 10 * " kmgtp".index(m[2] or " ") if m else 0


def _udf(name: str) -> Callable[..., Column]:
    function, kind = PYTHON[name]
    return F.udf(_kept_null(function), kind, useArrow=True)


def call(name: str, *args: ColumnLike) -> Column:
    """A Python function by its SQL name; null where its first argument is null."""
    if (spark := SparkSession.getActiveSession()) is not None:
        bound_batches(spark)
    return _udf(name)(*map(_col, args))


def decode_words(c: ColumnLike) -> Column:
    return call("decode_words", c)


def html_to_text(c: ColumnLike) -> Column:
    return call("html_to_text", c)


def decode_html_entities(c: ColumnLike) -> Column:
    return call("decode_html_entities", c)


def parse_structured_header(c: ColumnLike) -> Column:
    return call("parse_structured_header", c)


def parse_email_date(c: ColumnLike) -> Column:
    return call("parse_email_date", c)


def parse_addresses(c: ColumnLike, flatten: bool = False) -> Column:
    found = call("parse_addresses", c)
    return flat_addresses(found) if flatten else found


# ---- built-in expressions ----


def flat_addresses(found: Column) -> Column:
    """Groups replaced by their members."""
    none = F.lit(None).cast("array<struct<name: string, address: string>>")
    member = lambda m: F.struct(m["name"].alias("name"), m["address"].alias("address"), none.alias("group"))
    return F.flatten(F.transform(found, lambda a: F.coalesce(F.transform(a["group"], member), F.array(member(a)))))


def escape_html(c: ColumnLike) -> Column:
    out = F.replace(F.btrim(_col(c), F.lit(WS)), F.lit("&"), F.lit("&#x26;"))
    for ch in "<>\"'?":
        out = F.replace(out, F.lit(ch), F.lit(f"&#x{ord(ch):02X};"))
    # an escape holds none of the characters but & and #, ; and x, so the order is safe
    return out


def text_to_html(c: ColumnLike) -> Column:
    return F.concat(F.lit("<div>"), F.replace(escape_html(c), F.lit("\n"), F.lit("<br />")), F.lit("</div>"))


def base64_text(c: ColumnLike) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(_col(c)), r"[\r\n]", "")


def first_header(headers: ColumnLike, key: str) -> Column:
    """Value of the first header of that name, null if that one is empty or there is none."""
    return F.nullif(F.get(F.filter(_col(headers), lambda h: h["key"] == key), F.lit(0))["value"], F.lit(""))


def all_headers(headers: ColumnLike, key: str) -> Column:
    """Values of all headers of that name that are not empty."""
    return F.transform(F.filter(_col(headers), lambda h: (h["key"] == key) & (h["value"] != "")), lambda h: h["value"])


def text_address(a: Column) -> Column:
    return F.when(a["name"] != "", F.concat(a["name"], F.lit(" <"), a["address"], F.lit(">"))).otherwise(a["address"])


def text_addresses(found: ColumnLike) -> Column:
    """Addresses as one text; a group as name: members;"""
    one = lambda a: F.when(a["group"].isNotNull(), F.concat(a["name"], F.lit(":"), F.array_join(F.transform(a["group"], text_address), ", "), F.lit(";"))).otherwise(text_address(a))
    return F.array_join(F.transform(_col(found), one), ", ")


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Makes the Python functions callable from SQL, and email_parts and email_addresses as table functions."""
    from pyspark.sql.functions import udtf

    for name in PYTHON:
        spark.udf.register(f"{prefix}{name}", _udf(name))

    class EmailParts:
        def eval(self, raw: bytes):  # noqa: ANN202
            for p in parse_parts(raw):
                yield p["node_id"], p["parent_id"], p["depth"], p["mimeType"], p["disposition"], p["content"]

    class EmailAddresses:
        def eval(self, raw: bytes):  # noqa: ANN202
            found = header_fields(parse_header_block(raw)["headers"])
            for role in ("from", "sender", "replyTo", "to", "cc", "bcc"):
                listed = found[role] if isinstance(found[role], list) else [found[role]] if found[role] else []
                for i, a in enumerate(listed):
                    for m in a["group"] if a["group"] is not None else [a]:
                        yield role, i, m["name"], m["address"], a["name"] if a["group"] is not None else None

    spark.udtf.register(f"{prefix}email_parts", udtf(EmailParts, returnType="node_id int, parent_id int, depth int, mimeType string, disposition string, content binary"))
    spark.udtf.register(f"{prefix}email_addresses", udtf(EmailAddresses, returnType="role string, ordinal int, name string, address string, group_name string"))
    return [f"{prefix}{n}" for n in (*PYTHON, "email_parts", "email_addresses")]
