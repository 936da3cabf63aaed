"""Language ID by words first, backing off to ever shorter character n-grams for unseen words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import BYTE_P, U64, Hasher, mix, pieces, rows_of, utf8
from .common import drop_table, is_held_out, need, table
from .sampling import labelled_sample

OPEN, CLOSE = 2, 3
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Log frequencies a language: ``word`` and, longest first, ``gram`` are (sorted hashes, rows of logs)."""

    languages: tuple[str, ...]
    word: tuple[np.ndarray, np.ndarray]
    gram: tuple[tuple[int, np.ndarray, np.ndarray], ...]


def _letter_words(h: Hasher, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters of the lower-cased texts; bytes above 127 count as letters."""
    data, at = utf8(pc.utf8_lower(batch.column("text").cast(pa.large_string())))
    return data, *h.words(data, at)


def _letter_hasher() -> Hasher:
    h = Hasher()
    h.space = np.ones(256, bool)
    h.space[97:123] = h.space[65:91] = h.space[128:] = False
    return h


def _distinct(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, first, inverse = np.unique(value, return_index=True, return_inverse=True)
    return first, inverse


def _marked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes one after another, each between two marks, and their offsets."""
    size = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(size)])
    step = np.arange(at[-1]) - np.repeat(at[:-1], size)
    out = data[np.clip(np.repeat(starts, size) + step - 1, 0, max(len(data) - 1, 0))] if len(data) else np.zeros(at[-1], np.uint8)
    out[at[:-1]], out[at[1:] - 1] = OPEN, CLOSE
    return out, at


def _grams(h: Hasher, leads: np.ndarray, at: np.ndarray, n: int, prefix: np.ndarray, where: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters (of ``where``) at which an n-gram of one word starts, and its hash. ``leads`` has the first byte of
    each character and the end, ``at`` the words' offsets in characters."""
    ok = where[where + n <= at[row[where] + 1]]
    return ok, h.spans(prefix, leads[ok], leads[ok + n], BYTE_P)


def _characters(h: Hasher, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the marked words: first bytes of their characters, the words' offsets in characters, prefix hashes and each character's word."""
    marked, at = _marked(data, starts, ends)
    leads = np.flatnonzero((marked & 0xC0) != 0x80)
    of = np.searchsorted(leads, at)
    return np.append(leads, len(marked)), of, h.prefix(h.of_byte[marked], BYTE_P), rows_of(of)


def _count(longest: int, languages: tuple[str, ...]) -> Callable:
    """Rows (size, value, lang, n): size 0 for words, else for n-grams of that size."""
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = _letter_hasher()
        for whole in batches:
            for batch in pieces(whole, "text"):
                lang = np.array([number[x] for x in batch.column("y").to_pylist()], np.int64)
                data, starts, ends, of = _letter_words(h, batch)
                if not len(starts):
                    continue
                value = h.word_hashes(data, starts, ends)
                of_lang = lang[rows_of(of)]
                first, inverse = _distinct(value + mix(of_lang.astype(U64)))
                times = np.bincount(inverse)
                found = [(0, value[first], of_lang[first], times)]
                leads, at, prefix, row = _characters(h, data, starts[first], ends[first])
                for n in range(1, longest + 1):
                    ok, gram = _grams(h, leads, at, n, prefix, np.arange(len(row)), row)
                    g_lang = of_lang[first][row[ok]]
                    a, b = _distinct(gram + mix(g_lang.astype(U64)))
                    found.append((n, gram[a], g_lang[a], np.bincount(b, times[row[ok]]).astype(np.int64)))
                for size, v, k, c in found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), size, np.int32)), pa.array(v.view(np.int64)), pa.array(k.astype(np.int32)), pa.array(c)], ["size", "value", "lang", "n"])

    return run


def fit_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 20_000, longest: int = 5
) -> LanguageModel:
    """Learns from text and language of at most about ``sample_rows`` rows that are not held out, and of about
    500 rows of each language at least. All words and all n-grams of up to ``longest`` characters of these rows are kept."""
    need(docs, id_col, text_col, lang_col)
    sample = table(labelled_sample(docs.withColumn("__y", F.col(f"`{lang_col}`").cast("string")), None, id_col, text_col, "__y", sample_rows).where("text IS NOT NULL"), "labelled")
    languages = tuple(r[0] for r in sample.select("y").distinct().orderBy("y").collect())
    counts = sample.mapInArrow(_count(longest, languages), "size int, value long, lang int, n long").groupBy("size", "value", "lang").agg(F.sum("n").alias("n"))
    counts = table(counts, "counts")
    # bounded by the sample: about 20,000 rows and 500 for each language
    got = counts.toArrow()
    sums = {(r[0], r[1]): r[2] for r in counts.groupBy("size", "lang").agg(F.sum("n")).collect()}
    drop_table(sample)
    drop_table(counts)
    tables = []
    size, value, lang, n = (got.column(c).to_numpy() for c in ("size", "value", "lang", "n"))
    for s in range(longest + 1):
        mine = size == s
        key, inverse = np.unique(value[mine].view(U64), return_inverse=True)
        logs = np.full((len(key), max(len(languages), 1)), 0.5)
        np.add.at(logs, (inverse, lang[mine]), n[mine])
        whole = np.array([sums.get((s, k), 0) for k in range(len(languages))] or [0.0]) + 0.5 * len(key) + 1
        tables.append((key, np.log(logs / whole)))
    return LanguageModel(languages, tables[0], tuple((s, *tables[s]) for s in range(longest, 0, -1)))


def _look(table_: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table_):
        return np.zeros(len(value), np.int64), np.zeros(len(value), bool)
    at = np.searchsorted(table_, value).clip(0, len(table_) - 1)
    return at, table_[at] == value


def _predict(model: LanguageModel) -> Callable:
    languages, (word_key, word_log), gram = model.languages, model.word, model.gram

    def backoff(h: Hasher, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean log frequencies of each word over its positions, each by the longest n-gram known there."""
        leads, at, prefix, row = _characters(h, data, starts, ends)
        left, out, hits = np.arange(len(row)), np.zeros((len(starts), len(languages))), np.zeros(len(starts))
        for n, key, logs in gram:
            ok, value = _grams(h, leads, at, n, prefix, left, row)
            place, known = _look(key, value)
            ok, place = ok[known], place[known]
            for k in range(len(languages)):
                out[:, k] += np.bincount(row[ok], logs[place, k], len(starts))
            hits += np.bincount(row[ok], minlength=len(starts))
            rest = np.zeros(len(row), bool)
            rest[left] = True
            rest[ok] = False
            left = np.flatnonzero(rest)
        return out / np.maximum(hits, 1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = _letter_hasher()
        for whole in batches:
            for batch in pieces(whole, "text"):
                data, starts, ends, of = _letter_words(h, batch)
                sums = np.zeros((len(batch), len(languages)))
                if len(starts) and languages:
                    value = h.word_hashes(data, starts, ends)
                    first, inverse = _distinct(value)
                    place, known = _look(word_key, value[first])
                    logs = np.zeros((len(first), len(languages)))
                    if known.any():
                        logs[known] = word_log[place[known]]
                    new = np.flatnonzero(~known)
                    if len(new):
                        logs[new] = backoff(h, data, starts[first[new]], ends[first[new]])
                    row = rows_of(of)
                    for k in range(len(languages)):
                        sums[:, k] = np.bincount(row, logs[inverse, k], len(batch))
                letter = pc.fill_null(pc.match_substring_regex(batch.column("text").cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if languages:
                    share = np.exp(sums - sums.max(axis=1, keepdims=True))
                    share /= share.sum(axis=1, keepdims=True)
                    best = share.argmax(axis=1)
                    pred = np.where(letter, np.array(languages, object)[best], UNDETERMINED)
                    score = np.where(letter, share[np.arange(len(best)), best], 0.0)
                else:
                    pred, score = np.full(len(batch), UNDETERMINED, object), np.zeros(len(batch))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(pred, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The likeliest language of every whole text.

    A text's words (lower-cased runs of letters) add their log frequency in each language. A word
    that the model has not seen backs off: it adds the mean, over its characters, of the log frequency of the
    longest n-gram of characters known there. The score is the softmax of the sums.

    Returns id (named ``id_col``), held_out, lang_pred and score. A null text or one without a letter
    is ``und`` with score 0, and so are all texts if the model has no language; equal sums go to the
    language that sorts first. Null ids and repeated rows are rows like any other; other columns are not read.
    """
    need(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = rows.mapInArrow(_predict(model), f"id {kind}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), is_held_out("id").alias("held_out"), "lang_pred", "score")
