"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import BYTE_P, Hasher, pieces, rows_of, utf8
from .common import drop_table, is_held_out, need, table
from .sampling import labelled_sample, logistic

TABLE_BITS = 22
#: Bytes of text that a worker looks at together to find or count n-grams, about: what it needs meanwhile is over a hundred times as much.
LOOKED_AT = 1 << 18


@dataclass(frozen=True)
class ToxicityModel:
    """Sorted hashes of the chosen n-grams, each one's weight, and the bias."""

    sizes: tuple[int, ...]
    gram: np.ndarray
    weight: np.ndarray
    bias: float


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case and white space as a space."""
    to = np.arange(256, dtype=np.uint8)
    to[65:91] += 32
    to[9:14] = 32
    return to[data]


def _grams(h: Hasher, data: np.ndarray, at: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: (row, hash) of all n-grams of bytes inside a row."""
    prefix = h.prefix(h.of_byte[folded(data)], BYTE_P)
    row = rows_of(at)
    for n in sizes:
        start = np.arange(max(len(data) - n + 1, 0))
        if len(start):
            inside = row[: len(start)] == row[n - 1 :]
            start = start[inside]
            yield row[start], h.spans(prefix, start, start + n, BYTE_P)


class Finder:
    """Looks up hashes among a few thousand: first by their top bits, then in full."""

    def __init__(self, gram: np.ndarray) -> None:
        self.gram = gram
        self.some = np.zeros(1 << TABLE_BITS, bool)
        self.some[(gram >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``value`` that are known, and their places in ``gram``."""
        maybe = np.flatnonzero(self.some[(value >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        place = np.searchsorted(self.gram, value[maybe]).clip(0, max(len(self.gram) - 1, 0))
        good = self.gram[place] == value[maybe] if len(self.gram) else np.zeros(len(maybe), bool)
        return maybe[good], place[good]


def _present(h: Hasher, finder: Finder, batch: pa.RecordBatch, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of a chunk, sorted by row."""
    data, at = utf8(batch.column("text"))
    found = [np.zeros(0, np.int64)]
    for row, value in _grams(h, data, at, sizes):
        where, place = finder.find(value)
        found.append(np.unique(row[where] * (1 << 24) + place))
    both = np.concatenate(found)
    both.sort()
    return both >> 24, both & ((1 << 24) - 1)


def _count(sizes: tuple[int, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        for whole in batches:
            for batch in pieces(whole, "text", LOOKED_AT):
                y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
                for row, value in _grams(h, *utf8(batch.column("text")), sizes):
                    order = np.lexsort((row, value))
                    row, value = row[order], value[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
                    row, value = row[new], value[new]
                    begin = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, int)
                    n = np.diff(np.append(begin, len(value)))
                    one = np.add.reduceat(y[row], begin) if len(begin) else n
                    yield pa.RecordBatch.from_arrays([pa.array(value[begin].view(np.int64)), pa.array(n - one), pa.array(one)], ["gram", "n0", "n1"])

    return run


def _features(model_gram: np.ndarray, sizes: tuple[int, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, finder = Hasher(), Finder(model_gram)
        for whole in batches:
            for batch in pieces(whole, "text", LOOKED_AT):
                row, feature = _present(h, finder, batch, sizes)
                offsets = np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature.astype(np.int32)))], ["y", "features"])

    return run


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 20_000, sizes: tuple[int, ...] = (3, 4, 5, 6), least_docs: int = 5, features: int = 4096
) -> ToxicityModel:
    """Learns from the labels of at most about ``sample_rows`` rows that are not held out.

    An n-gram's ratio is the log of its share among toxic texts over its share among others (counts of texts, plus
    one). The ``features`` n-grams with the largest ratio times the root of their count are kept; presence times
    ratio is the input of a logistic regression, fitted on the driver on at most sample_rows x
    features bits. Without a label of either kind the model gives the prior.
    """
    need(docs, id_col, text_col)
    need(labels, id_col, label_col)
    sample = table(labelled_sample(docs, labels, id_col, text_col, label_col, sample_rows), "labelled")
    totals = sample.agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(0)), F.count(F.lit(1))).first()
    n1, n = totals[0] or 0, totals[1]
    counts = sample.mapInArrow(_count(sizes), "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = counts.where(F.col("n0") + F.col("n1") >= least_docs)
    ratio = F.log((F.col("n1") + 1) / (n1 + 2.0)) - F.log((F.col("n0") + 1) / (n - n1 + 2.0))
    top = counts.select("gram", ratio.alias("ratio"), (F.abs(ratio) * F.sqrt(F.col("n0") + F.col("n1"))).alias("worth")).orderBy(F.desc("worth"), "gram").limit(features)
    got = top.toArrow()
    gram, ratio = got.column("gram").to_numpy().view(np.uint64), got.column("ratio").to_numpy()
    order = np.argsort(gram)
    gram, ratio = gram[order], ratio[order]
    rows = sample.mapInArrow(_features(gram, sizes), "y int, features array<int>").toArrow().combine_chunks()
    drop_table(sample)
    if not len(rows) or not len(gram):
        return ToxicityModel(sizes, gram, np.zeros(len(gram)), float(np.log((n1 + 1) / (n - n1 + 1))))
    lists = rows.column("features").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    index = lists.flatten().to_numpy()
    w, b = logistic(lists.offsets.to_numpy() - lists.offsets[0].as_py(), index, ratio[index], (rows.column("y").to_numpy() > 0).astype(float), len(gram))
    return ToxicityModel(sizes, gram, w * ratio, b)


def _score(model: ToxicityModel) -> Callable:
    sizes, gram, weight, bias = model.sizes, model.gram, model.weight, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, finder = Hasher(), Finder(gram)
        for whole in batches:
            for batch in pieces(whole, "text", LOOKED_AT):
                row, feature = _present(h, finder, batch, sizes)
                z = np.bincount(row, weight[feature], len(batch)) + bias if len(feature) else np.full(len(batch), bias)
                score = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                names = [n for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), score], [*names, "score"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, payload: list[str] | None = None) -> DataFrame:
    """Scores whole texts. Returns id (named ``id_col``), held_out, score (0 to 1), predicted (1 if
    the score is at least ``threshold``) and a struct ``payload`` of the named columns (if any).
    Null and empty texts have the score of a text without any known n-gram. Null ids and repeated
    rows are rows like any other; other columns are not read."""
    need(docs, id_col, text_col, *(payload or []))
    cols = [F.struct(*(F.col(f"`{c}`") for c in payload)).alias("payload")] if payload else []
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *cols)
    scored = rows.mapInArrow(_score(model), rows.drop("text").schema.add("score", "double"))
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0)
    return scored.select(F.col("id").alias(id_col), is_held_out("id").alias("held_out"), "score", predicted.alias("predicted"), *(["payload"] if payload else []))


def drop_toxic(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are not predicted as toxic, with all their columns."""
    kept = score_toxicity(docs, model, id_col, text_col, threshold, payload=docs.columns).where("predicted = 0")
    return kept.select(*(F.col("payload")[c].alias(c) for c in docs.columns))
