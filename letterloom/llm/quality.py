"""Quality: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import BYTE_P, Hasher, pieces, rows_of, utf8
from .common import is_held_out, need, table
from .sampling import labelled_sample, logistic

#: Names of the measures of a text, in order.
MEASURES = ("log_words", "word_length", "letters", "digits", "upper", "marks", "spaces", "breaks", "distinct_words", "top_word", "distinct_lines", "marked_words")


def measures(h: Hasher, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of MEASURES for each text; texts without bytes are all zeros."""
    size = np.diff(at)
    rows = len(size)
    some = np.maximum(size, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[at[1:]] - total[at[:-1]]) / some

    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    digit, upper, space, line = (data >= 48) & (data <= 57), (data >= 65) & (data <= 90), h.space[data], data == 10
    mark = ~(letter | digit | space)
    starts, ends, of = h.words(data, at)
    words = np.diff(of)
    n = np.maximum(words, 1)
    row = rows_of(of)
    value = h.word_hashes(data, starts, ends)
    order = np.lexsort((value, row))
    new = np.ones(len(row), bool)
    new[1:] = (value[order][1:] != value[order][:-1]) | (row[order][1:] != row[order][:-1])
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(row)))
    top = np.zeros(rows)
    np.maximum.at(top, row[order][begin], times)
    ends_marked = np.bincount(row, mark[np.maximum(ends - 2, 0)] & mark[ends - 1] if len(ends) else None, rows) if len(row) else np.zeros(rows)
    # lines: the pieces between breaks
    cut = np.unique(np.concatenate([at[:-1][size > 0], np.flatnonzero(line) + 1]))
    cut = cut[cut < len(data)]
    line_row = np.searchsorted(at, cut, "right") - 1
    line_end = np.minimum(np.append(cut[1:], len(data)), at[line_row + 1]) if len(cut) else cut
    hashes = h.spans(h.prefix(h.of_byte[data], BYTE_P), cut, line_end, BYTE_P)
    per = np.maximum(np.bincount(line_row, minlength=rows), 1)
    both = np.unique(np.stack([line_row.astype(np.uint64), hashes]), axis=1)[0].astype(np.int64) if len(cut) else np.zeros(0, np.int64)
    columns = [np.log1p(words), (size - np.bincount(rows_of(at), space, rows)) / n if len(data) else np.zeros(rows), *map(share, (letter, digit, upper, mark, space, line)),
               np.bincount(row[order][begin], minlength=rows) / n, top / n, np.bincount(both, minlength=rows) / per, ends_marked / n]
    return np.where(size[:, None] > 0, np.stack(columns, axis=1), 0.0)


@dataclass(frozen=True)
class QualityModel:
    """Mean and scale of the measures, weights of them, their squares and products, bias and prior."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float


def _inputs(x: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([x, x[:, i] * x[:, j]], axis=1)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    h = Hasher()
    for whole in batches:
        for batch in pieces(whole, "text"):
            x = measures(h, *utf8(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.int32()), lists], ["y", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000) -> QualityModel:
    """A logistic regression on MEASURES, their squares and products, from the labels of at most about
    ``sample_rows`` rows that are not held out. Without labels it gives even odds."""
    need(docs, id_col, text_col)
    need(labels, id_col, label_col)
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, sample_rows)
    got = sample.mapInArrow(_measured, "y int, x array<double>").toArrow()
    y = (got.column("y").to_numpy() > 0).astype(float)
    x = np.array(got.column("x").to_pylist(), float).reshape(len(y), len(MEASURES))
    if not len(y):
        return QualityModel(np.zeros(len(MEASURES)), np.ones(len(MEASURES)), np.zeros(_inputs(x).shape[1]), 0.0, 0.5)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = _inputs(np.clip((x - mean) / scale, -4, 4))
    n, k = z.shape
    w, b = logistic(np.arange(n + 1) * k, np.tile(np.arange(k), n), z.reshape(-1), y, k, l2=1e-3, rounds=200, rate=0.1)
    return QualityModel(mean, scale, w, b, float((y.sum() + 1) / (n + 2)))


def _evidence(model: QualityModel) -> Callable:
    mean, scale, weight, bias, prior = model.mean, model.scale, model.weight, model.bias, model.prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        for whole in batches:
            for batch in pieces(whole, "text"):
                z = _inputs(np.clip((measures(h, *utf8(batch.column("text"))) - mean) / scale, -4, 4)) @ weight + bias
                # the prior is in the sites' part: what is left is the document's likelihood ratio
                ratio = pa.array(np.clip(z, -12, 12) - np.log(prior / (1 - prior)))
                names = [n for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ratio], [*names, "evidence"])

    return run


def _strength(groups: DataFrame, rate: str, prior: float) -> float:
    """Pseudo-counts of a beta prior whose groups' rates vary as these do (moments; 2 to 1000)."""
    n, k = F.col("n"), F.col(rate)
    got = groups.where(n > 0).agg(F.sum(n), F.sum((k / n - F.lit(prior)) ** 2 * n), F.count(F.lit(1)), F.sum(n * n)).first()
    if not got[0] or got[2] < 2:
        return 50.0
    noise = prior * (1 - prior)
    spread = (got[1] - noise * (got[2] - 1)) / max(got[0] - got[3] / got[0], 1e-9)
    return float(min(max(noise / spread - 1, 2.0), 1000.0)) if spread > 0 else 1000.0


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    model: QualityModel,
    host: Column,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    soft_weight: float = 0.25,
    threshold: float = 0.5,
) -> DataFrame:
    """Posterior that a document is good.

    Each document gives its site one unit of evidence if it has a label and is not held out, else
    ``soft_weight`` of its own classifier's probability. Counts are summed by (host, path), those by host
    and those to the whole. A host's posterior mean is shrunk towards the whole, a path's towards
    its host, by as many pseudo-counts as the spread of the groups' rates calls for (method of
    moments): sparse sites stay near their parent. A document's posteriors leave out what it gave itself, so
    its evidence (or label) counts once. The odds of the path's posterior times the
    document's likelihood ratio give the score.

    Returns id (named ``id_col``), held_out, score (0 to 1), predicted (1: score at least
    ``threshold``), evidence, host_posterior and path_posterior. Null texts count as empty, null
    hosts and paths are sites like any other, repeated labels count once. Null ids have no label.
    """
    need(docs, id_col, text_col)
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y")).where(F.col("y").isNotNull() & ~is_held_out("id")).groupBy("id").agg(F.max(F.when(F.col("y") > 0, 1.0).otherwise(0.0)).alias("y"))
    none = F.lit("\u0001")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(host.cast("string"), none).alias("host"), F.coalesce(path.cast("string"), none).alias("path"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = table(rows.mapInArrow(_evidence(model), rows.drop("text").schema.add("evidence", "double")), "evidence")
    p_doc = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(float(np.log(model.prior / (1 - model.prior)))))))
    weight = F.when(F.col("y").isNotNull(), 1.0).otherwise(soft_weight)
    rows = rows.join(known, "id", "left").withColumn("own_n", weight).withColumn("own_k", weight * F.coalesce("y", p_doc)).drop("y")
    sites = rows.groupBy("host", "path").agg(F.sum("own_n").alias("n"), F.sum("own_k").alias("k"))
    sites = table(sites, "sites")
    whole = sites.agg(F.sum("n"), F.sum("k")).first()
    prior = ((whole[1] or 0.0) + 1) / ((whole[0] or 0.0) + 2)
    hosts = sites.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    m_host, m_path = _strength(hosts, "k", prior), _strength(sites, "k", prior)
    sites = sites.withColumnsRenamed({"n": "path_n", "k": "path_k"}).join(hosts.withColumnsRenamed({"n": "host_n", "k": "host_k"}), "host")
    # what a document itself gave its site says nothing new of it
    others = lambda level, own: F.greatest(F.col(f"{level}_{own}") - F.col(f"own_{own}"), F.lit(0.0))
    out = rows.join(sites, ["host", "path"])
    out = out.withColumn("host_posterior", (others("host", "k") + m_host * prior) / (others("host", "n") + m_host))
    out = out.withColumn("path_posterior", (others("path", "k") + m_path * F.col("host_posterior")) / (others("path", "n") + m_path))
    odds = F.col("evidence") + F.log(F.col("path_posterior")) - F.log(1 - F.col("path_posterior"))
    out = out.withColumn("score", 1 / (1 + F.exp(-odds)))
    return out.select(
        F.col("id").alias(id_col), is_held_out("id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "evidence", "host_posterior", "path_posterior"
    )
