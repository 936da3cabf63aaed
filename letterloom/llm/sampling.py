"""Labelled training rows: a bounded sample by hash of the id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out

SAMPLE_BITS = 30


def labelled_sample(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, label: str, most: int, least: int = 500) -> DataFrame:
    """(text, y) of about ``most`` rows that are not held out (common.is_held_out) and have a label; all rows if there
    are no more. Each label has its share of them, but about ``least`` rows if it has as many, so a rare one is not lost.
    Rows are chosen by the hash of their id, so a sample does not depend on partitions. Repeated labels of an
    id count once, with the largest value."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *([] if labels is not None else [F.col(f"`{label}`").alias("y")]))
    if labels is not None:
        labels = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").alias("y")).where(F.col("y").isNotNull() & ~is_held_out("id"))
        labels = labels.groupBy("id").agg(F.max("y").alias("y"))
    else:
        rows = rows.where(F.col("y").isNotNull() & ~is_held_out("id"))
    # one row a label
    counts = (rows if labels is None else labels).groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    share = counts.select("y", F.least(F.lit(1.0), F.greatest(F.lit(most / total), least / F.col("n"))).alias("share"))
    chosen = F.pmod(F.xxhash64("id"), F.lit(1 << SAMPLE_BITS)) < F.col("share") * F.lit(1 << SAMPLE_BITS)
    if labels is not None:
        # about ``most`` rows of two numbers, and ``least`` for each label
        rows = rows.join(F.broadcast(labels.join(F.broadcast(share), "y").where(chosen).select("id", "y")), "id")
    else:
        rows = rows.join(F.broadcast(share), "y").where(chosen)
    return rows.select("text", "y")


def logistic(indptr: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, n_features: int, l2: float = 1e-4, rounds: int = 150, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sparse rows (full gradients, Adam's steps)."""
    w, b = np.zeros(n_features), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    row = np.repeat(np.arange(len(y)), np.diff(indptr))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[index] * value, len(y)) + b
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(index, err[row] * value, n_features) / len(y) + l2 * w, err.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate / np.sqrt(t) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)
