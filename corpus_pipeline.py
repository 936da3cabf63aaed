"""A training-corpus pipeline: toxic documents, exact copies and near copies go, sources are mixed to
their weights, and what is left is packed into sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from letterloom.llm import dartminhash, mixing, packing, radix_dedup, toxicity
from letterloom.llm.common import table
from letterloom.llm.queries import read, tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labels, scores below 0.3, with all their columns. Null and empty texts
    have the score of a text without known n-grams; without labels the prior decides. No rows give no rows."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal but for the case of A-Z, the one with the largest doc_id, with all its columns. Null
    counts as empty; of repeated rows one stays. No rows give no rows."""
    return radix_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a similarity of 0.8 or more over runs of five words, the one with the least doc_id, with all its
    columns. Texts without a word, null ones too, all stay. No rows give no rows."""
    return dartminhash.drop_near_copies(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them: one that is taken twice is there twice. Null sources are one
    source; texts without a word (null ones too) have no words to give and are not taken. No rows give no rows."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document and its place in a sequence; the columns are packing's. Null and empty
    texts are one id; repeated rows are documents like any other. No rows give no rows."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_to_weights),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned scores and random rounding have no SQL.
ORACLE_SQL: str | None = None
