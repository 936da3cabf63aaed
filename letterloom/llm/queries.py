"""Queries opN_<name> of this subpackage, each over its whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dartminhash, langid, mixing, multi_index, packing, pii, quality, radix_dedup, recompression, toxicity


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public tokenizer that the packing query is defined with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op2_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op3_word_first_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify_languages(docs, langid.fit_languages(docs))


def op4_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op5_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels")))


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).drop("copies")


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources; a path is a source's section in one language."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality.score_quality(docs, labels, quality.fit_quality(docs, labels), F.col("source"), F.concat_ws("/", "source", "lang"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(read(spark, sf_dir, "documents"))


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.substring_dedup(read(spark, sf_dir, "documents"), with_text=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_multi_index,
        op2_complement_packing,
        op3_word_first_language,
        op4_radix_dedup,
        op5_nb_toxicity,
        op6_pivotal_mixing,
        op7_dart_minhash,
        op8_bayes_quality,
        op9_pii,
        op10_recompression,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_radix_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
            doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op10_recompression": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, i, list_slice(ws, i, i + 19) AS words FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
        later AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
        each_word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
        marked AS (SELECT e.doc_id, e.p, e.word, g.p IS NOT NULL AS lost FROM each_word e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p),
        kept AS (SELECT doc_id, count(*) FILTER (lost) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT lost) AS t FROM marked GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
}
