"""Exact dedup by distributed MSD radix partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, few_files, join_groups, need, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIRST_DIGIT, GROWTH = 64, 4
#: 2**27 bits, 16 MB: what is sent to all tasks to tell the heads that may repeat.
SPOT_BITS = 27


def _repeated(heads: DataFrame) -> np.ndarray:
    """Bits of the heads that more than one row has, by their hash: 2**SPOT_BITS bits at most, at any size of input."""
    spots = heads.groupBy("digit", "spot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # the buckets of bitmap_construct_agg are counted from 1
    blocks = spots.groupBy(F.bitmap_bucket_number("spot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")).toArrow()
    bits = np.zeros((1 << SPOT_BITS) // 8, np.uint8)
    for block, some in zip(blocks.column("block").to_pylist(), blocks.column("bits").to_pylist(), strict=True):
        at = (block - 1) * len(some)
        bits[at : at + len(some)] = np.frombuffer(some, np.uint8)
    return bits


def _hashed(repeated: Broadcast, with_rest: bool) -> Callable:
    """Adds sha256 of the normalised text, the node (null for a text whose head no other has) and, ``with_rest``,
    what the first digit leaves of the texts that go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = bytes.maketrans(UPPER.encode(), LOWER.encode())
        for batch in batches:
            texts = [(x or b"").translate(fold) for x in batch.column("text").to_pylist()]
            columns = {n: batch.column(n) for n in batch.schema.names if n not in ("text", "spot")}
            spot = batch.column("spot").to_numpy() - 1
            on = (repeated.value[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
            columns["node"] = pa.array(np.zeros(len(on), np.int64), mask=~on)
            columns["text_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            if with_rest:
                columns["rest"] = pa.array([t[FIRST_DIGIT:] if o else None for t, o in zip(texts, on, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", payload: list[str] | None = None) -> DataFrame:
    """Groups rows whose texts are equal after lower-casing A-Z, and keeps the largest id of each.

    Radix partitioning from the most significant end: a round splits every open group by the next
    bytes of its texts (64, then 256, 1024, ... of them, so a text of n bytes takes log4(n) rounds).
    A group that is a single row or whose texts have ended is done; only the others go on, and a
    round sends its own digit of them: the texts stay in one table. Bytes are compared themselves; the digest is only output.
    No text is sent for the first digit: bits of the heads' hashes (2**SPOT_BITS, whatever the size of the input) tell
    where the text stands which ones surely have no equal; a head that is not alone in its bit is split off by its bytes
    in the first round. Only a partial count a task is sent for a digit. Rows find their group by a join in which a group of more
    than a task's even share of the open rows is dealt out over several tasks, so that a digit which a
    third of the rows share makes no large task.

    Returns a row for each row of ``docs``: id (named ``id_col``), keep_id, group_size, kept,
    text_sha256 and a struct ``payload`` of the named columns (if any). Other columns are not read.

    Null texts count as empty; empty texts are a group like any other. A null id is smaller than all
    others. Of rows that repeat both the largest id and the text exactly one is kept. An empty table
    gives an empty result.
    """
    need(docs, id_col, text_col, *(payload or []))
    extra = [F.struct(*(F.col(f"`{c}`") for c in payload)).alias("payload")] if payload else []
    head = F.translate(F.substring(F.col(f"`{text_col}`"), 1, FIRST_DIGIT), UPPER, LOWER).cast("binary")
    head = F.coalesce(F.substring(head, 1, FIRST_DIGIT), F.lit(b""))
    # a text that is in the payload is not sent twice
    sent = bool(payload) and text_col in payload
    text = F.col("payload")[text_col] if sent else F.col("text")
    # counted from 1, as bitmap_bit_position and its bucket count them
    spot = (F.xxhash64("digit").bitwiseAND((1 << SPOT_BITS) - 1) + 1).alias("spot")
    repeated = docs.sparkSession.sparkContext.broadcast(_repeated(docs.select(head.alias("digit")).select("digit", spot)))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), head.alias("digit"), *extra, *([] if sent else [F.col(f"`{text_col}`").alias("text")]))
    own = ["payload"] if payload else []
    rows = rows.select("id", F.monotonically_increasing_id().alias("rid"), *own, "digit", spot, text.cast("binary").alias("text"))
    schema = rows.drop("text", "spot").schema.add("node", "long").add("text_sha256", "string")
    schema = schema if sent else schema.add("rest", "binary")
    first = table(rows.mapInArrow(_hashed(repeated, not sent), schema), "radix")

    # the payload stays behind while groups are split
    keep = ["id", "rid", "text_sha256"]
    single = first.where("node IS NULL").select(*keep, *own)
    done = [single.select(*keep, *own, F.col("id").alias("keep_id"), F.col("rid").alias("keep_rid"), F.lit(1).cast("long").alias("group_size"))]
    now, width, rounds = first.where("node IS NOT NULL"), FIRST_DIGIT, []
    # the texts stay where they are too: a round sends its own digit of them and no more
    whole = F.translate(F.coalesce(F.col("payload")[text_col].cast("string"), F.lit("")), UPPER, LOWER).cast("binary") if sent else None
    rest, at = (whole, FIRST_DIGIT) if sent else (F.col("rest"), 0)
    texts = first.where("node IS NOT NULL")
    while True:
        groups = table(few_files(now.groupBy("node", "digit").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "rid")).alias("top"))), f"groups{width}")
        split = join_groups(now.select(*keep, "node", "digit"), groups, "node", "digit")
        ended = (F.col("n") == 1) | (F.length("digit") < width)
        nxt = split.select(
            *keep,
            F.col("top.id").alias("keep_id"),
            F.col("top.rid").alias("keep_rid"),
            F.col("n").alias("group_size"),
            F.when(~ended, F.col("top.rid")).alias("node"),
        )
        nxt = table(few_files(nxt), f"radix{width}")
        drop_table(groups)
        rounds.append(nxt)
        done.append(nxt.where("node IS NULL").drop("node"))
        width *= GROWTH
        on = nxt.where("node IS NOT NULL").select(*keep, "node")
        if on.isEmpty():
            break
        now = table(few_files(on.join(texts.select("rid", F.substring(rest, at + 1, width).alias("digit")), "rid")), f"digits{width}")
        rounds.append(now)
        at += width
    split = done[1]
    for d in done[2:]:
        split = split.unionByName(d)
    # the rounds' tables hold digits of the texts; only the groups stay
    split = table(few_files(split), "groups")
    for t in rounds:
        drop_table(t)
    if payload:
        split = split.join(first.where("node IS NOT NULL").select("rid", "payload"), "rid")
    out = done[0].unionByName(split)
    out = out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256", *(["payload"] if payload else [])
    )
    return few_files(out)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col, payload=docs.columns).where("kept")
    return kept.select(*(F.col("payload")[c].alias(c) for c in docs.columns))
