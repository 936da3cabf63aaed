"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import U64, WORD_P, Hasher, digest, joined_words, mix, pieces, utf8
from .common import drop_table, few_files, join_groups, need, table

#: Shingles of a bucket's nodes that meet as many others in one task, about: some megabytes of text. A
#: longer text is alone.
BLOCK = 1 << 18
#: Columns of the 0/1 matrices that are multiplied at once.
COLUMNS = 4096


def texts_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray) -> pa.Array:
    """Of the words of each row, joined by one space."""
    raw, at, _ = joined_words(data, starts, ends, of)
    view = memoryview(raw)
    return pa.array([digest(view[i:j]) if j > i else None for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())


def shingles(h: Hasher, data: np.ndarray, at: np.ndarray, size: int, digests: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array | None]:
    """The distinct shingles of all texts: row, hash, weight (times it occurs), in no order; and the
    digest of each text's sequence of words, null without any. A text of fewer words than ``size`` is one shingle."""
    starts, ends, of = h.words(data, at)
    prefix = h.prefix(h.word_hashes(data, starts, ends), WORD_P)
    words = np.diff(of)
    n = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + of[:-1][row]
    value = h.spans(prefix, first, np.minimum(first + size, of[1:][row]), WORD_P)
    # equal (row, hash) are made neighbours by one key
    key = value ^ mix(np.arange(len(n), dtype=U64))[row]
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(begin, len(key)))
    return row[order[begin]], value[order[begin]], weight, texts_digests(data, starts, ends, of) if digests else None


def uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((h >> U64(11)).astype(float) + 1) * 2.0**-53


def dart_minhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, sets: int, k: int) -> np.ndarray:
    """DartMinHash of weighted sets: k names for each set (0 where a set has no element).

    Darts fall on the plane of weight and rank above each element as a Poisson process that hashes
    alone decide, each on one of k coordinates. A dart hits a set if its weight is at most the element's; a
    coordinate keeps the earliest (least rank) dart that hits, and two sets keep the same one with
    probability equal to their weighted Jaccard similarity. Darts are thrown up to the rank at which about
    k log k of them hit a set, and to twice that rank where a coordinate is still without one, so a
    set costs its elements and about k log k darts.
    """
    best, name = np.full(sets * k, np.inf), np.zeros(sets * k, U64)
    total = np.bincount(row, weight, sets)
    reach = k * (np.log(k) + 2.5) / np.maximum(total, 1e-300)
    tiles = np.ceil(weight).astype(np.int64)
    partial = bool((tiles != weight).any())
    # a unit of an element's weight is a tile
    at, full = np.repeat(row, tiles), np.repeat(weight, tiles)
    unit = np.arange(len(at)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
    seed = mix(np.repeat(element, tiles) + mix(unit.astype(U64)))
    open_ = total > 0
    while open_.any():
        live = np.flatnonzero(open_[at])
        rank, nth = np.zeros(len(live)), 0
        while len(live):
            nth += 1
            dart = mix(seed[live] + U64(nth * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
            rank = rank - np.log(uniform(dart))
            near = rank <= reach[at[live]]
            live, rank, dart = live[near], rank[near], dart[near]
            hit, when, which = live, rank, dart
            if partial:
                under = unit[live] + uniform(mix(dart + U64(1))) <= full[live]
                hit, when, which = live[under], rank[under], dart[under]
            cell = at[hit] * k + (mix(which + U64(3)) % U64(k)).astype(np.int64)
            np.minimum.at(best, cell, when)
            first = when == best[cell]
            name[cell[first]] = which[first]
        open_ = open_ & np.isinf(best.reshape(sets, k)).any(axis=1)
        reach = np.where(open_, reach * 2, reach)
    return name.reshape(sets, k)


def _sketch(size: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        for whole in batches:
            for batch in pieces(whole, "text"):
                row, value, weight, names = shingles(h, *utf8(batch.column("text")), size, digests=True)
                sig = dart_minhash(row, value, weight, len(batch), bands * rows).reshape(len(batch), bands, rows)
                key = np.zeros((len(batch), bands), U64) + np.arange(bands, dtype=U64)
                for r in range(rows):
                    key = mix(key * U64(0x9FB21C651E98DF25) + sig[:, :, r])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * bands), pa.array(key.reshape(-1).view(np.int64)))
                others = [n for n in batch.schema.names if n != "text"]
                own = [names, pa.array(np.bincount(row, weight, len(batch)).astype(np.int64)), lists]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in others), *own], [*others, "digest", "weight", "bands"])

    return run


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sets as (sorted distinct elements, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(int(a[1].sum() + b[1].sum()) - both, 1)


def _verify(size: int, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        for whole in batches:
            for some in pieces(whole, "text_a"):
                for batch in pieces(some, "text_b"):
                    sides = []
                    for c in ("text_a", "text_b"):
                        row, value, weight, _ = shingles(h, *utf8(batch.column(c)), size)
                        order = np.lexsort((value, row))
                        row, value, weight = row[order], value[order], weight[order]
                        at = np.searchsorted(row, np.arange(len(batch) + 1)).tolist()
                        sides.append([(value[i:j], weight[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)])
                    sim = pa.array([weighted_jaccard(x, y) for x, y in zip(*sides, strict=True)], pa.float64())
                    yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), sim], ["a", "b", "similarity"]).filter(pa.compute.greater_equal(sim, least))

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each of ``a`` has in common with each of ``b`` (sorted distinct elements)."""
    if len(a) * len(b) <= 32:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a]).reshape(len(a), len(b))
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    row_a, row_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for flat, row in ((flat_a, row_a), (flat_b, row_b)):
        at = np.searchsorted(both, flat).clip(0, max(len(both) - 1, 0))
        good = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[good], kind="stable")
        sides.append((at[good][order], row[good][order]))
    for low in range(0, len(both), COLUMNS):
        matrices = []
        for (at, row), n in zip(sides, (len(a), len(b)), strict=True):
            i, j = np.searchsorted(at, [low, low + COLUMNS])
            m = np.zeros((n, min(COLUMNS, len(both) - low)), np.float32)
            m[row[i:j], at[i:j] - low] = 1
            matrices.append(m)
        out += matrices[0] @ matrices[1].T
    return out


def _meet(size: int, least: float) -> Callable:
    """Links between the asking rows of each bucket and its member rows of other components."""

    def run(group: pa.Table) -> pa.Table:
        h, units = Hasher(), []
        for whole in group.combine_chunks().to_batches():
            for batch in pieces(whole, "text"):
                row, value, weight, _ = shingles(h, *utf8(batch.column("text")), size)
                nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                row, value = np.repeat(row, weight), mix(np.repeat(value, weight) + mix(nth.astype(U64)))
                order = np.lexsort((value, row))
                value, at = value[order], np.searchsorted(row[order], np.arange(len(batch) + 1))
                units += [value[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        bucket, node, comp, asks, answers = (group.column(c).to_numpy() for c in ("bucket", "node", "comp", "asks", "answers"))
        total = np.array([len(u) for u in units])
        found_a, found_b, comp_a, comp_b, found_s = [], [], [], [], []
        order = np.argsort(bucket, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            q, m = rows[asks[rows]], rows[answers[rows]]
            if not len(q) or not len(m):
                continue
            both = overlaps([units[i] for i in q], [units[i] for i in m])
            sim = both / np.maximum(total[q][:, None] + total[m][None, :] - both, 1)
            i, j = np.nonzero((sim >= least) & (comp[q][:, None] != comp[m][None, :]))
            found_a.append(np.minimum(node[q[i]], node[m[j]]))
            found_b.append(np.maximum(node[q[i]], node[m[j]]))
            comp_a.append(comp[q[i]])
            comp_b.append(comp[m[j]])
            found_s.append(sim[i, j].astype(float))
        none = [np.zeros(0, np.int64)]
        columns = {"a": found_a, "b": found_b, "comp_a": comp_a, "comp_b": comp_b}
        return pa.table({**{k: np.concatenate(v or none) for k, v in columns.items()}, "similarity": np.concatenate(found_s or [np.zeros(0)])})

    return run


def _in_blocks(left: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Compares, in every bucket, the nodes outside its largest component with all its nodes of other
    components. Rows are nodes: small buckets (up to BLOCK shingles in all) are dealt out whole, a large one in
    blocks of about BLOCK shingles of asking and of answering nodes, so what a task holds is bounded in bytes.
    Pairs are formed inside a task only, and links leave it."""
    mine = left.groupBy("bucket", "comp").agg(F.sum("weight").alias("k"))
    stats = mine.groupBy("bucket").agg(F.sum("k").alias("n"), F.max(F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"))
    stats = stats.where("comps > 1").select("bucket", "n", F.col("main.comp").alias("main"), (F.col("n") - F.col("main.k")).alias("asking"))
    rows = left.select("bucket", "node", "comp", "weight").join(stats, "bucket").withColumn("asks", F.col("comp") != F.col("main"))
    rows = table(few_files(rows.join(texts, "node").select("bucket", "node", "comp", "weight", "n", "asking", "asks", "text")), "open")
    small = F.col("n") <= BLOCK
    bins = max((rows.where(small).agg(F.sum("weight")).first()[0] or 0) // BLOCK, 1)
    whole = rows.where(small).select(F.struct(F.pmod(F.xxhash64("bucket"), F.lit(bins)).alias("x"), F.lit(-1).cast("long").alias("y"), F.lit(-1).cast("long").alias("z")).alias("grp"), "bucket", "node", "comp", "asks", F.lit(True).alias("answers"), "text")
    place = lambda n: F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / BLOCK) - 1))
    ask = rows.where(~small & F.col("asks")).withColumn("y", place("asking")).withColumn("z", every("n"))
    answer = rows.where(~small).withColumn("z", place("n")).withColumn("y", every("asking"))
    large = [x.select(F.struct(F.col("bucket").alias("x"), "y", "z").alias("grp"), "bucket", "node", "comp", F.lit(a).alias("asks"), F.lit(not a).alias("answers"), "text") for x, a in ((ask, True), (answer, False))]
    found = table(whole.union(large[0]).union(large[1]).groupBy("grp").applyInArrow(_meet(size, least), "a long, b long, comp_a long, comp_b long, similarity double"), "verified")
    drop_table(rows)
    return found


def components(edges: DataFrame) -> DataFrame:
    """Connected components (node, comp: the least node) of edges (a, b), by least labels of
    neighbours and pointer jumping: as many rounds as the logarithm of the longest path."""
    both = table(few_files(edges.select("a", "b").union(edges.select("b", "a")).distinct()), "links")
    now = table(few_files(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node")), "labels")
    while True:
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = now.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        nxt = table(few_files(step.join(jump, "comp").select("node", "old", F.least("comp", "far").alias("comp"))), "labels")
        changed = not nxt.where("old <> comp").isEmpty()
        drop_table(now)
        now = nxt
        if not changed:
            drop_table(both)
            return now


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, threshold: float = 0.8, bands: int = 25, rows_per_band: int = 5, payload: list[str] | None = None
) -> DataFrame:
    """Classes of documents that are linked by a similarity of ``threshold`` or more.

    Similarity is weighted Jaccard over runs of ``shingle_words`` words (unchanged, split at white
    space), weighted by how often a text has them. Texts with the same words in the same order (by a
    128-bit digest) are one node, which Spark gives a number. Signatures of bands x rows_per_band coordinates (dart_minhash) give each node one key a
    band; nodes with a common key meet in a bucket, and a pair at 0.8 meets in one of the 25 default
    bands with probability 0.99995.

    First each bucket's members are compared with one of them, exactly, and links give components.
    Then, in each bucket, the nodes outside its largest component are compared exactly with all its nodes of
    other components, in blocks inside the tasks; pairs are never rows. So every two nodes of
    a bucket are compared, already connected, or too unequal in weight to be similar; no bucket is capped.

    Returns for each row: id (named ``id_col``), class_id (least id of its class), class_size
    (rows), kept (true for one row a class: its least id) and a struct ``payload`` of the named columns (if
    any). Texts without a word, null ones too, are classes of their own. Null ids come first. Of rows that repeat the least id and
    its words one is kept. An empty table gives an empty result.
    """
    need(docs, id_col, text_col, *(payload or []))
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    cols = [F.struct(*(F.col(f"`{c}`") for c in payload)).alias("payload")] if payload else []
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), *cols).withColumn("rid", F.monotonically_increasing_id())
    schema = rows.drop("text").schema.add("digest", "binary").add("weight", "long").add("bands", T.ArrayType(T.LongType()))
    sketch = table(rows.mapInArrow(_sketch(shingle_words, bands, rows_per_band), schema), "sketch")
    nodes = sketch.where("digest IS NOT NULL").groupBy("digest").agg(F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    nodes = table(few_files(nodes.withColumn("node", F.monotonically_increasing_id())), "nodes")
    member = nodes.select("node", "weight", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    member = table(few_files(member.join(shared, "bucket").select("bucket", "node", "weight")), "buckets")
    # one text for each node that meets another
    if payload and text_col in payload:
        named = sketch.where("digest IS NOT NULL").select("id", "digest", F.coalesce(F.col("payload")[text_col].cast("string"), F.lit("")).alias("text"))
    else:
        named = rows.select("id", "text").mapInArrow(_named, f"id {kind}, digest binary, text string")
    found = nodes.join(member.select("node").distinct(), "node", "left_semi").select("node", F.col("digest").alias("d"), F.col("id").alias("i"))
    texts = table(named.join(found, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("i"))).select("node", "text").dropDuplicates(["node"]), "texts")
    # round one: each bucket's members with one of them
    lead = member.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", "bucket").alias("h"), "node", "weight")).alias("lead"))
    pairs = member.join(lead.select("bucket", F.col("lead.node").alias("lead"), F.col("lead.weight").alias("lead_weight")), "bucket").where("node <> lead")
    # the smaller total weight over the larger is as much as the similarity can be
    pairs = pairs.where(F.least("weight", "lead_weight") >= F.greatest("weight", "lead_weight") * threshold)
    pairs = pairs.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    pairs = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    one = table(pairs.mapInArrow(_verify(shingle_words, threshold), "a long, b long, similarity double"), "verified")
    comp = components(one).select("node", "comp")
    # round two: what is still apart
    left = member.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    two = _in_blocks(left, texts, shingle_words, threshold)
    # its links join components; a node that had no link is a component of its own
    drop_table(texts)
    drop_table(member)
    joined = components(two.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct()).select("node", "comp")
    alone = joined.select("node").join(comp, "node", "left_anti").select("node", F.col("node").alias("comp"))
    wider = joined.select(F.col("node").alias("comp"), F.col("comp").alias("wider"))
    comp = table(few_files(comp.union(alone).join(wider, "comp", "left").select("node", F.coalesce("wider", "comp").alias("comp"))), "components")
    named = table(few_files(nodes.select("digest", "node", "n").join(comp, "node", "left").select("digest", F.coalesce("comp", "node").alias("class"), "n")), "classes")
    drop_table(nodes)
    seen = table(few_files(join_groups(sketch.select("id", "digest", "rid"), named, "digest", how="left").drop("n")), "near")
    for t in (one, two, comp, named):
        drop_table(t)
    sizes = seen.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("id", "digest", "rid")).alias("least"), F.count(F.lit(1)).alias("class_size"))
    result = join_groups(seen, table(few_files(sizes.where("class_size > 1").withColumn("n", F.col("class_size"))), "sizes"), "class", how="left")
    alone = F.col("class_size").isNull()
    result = result.select(
        "rid",
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("least.id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        (alone | F.coalesce(F.col("rid") == F.col("least.rid"), F.lit(False))).alias("kept"),
    )
    return few_files((result.join(sketch.select("rid", "payload"), "rid") if payload else result).drop("rid"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, digest, text)."""
    h = Hasher()
    for whole in batches:
        for batch in pieces(whole, "text"):
            data, at = utf8(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), texts_digests(data, *h.words(data, at)), batch.column("text")], ["id", "digest", "text"])


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params: object) -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, with all their columns."""
    kept = near_duplicates(docs, id_col, text_col, payload=docs.columns, **params).where("kept")
    return kept.select(*(F.col("payload")[c].alias(c) for c in docs.columns))
