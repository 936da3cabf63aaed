"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import need, table

#: Most entries of a block and most queries that meet it in one task.
BLOCK_ENTRIES, BLOCK_QUERIES = 4096, 4096


@dataclass(frozen=True)
class MultiIndex:
    """Centroids of either half of the vectors: two arrays (k, half)."""

    first: np.ndarray
    second: np.ndarray

    @property
    def k(self) -> int:
        return len(self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        cut = self.first.shape[1]
        return _nearest(x[:, :cut], self.first) * self.k + _nearest(x[:, cut:], self.second)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T - 0.5 * (centroids**2).sum(axis=1)).argmax(axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """At most k centroids; repeated points count once."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        for d in range(x.shape[1]):
            c[:, d] = np.where(n > 0, np.bincount(at, x[:, d], len(c)) / np.maximum(n, 1), c[:, d])
    return c


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, want: int) -> tuple[list[int], float]:
    """The multi-sequence algorithm: pairs of centroids by increasing sum of two distances, by a
    heap that holds only the frontier, until their cells hold ``want`` entries. Empty cells are passed.
    Returns the cells and the last sum: a cell is among them if its sum is no larger."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db, k = first[a].tolist(), second[b].tolist(), len(second)
    a, b = a.tolist(), b.tolist()
    heap, out, got, last = [(da[0] + db[0], 0, 0)], [], 0, -np.inf
    while heap and got < want:
        last, i, j = heapq.heappop(heap)
        cell = a[i] * k + b[j]
        if counts[cell]:
            out.append(cell)
            got += int(counts[cell])
        # row i goes on to j + 1; row i + 1 begins once row i has begun
        if j + 1 < k:
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
    return out, last


def chain(centroids: np.ndarray) -> np.ndarray:
    """An order in which each centroid is followed by the nearest of those that are left."""
    left, out = np.arange(1, len(centroids)), [0]
    while len(left):
        k = int(((centroids[left] - centroids[out[-1]]) ** 2).sum(axis=1).argmin())
        out.append(int(left[k]))
        left = np.delete(left, k)
    return np.array(out)


def lay_out(index: MultiIndex, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each cell and how many blocks it takes. Blocks hold about BLOCK_ENTRIES; cells
    that follow each other have near centroids, so a query's cells lie in few blocks."""
    order, turn = [], chain(index.second)
    for n, i in enumerate(chain(index.first).tolist()):
        order.append(i * index.k + (turn if n % 2 == 0 else turn[::-1]))
    split = np.maximum(-(-counts // BLOCK_ENTRIES), 1)
    block, filled, now = np.zeros(len(counts), np.int64), 0, 0
    for cell in np.concatenate(order).tolist():
        n = int(counts[cell])
        if filled and filled + n > BLOCK_ENTRIES:
            now, filled = now + 1, 0
        block[cell] = now
        filled += n
        if split[cell] > 1:
            now, filled = now + int(split[cell]), 0
    return block, split


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of pairs of rows, in double precision, added in order of the dimensions: the same for equal
    vectors wherever they stand."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vec) of the vectors that take part, each once, and their dimension: the most frequent
    one, the larger if equal. Null and zero vectors, null or non-finite components take no part."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(fine, F.lit(False)) & F.exists("vec", lambda x: x != 0))
    dims = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("vec") == (dims[0] if dims else 0)), dims[0] if dims else 0


def fit_index(rows: DataFrame, dim: int, centroids: int, sample_rows: int = 16_384, top: int = 20, recall: float = 0.93) -> tuple[MultiIndex, float]:
    """Centroids from the ``sample_rows`` vectors whose id has the least hash, and the share of all
    entries that a query has to visit (share_to_visit on that sample)."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vec").toArrow().column("vec").combine_chunks()
    got = got.chunk(0) if isinstance(got, pa.ChunkedArray) else got
    x = got.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    cut = max(dim // 2, 1)
    second = x[:, cut:] if dim > 1 else np.zeros((len(x), 1))
    index = MultiIndex(k_means(x[:, :cut], centroids), k_means(second, centroids))
    return index, share_to_visit(index, np.concatenate([x[:, :cut], second], axis=1), top, recall)


def share_to_visit(index: MultiIndex, x: np.ndarray, top: int, recall: float, queries: int = 256) -> float:
    """The share of entries in the lists up to the one that holds a true neighbour, by the traversal's
    order: the ``recall`` quantile over the ``top`` nearest of the first ``queries`` vectors among all of
    ``x``. Vectors that form clusters need a small share, vectors without any structure a large one. In a
    sample the nearest are farther away than in the whole table, so the share is rather too large."""
    if len(x) < 2:
        return 1.0
    q, cut = x[:queries], index.first.shape[1]
    score = q @ x.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    keep = min(top, len(x) - 1)
    nearest = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
    cells = index.cells(x)
    counts = np.bincount(cells, minlength=len(index.first) * index.k)
    needs = []
    for r in range(len(q)):
        near = ((index.first @ q[r, :cut])[:, None] + index.second @ q[r, cut:]).reshape(-1)
        order = np.argsort(-near, kind="stable")
        visited = np.empty(len(order))
        visited[order] = np.cumsum(counts[order])
        needs.append(visited[cells[nearest[r]]])
    return float(np.quantile(np.concatenate(needs), recall)) / len(x)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _assign(index: MultiIndex, dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"), dim)
            x = x if dim > 1 else np.concatenate([x, np.zeros_like(x)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(index.cells(x).astype(np.int32))], ["id", "vec", "cell"])

    return run


def _route(index: MultiIndex, dim: int, counts: np.ndarray, block: np.ndarray, split: np.ndarray, want: int) -> Callable:
    """A row for each query and block that it visits, and the last sum of distances of its way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = index.first.shape[1]
        for batch in batches:
            x = _matrix(batch.column("vec"), dim)
            x = x if dim > 1 else np.concatenate([x, np.zeros_like(x)], axis=1)
            # nearness is the inner product: the larger, the smaller the distance
            one, two = -(x[:, :cut] @ index.first.T), -(x[:, cut:] @ index.second.T)
            rows, blocks, reach = [], [], []
            for r in range(len(x)):
                cells, last = traverse(one[r], two[r], counts, want)
                first, n = block[cells], split[cells]
                mine = np.unique(np.concatenate([first[n == 1], *(np.arange(f, f + k) for f, k in zip(first[n > 1].tolist(), n[n > 1].tolist(), strict=True))]))
                rows.append(np.full(len(mine), r))
                blocks.append(mine)
                reach.append(np.full(len(mine), last))
            take = pa.array(np.concatenate(rows or [np.zeros(0, np.int64)]))
            both = [pa.array(np.concatenate(blocks or [np.zeros(0, np.int64)])), pa.array(np.concatenate(reach or [np.zeros(0)]))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("vec").take(take), *both], ["id", "vec", "block", "reach"])

    return run


def scores(index: MultiIndex, q: np.ndarray, reach: np.ndarray, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Inner products of each query with the entries (sorted by cell) of the cells on its way, -inf for the
    others: only those are multiplied, a cell's entries at once with all queries that come by."""
    cut = index.first.shape[1]
    if q.shape[1] == 1:
        q, x = (np.concatenate([m, np.zeros_like(m)], axis=1) for m in (q, x))
    kinds, at = np.unique(cell, return_index=True)
    far = -(q[:, :cut] @ index.first[kinds // index.k].T) - q[:, cut:] @ index.second[kinds % index.k].T
    # the same sums as on the way, but for rounding
    wanted = far <= (reach + 1e-9 * (np.abs(reach) + 1))[:, None]
    out = np.full((len(q), len(x)), -np.inf)
    for c, (a, b) in enumerate(zip(at.tolist(), [*at[1:].tolist(), len(cell)], strict=True)):
        rows = np.flatnonzero(wanted[:, c])
        if len(rows):
            out[rows, a:b] = q[rows] @ x[a:b].T
    return out


def _rerank(index: MultiIndex, top: int) -> Callable:
    def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"key": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "scored": pd.Series(dtype="int64")})
        if not len(entries) or not len(queries):
            return none
        entries = entries.sort_values(["cell", "id"], kind="stable")
        x, ids, cell = np.stack(entries.vec.to_numpy()), entries.id.to_numpy(), entries.cell.to_numpy()
        q, qid, qkey, reach = np.stack(queries.vec.to_numpy()), queries.id.to_numpy(), queries.key.to_numpy(), queries.reach.to_numpy()
        lengths = np.sqrt((q**2).sum(axis=1)) * np.sqrt((x**2).sum(axis=1)).max()
        out_q, out_v, out_s, out_n = [], [], [], []
        keep = min(top, len(x))
        for a in range(0, len(q), 256):
            asking = np.arange(a, min(a + 256, len(q)))
            # a quick product finds who may be among the best; the exact measure orders those
            score = scores(index, q[asking], reach[asking], x, cell)
            n = (score > -np.inf).sum(axis=1)
            score[qid[asking][:, None] == ids[None, :]] = -np.inf
            least = np.partition(score, len(x) - keep, axis=1)[:, len(x) - keep]
            row, entry = np.nonzero((score >= (least - 1e-12 * lengths[asking] - 1e-300)[:, None]) & (score > -np.inf))
            out_q.append(asking[row])
            out_v.append(ids[entry])
            out_s.append(inner_products(q[asking[row]], x[entry]))
            out_n.append(n[row])
        qs, vs, ss, ns = map(np.concatenate, (out_q, out_v, out_s, out_n))
        order = np.lexsort((vs, -ss, qs))
        qs, vs, ss, ns = qs[order], vs[order], ss[order], ns[order]
        start = np.searchsorted(qs, qs)
        good = np.arange(len(qs)) - start < top
        # how much was scored in this block is told once for a query
        first = np.arange(len(qs)) == start
        return pd.DataFrame({"key": qkey[qs[good]], "query_id": qid[qs[good]], "vec_id": vs[good], "score": ss[good], "scored": np.where(first, ns, 0)[good]})

    return run


def centroids_for(rows: int) -> int:
    """Centroids a half: the square root of a twelfth of the rows, so that cells hold about twelve vectors and a
    query's way is not longer than its entries, and 128 from 200,000 vectors on."""
    return int(min(128, max(4, np.ceil(np.sqrt(rows / 12)))))


def search(
    vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 20, centroids: int | None = None, sample_rows: int = 16_384, share: float | None = None, recall: float = 0.93, with_scored: bool = False
) -> DataFrame:
    """The ``top`` vectors with the largest inner product for each row that ``queries`` selects.

    Both halves of the vectors are quantised by k-means centroids of their own (centroids_for the table,
    unless given), fitted on at most ``sample_rows`` vectors; every vector is in the inverted list of its pair of
    centroids. A query goes through the pairs by increasing summed distance (the negative inner products of its
    halves with the centroids) until their lists hold ``share`` of all vectors (``top`` at least), and only these entries
    are scored, exactly. Without a given share it is the one by which ``recall`` of the true neighbours are met in
    the sample (share_to_visit). Lists are laid out in blocks of about BLOCK_ENTRIES with near centroids, long
    lists cut into several and blocks that many queries visit served by several tasks, so no task gets an unbounded
    group; queries meet entries in blocks and only their best ``top`` leave one.

    Returns query_id, rank (from 1), vec_id, score and, ``with_scored``, the entries that were scored for
    the query; ties go to the smaller vec_id. ``queries`` is a condition on the column ``id``. A query's own id is no
    candidate. Rows without an id, null or zero vectors, those with null or non-finite components
    or with another dimension than most take no part; rows that repeat id and vector count once. Ids
    with several vectors are asked and found with each of them. An empty table gives an empty result.
    """
    need(vectors, id_col, vec_col)
    spark = vectors.sparkSession
    rows, dim = usable(vectors, id_col, vec_col)
    none = "query_id long, rank int, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], none)
    rows = rows.dropDuplicates(["id", "vec"])
    index, measured = fit_index(rows, dim, centroids or centroids_for(rows.count()), sample_rows, top, recall)
    entries = table(rows.mapInArrow(_assign(index, dim), "id long, vec array<double>, cell int"), "lists")
    # at most centroids squared numbers
    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    for cell, n in entries.groupBy("cell").count().collect():
        counts[cell] = n
    block, split = lay_out(index, counts)
    share = measured if share is None else share
    want = int(min(max(np.ceil(share * counts.sum()), top + 1), counts.sum()))
    places = spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(counts), dtype=np.int32), "first": block, "split": split}))
    # centroids squared rows at most
    laid = entries.join(F.broadcast(places), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("split"))).select("id", "vec", "cell", "block")
    # a query's way through the pairs is work of its own, however few bytes its row has: queries are dealt out to all tasks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asking = entries.where(queries).select("id", "vec").repartition(parts, F.xxhash64("id", "vec"))
    routes = asking.mapInArrow(_route(index, dim, counts, block, split, want), "id long, vec array<double>, block long, reach double")
    routes = table(routes.withColumn("key", F.xxhash64("vec")), "routes")
    served = routes.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("tasks"))
    laid = laid.join(served, "block").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)))
    routes = routes.join(served, "block").withColumn("task", F.pmod(F.xxhash64("id", "key"), F.col("tasks")))
    found = (
        laid.select("id", "vec", "cell", "block", "task")
        .groupBy("block", "task")
        .cogroup(routes.select("id", "vec", "reach", "key", "block", "task").groupBy("block", "task"))
        .applyInPandas(_rerank(index, top), "key long, query_id long, vec_id long, score double, scored long")
    )
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    scored = [F.sum("scored").over(Window.partitionBy("query_id", "key")).alias("scored")] if with_scored else []
    found = found.select("query_id", rank.alias("rank"), "vec_id", "score", *scored)
    return found.where(F.col("rank") <= top)
