"""Substring dedup by recompression: words that repeat an earlier run of words are removed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import U64, Hasher, digest, joined_words, mix, pieces, rows_of, utf8
from .common import need

PAIR_ROUNDS = 3
#: How a segment is packed into a long: hash of its text, first word, number of windows.
TEXT_BITS, START_BITS, COUNT_BITS = 20, 36, 7
#: Rows that are settled among themselves before they are sent, about.
SETTLE_ROWS = 1 << 20
#: One in so many texts is looked at to find anchors that are too frequent for one task.
HOT_SAMPLE = 64


class Parse:
    """The symbols of a chunk of texts after one naming of runs and some of pairs.

    A name is a 64-bit function of what it stands for, so every task gives equal runs of words equal
    names without asking another. Names in the interior of a repeated run of words depend on that run
    alone: a run of equal words is closed by its neighbours, and two symbols become a pair if their
    names' classes are left and right, whatever stands beside them.
    """

    def __init__(self, h: Hasher, names: np.ndarray, at: np.ndarray, rounds: int = PAIR_ROUNDS) -> None:
        n = len(names)
        row = rows_of(at)
        # runs of equal words
        new = np.ones(n, bool)
        new[1:] = (names[1:] != names[:-1]) | (row[1:] != row[:-1])
        start = np.flatnonzero(new)
        self.run_of = np.cumsum(new) - 1
        length = np.diff(np.append(start, n))
        sym = mix(names[start] + mix(length.astype(U64)))
        row = row[start]
        self.levels = []
        for k in range(rounds):
            right = (mix(sym + U64(1000 + k)) >> U64(63)).astype(bool)
            second = np.zeros(len(sym), bool)
            second[1:] = right[1:] & ~right[:-1] & (row[1:] == row[:-1])
            to = np.cumsum(~second) - 1
            self.levels.append((right, to))
            first = np.flatnonzero(~second)
            paired = np.zeros(len(first), bool)
            paired[to[second]] = True
            nxt = np.minimum(first + 1, len(sym) - 1)
            sym = np.where(paired, mix(sym[first] * U64(0x9FB21C651E98DF25) + mix(sym[nxt] + U64(k))), sym[first])
            row, start = row[first], start[first]
        self.sym, self.start, self.end = sym, start, np.append(start[1:], n)

    def interior(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For runs of words first..last (inclusive): the symbols [lo, hi) whose names follow from
        those words alone. The symbols at either end that a neighbour could change are left out."""
        lo, hi = self.run_of[first] + 1, self.run_of[last]
        for right, to in self.levels:
            some = lo < hi
            top = len(right) - 1
            lo = lo + (some & right[np.minimum(lo, top)])
            some = lo < hi
            hi = hi - (some & ~right[np.clip(hi - 1, 0, top)])
            some = lo < hi
            lo, hi = np.where(some, to[np.minimum(lo, top)], 0), np.where(some, to[np.clip(hi - 1, 0, top)] + 1, 0)
        return lo, hi

    def longest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The leftmost of the symbols in [lo, hi) that span most words (ties by name); -1 if none."""
        worth = ((self.end - self.start).clip(0, 255).astype(U64) << U64(56)) | (self.sym >> U64(8))
        size = hi - lo
        out = np.full(len(lo), -1)
        best, width = np.arange(len(self.sym)), 1
        while len(size) and width <= size.max(initial=0):
            take = np.flatnonzero((size >= width) & (size < 2 * width))
            a, b = best[lo[take]], best[hi[take] - width]
            out[take] = np.where(worth[a] >= worth[b], a, b)
            if len(best) > width:
                a, b = best[:-width], best[width:]
                best = np.where(worth[a] >= worth[b], a, b)
            width *= 2
        return out


class _Words:
    """Words of a chunk of texts, and digests of runs of them (joined by one space)."""

    def __init__(self, h: Hasher, batch: pa.RecordBatch) -> None:
        self.data, at = utf8(batch.column("text"))
        self.starts, self.ends, self.of = h.words(self.data, at)
        self.raw, to, _ = joined_words(self.data, self.starts, self.ends, self.of)
        row = rows_of(self.of)
        size = self.ends - self.starts
        # a row's words have one byte between them, rows have none
        self.at = np.cumsum(size + 1) - (size + 1) - row_gaps(self.of)[row]
        self.to = self.at + size

    def digests(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the words first..last (inclusive): two numbers for each."""
        view = memoryview(self.raw)
        both = b"".join([digest(view[i:j]) for i, j in zip(self.at[first].tolist(), self.to[last].tolist(), strict=True)])
        return np.frombuffer(both, np.int64).reshape(-1, 2)


def row_gaps(of: np.ndarray) -> np.ndarray:
    """How many rows with words lie before each row."""
    some = np.diff(of) > 0
    return np.cumsum(some) - some


def _windows(h: Hasher, batch: pa.RecordBatch, size: int) -> dict:
    """Words, windows and each window's anchor of a chunk of texts."""
    w = _Words(h, batch)
    counts = np.maximum(np.diff(w.of) - size + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    begin = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(begin[-1]) - begin[:-1][row] + w.of[:-1][row]
    out = {"words": w, "of": w.of, "row": row, "first": first}
    if len(first):
        names = h.word_hashes(w.data, w.starts, w.ends)
        parse = Parse(h, names, w.of)
        anchor = parse.longest(*parse.interior(first, first + size - 1))
        none = anchor < 0
        out["anchor_at"] = np.where(none, -1 - first, anchor)
        name = parse.sym[anchor]
        # a window without interior has few different words, and goes where its words' names say
        whole = np.zeros(none.sum(), U64)
        for k in range(size if none.any() else 0):
            whole = mix(whole ^ names[first[none] + k])
        name[none] = whole
        out["anchor"] = name
    return out


def _settled(batches: list[pa.RecordBatch], hot: np.ndarray) -> pa.RecordBatch:
    """Rows to send. Of those with equal words only the first need meet others; the rest are surely
    not the first anywhere, and are sent wherever their place falls. Rows of a hot anchor are dealt out by their words."""
    t = pa.Table.from_batches(batches).combine_chunks()
    rank = pc.rank(t.column("id"), null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    anchor, seg, seg2, place = (t.column(c).to_numpy() for c in ("anchor", "seg", "seg2", "place"))
    start = (place >> COUNT_BITS) & ((1 << START_BITS) - 1)
    order = np.lexsort((start, rank, seg2, seg))
    differs = (seg[order][1:] != seg[order][:-1]) | (seg2[order][1:] != seg2[order][:-1])
    new = np.flatnonzero(np.append(True, differs))
    first = np.repeat(order[new], np.diff(np.append(new, len(order))))
    sure = np.zeros(len(order), bool)
    sure[order] = (rank[order] != rank[first]) | (start[order] != start[first])
    is_hot = np.isin(anchor, hot)
    by = np.where(sure, place, np.where(is_hot, anchor ^ seg, anchor))
    return pa.RecordBatch.from_arrays([pa.array(by), *(t.column(c).combine_chunks() for c in ("anchor", "seg", "seg2", "id", "place")), pa.array(sure), pa.array(is_hot)], ["by", "anchor", "seg", "seg2", "id", "place", "sure", "hot"])


def _in_runs(found: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Settles about SETTLE_ROWS rows at a time."""
    some: list[pa.RecordBatch] = []
    for batch in found:
        some.append(batch)
        if sum(map(len, some)) >= SETTLE_ROWS:
            yield _settled(some, hot)
            some = []
    if some:
        yield _settled(some, hot)


def _rows(batch: pa.RecordBatch, row: np.ndarray, anchor: np.ndarray, seg: np.ndarray, start: np.ndarray, n: np.ndarray | int) -> pa.RecordBatch:
    place = (batch.column("low").to_numpy()[row] << (START_BITS + COUNT_BITS)) | (start << COUNT_BITS) | n
    columns = [pa.array(anchor), pa.array(seg[:, 0]), pa.array(seg[:, 1]), batch.column("id").take(pa.array(row)), pa.array(place)]
    return pa.RecordBatch.from_arrays(columns, ["anchor", "seg", "seg2", "id", "place"])


def _segments(size: int, hot: np.ndarray) -> Callable:
    """Rows of runs of windows with one anchor, and the digest of all their words."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        for whole in batches:
            for batch in pieces(whole, "text"):
                w = _windows(h, batch, size)
                if not len(w["first"]):
                    continue
                first, row = w["first"], w["row"]
                new = np.ones(len(first), bool)
                new[1:] = (w["anchor_at"][1:] != w["anchor_at"][:-1]) | (row[1:] != row[:-1])
                a = np.flatnonzero(new)
                b = np.append(a[1:], len(first)) - 1
                yield _rows(batch, row[a], w["anchor"][a].view(np.int64), w["words"].digests(first[a], first[b] + size - 1), first[a] - w["of"][row[a]], b - a + 1)

    return lambda batches: _in_runs(found(batches), hot)


def _anchors(size: int) -> Callable:
    """The anchors of all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        for whole in batches:
            for batch in pieces(whole, "text"):
                w = _windows(h, batch, size)
                if len(w["first"]):
                    new = np.append(True, (w["anchor_at"][1:] != w["anchor_at"][:-1]) | (w["row"][1:] != w["row"][:-1]))
                    yield pa.RecordBatch.from_arrays([pa.array(w["anchor"][new].view(np.int64))], ["anchor"])

    return run


def _unsettled(size: int) -> Callable:
    """Rows of the single windows in the segments that are named."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        for whole in batches:
            for batch in pieces(whole, "text"):
                w = _Words(h, batch)
                open_ = batch.column("open")
                place, row = open_.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(batch)), np.diff(open_.offsets.to_numpy()))
                own = place >> (START_BITS + COUNT_BITS) == batch.column("low").to_numpy()[row]
                place, row = place[own], row[own]
                n, start = place & ((1 << COUNT_BITS) - 1), (place >> COUNT_BITS) & ((1 << START_BITS) - 1)
                k = np.repeat(np.arange(len(n)), n)
                begin = start[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                first = w.of[:-1][row[k]] + begin
                win = w.digests(first, first + size - 1)
                yield _rows(batch, row[k], win[:, 0], win, begin, 1)

    return lambda batches: _in_runs(found(batches), np.zeros(0, np.int64))


def _kept(size: int, with_text: bool) -> Callable:
    """Rows of the result, from texts and their lists of removed windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        for whole in batches:
            for batch in pieces(whole, "text"):
                data, at = utf8(batch.column("text"))
                starts, ends, of = h.words(data, at)
                gone = batch.column("gone")
                row, place = np.repeat(np.arange(len(batch)), np.diff(gone.offsets.to_numpy())), gone.flatten().to_numpy(zero_copy_only=False)
                own = place >> (START_BITS + COUNT_BITS) == batch.column("low").to_numpy()[row]
                row, place = row[own], place[own]
                begin = of[:-1][row] + ((place >> COUNT_BITS) & ((1 << START_BITS) - 1))
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + (place & ((1 << COUNT_BITS) - 1)) - 1 + size, -1)
                keep = np.flatnonzero(np.cumsum(edge)[:-1] <= 0)
                raw, to, words_at = joined_words(data, starts, ends, of, keep)
                texts = [raw[i:j] for i, j in zip(to[:-1], to[1:], strict=True)]
                cols = [batch.column("id"), pa.array(np.diff(of)), pa.array(np.diff(of) - np.diff(words_at)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                names = ["id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    cols, names = [*cols, pa.array([t.decode() for t in texts], pa.string())], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _hot_anchors(rows: DataFrame, size: int, parts: int) -> np.ndarray:
    """Anchors that have more segments than an even share of a task, judged by a sample of texts: at most ``parts``."""
    some = rows.where(F.pmod("key", F.lit(HOT_SAMPLE)) == 0).select("text").mapInArrow(_anchors(size), "anchor long")
    counts = some.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    # no more rows than tasks by what is asked of them
    share = counts.agg(F.sum("n").alias("all"))
    hot = counts.join(F.broadcast(share), (F.col("n") * parts > F.col("all")) & (F.col("n") >= 8)).select("anchor").toArrow()
    return hot.column("anchor").to_numpy()


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, with_text: bool = True) -> DataFrame:
    """Removes each word that lies in ``window`` consecutive words which also start earlier
    (in a smaller id, or in the same document at an earlier word).

    Each text is parsed by recompression (class Parse). A window's anchor is the longest symbol in
    its interior, so equal windows have equally named anchors; a window without interior (a long run
    of one word) is its own anchor. Round one settles whole segments (neighbouring windows with one
    anchor): of segments with equal words all but the first are removed. Where segments
    share an anchor and differ, round two settles their single windows alike. What a later one in
    the same run of texts shows is settled there, so a common passage sends one row a run to its anchor.
    Names only bring together what may be equal: words count as equal by a 128-bit digest of their bytes.

    Anchors that would bring more than a task's share of all segments together are found on one text in
    HOT_SAMPLE. Their segments are dealt out by their words instead, and all windows of those that are
    first go on to round two, which deals out windows by their words anyway. This changes the plan, not the result.
    Texts are sent once, to their row's place, and read there by all rounds; anchors are sent once.

    Returns for each row: id (named ``id_col``), n_words, n_removed, kept_sha256 and, ``with_text``,
    kept_text (kept words joined by one space). Null texts have no words. A null id counts as smaller
    than all others. Rows that repeat an id and text count as one document, so none of them is earlier
    than another. An empty table gives an empty result; other columns are not read.
    """
    need(docs, id_col, text_col)
    if not 1 <= window < 1 << (COUNT_BITS - 1):
        raise ValueError(f"window: 1 to {(1 << (COUNT_BITS - 1)) - 1}")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).bitwiseAND((1 << TEXT_BITS) - 1).alias("low"))
    rows = rows.withColumn("key", F.xxhash64("id", "low"))
    hot = _hot_anchors(rows, window, parts)
    rows = rows.repartition(parts, "key")
    places = f"by long, anchor long, seg long, seg2 long, id {kind}, place long, sure boolean, hot boolean"
    key = F.xxhash64("id", F.shiftright("place", START_BITS + COUNT_BITS)).alias("key")

    def earlier(found: DataFrame) -> tuple[DataFrame, Column]:
        """Whether a row has an equal one before it."""
        start = F.shiftright("place", COUNT_BITS).bitwiseAND((1 << START_BITS) - 1)
        at = F.struct("id", start.alias("start"))
        return found.repartition(parts, "by"), F.col("sure") | (F.min(at).over(Window.partitionBy("by", "seg", "seg2")) < at)

    one, before = earlier(rows.mapInArrow(_segments(window, hot), places))
    # one that has none, and whose anchor has other words too
    alike = Window.partitionBy("by")
    other = F.col("hot") | (F.min("seg").over(alike) != F.max("seg").over(alike)) | (F.min("seg2").over(alike) != F.max("seg2").over(alike))
    one = one.select("id", "place", before.alias("before"), other.alias("other")).where("before OR other")
    one = one.groupBy(key).agg(F.collect_list(F.when(F.col("before"), F.col("place"))).alias("gone"), F.collect_list(F.when(~F.col("before"), F.col("place"))).alias("open"))
    again = rows.join(one.where(F.size("open") > 0).hint("shuffle_hash"), "key").select("id", "text", "low", "open")
    two, before = earlier(again.mapInArrow(_unsettled(window), places))
    two = two.select("id", "place", before.alias("before")).where("before").groupBy(key).agg(F.collect_list("place").alias("gone2"))
    none = F.array().cast("array<bigint>")
    all_ = rows.join(one.hint("shuffle_hash"), "key", "left").join(two.hint("shuffle_hash"), "key", "left")
    all_ = all_.select("id", "text", "low", F.concat(F.coalesce("gone", none), F.coalesce("gone2", none)).alias("gone"))
    out = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return all_.mapInArrow(_kept(window, with_text), out).withColumnRenamed("id", id_col)
