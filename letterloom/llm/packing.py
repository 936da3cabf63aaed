"""Best-fit packing of token pieces into sequences by exact-complement hashing."""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import Hasher, equal_spans, pieces, spaced_spans, utf8
from .common import need, table

END_ID = 1
#: Distinct runs of letters or marks whose ids a worker remembers, about, and the bytes of a run among them, on average.
KNOWN_WORDS, KNOWN_BYTES = 1 << 20, 16
#: Runs that go to the tokenizer in one text.
JOINED = 200
#: Bytes of text that a worker looks at together, about: what it needs meanwhile is many times as much.
LOOKED_AT = 1 << 18


def _grown(kept: np.ndarray, n: int, more: np.ndarray, spare: int = 0) -> np.ndarray:
    """The first ``n`` of ``kept`` and ``more`` behind them, in room that grows by a quarter, with some to spare."""
    least = n + len(more) + spare
    if least > len(kept):
        room = np.zeros(max(5 * len(kept) // 4, least), kept.dtype)
        room[:n] = kept[:n]
        kept = room
    kept[n : n + len(more)] = more
    return kept


class WordTokens:
    """Token ids of whole texts, unit by unit.

    For tokenizers that drop white space and split a word at least into its runs of letters and of
    ASCII marks. Units are those runs, or a whole word where it holds what may be split in other ways
    (digits, apostrophes, special tokens' marks, letters beyond Latin). Each distinct unit of a chunk
    is tokenized once, runs many to a text, and is remembered up to a bound. Units are found by their hash
    and compared byte by byte; one that only has the hash of another is tokenized on its own.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.id_type = np.min_scalar_type(len(self.closes) - 1)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.h = Hasher()
        # white space, marks and letters: 3 is what only a mark beside a letter gives by exclusive or
        self.kind, self.odd = np.where(self.h.space, 0, 1).astype(np.uint8), np.zeros(256, bool)
        self.kind[97:123] = self.kind[65:91] = self.kind[128:] = 2
        self.odd[:9] = self.odd[14:32] = self.odd[48:58] = self.odd[0xC6:] = True
        self.odd[[0xC2, 127, *b"'<|"]] = True
        self.forget()

    def forget(self) -> None:
        #: Numbers of units plus one, at their hash or the next free place behind it.
        self.table = np.zeros(1 << 16, np.int32)
        self.n, self.n_ids, self.n_bytes = 0, 0, 0
        self.key, self.flat, self.text = np.zeros(0, np.uint64), np.zeros(0, self.id_type), np.zeros(8, np.uint8)
        #: Where a unit's ids and its bytes, with a space behind them, begin; the next unit's begin where they end.
        self.begin, self.text_at = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def units(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends, whether they are runs, and the rows' offsets."""
        starts, ends, _ = self.h.words(data, at)
        odd = self.odd[data]
        # multiplication and division signs and the dotted capital I
        odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0xC4) & (data[1:] == 0xB0)
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(odd, out=total[1:])
        whole = total[ends] > total[starts]
        kind, cut, opens = self.kind[data], np.zeros(len(data), bool), np.zeros(len(data), bool)
        cut[1:] = kind[1:] ^ kind[:-1] == 3
        cut[starts] = opens[starts] = True
        begin = np.flatnonzero(cut)
        first = opens[begin]
        word = np.cumsum(first) - 1
        kept = first | ~whole[word]
        begin, word = begin[kept], word[kept]
        stop = np.minimum(np.append(begin[1:], len(data)), ends[word])
        return begin, stop, ~whole[word], np.searchsorted(begin, at)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The number of the unit with that hash, for each; -1 where there is none."""
        mask = np.uint64(len(self.table) - 1)
        place = (value & mask).astype(np.int64)
        number = self.table[place] - 1
        live = np.flatnonzero(number >= 0)
        while len(live := live[self.key[number[live]] != value[live]]):
            place[live] = (place[live] + 1) & int(mask)
            number[live] = self.table[place[live]] - 1
            live = live[number[live] >= 0]
        return number

    def place(self, first: int) -> None:
        """Puts the units from number ``first`` on into the table, which at most half fills."""
        if 2 * self.n > len(self.table):
            self.table, first = np.zeros(1 << (2 * self.n).bit_length(), np.int32), 0
        mask = len(self.table) - 1
        number = np.arange(first, self.n, dtype=np.int32) + 1
        place = (self.key[first : self.n] & np.uint64(mask)).astype(np.int64)
        while len(number):
            free = self.table[place] == 0
            # of several at one free place the last stays
            self.table[place[free]] = number[free]
            left = self.table[place] != number
            number, place = number[left], (place[left] + 1) & mask

    def encode(self, raw: bytes, stop: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after another, and how many each has. A unit ends with a space, at ``stop``; ``runs`` of them are runs, which come first."""
        ids, sizes = [], []
        of = lambda at: [e.ids for e in self.tokenizer.encode_batch_fast([raw[i : j - 1].decode() for i, j in pairwise(at)], add_special_tokens=False)]
        at = [0, *stop.tolist()]
        if runs:
            got = np.concatenate([np.array(x, np.uint32) for x in of([*at[:runs:JOINED], at[runs]])])
            close = np.flatnonzero(self.closes[got])
            if len(close) == runs:
                ids, sizes = [got], [np.diff(np.append(-1, close))]
            else:
                runs = 0
        if len(stop) > runs:
            each = of(at[runs:])
            ids.append(np.array([i for e in each for i in e], np.uint32))
            sizes.append(np.array([len(e) for e in each]))
        return np.concatenate(ids), np.concatenate(sizes)

    def learn(self, value: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Remembers units, of which the first of those with one hash counts, and gives the numbers of all."""
        _, first, inverse = np.unique(value, return_index=True, return_inverse=True)
        order = np.argsort(~run[first], kind="stable")
        number = np.empty(len(first), np.int64)
        number[order] = np.arange(self.n, self.n + len(first))
        new = first[order]
        raw, stop = spaced_spans(data, starts[new], ends[new])
        ids, size = self.encode(raw.tobytes(), stop, int(run[new].sum()))
        before = self.n
        self.key = _grown(self.key, before, value[new])
        self.begin, self.text_at = _grown(self.begin, before + 1, np.cumsum(size) + self.n_ids), _grown(self.text_at, before + 1, stop + self.n_bytes)
        self.flat, self.text = _grown(self.flat, self.n_ids, ids), _grown(self.text, self.n_bytes, raw, 8)
        self.n, self.n_ids, self.n_bytes = before + len(new), self.n_ids + len(ids), self.n_bytes + len(raw)
        self.place(before)
        return number[inverse]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the texts' offsets in them."""
        data, at = utf8(texts)
        starts, ends, run, of = self.units(data, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        value = self.h.word_hashes(data, starts, ends)
        if self.n > KNOWN_WORDS or self.n_bytes > KNOWN_BYTES * KNOWN_WORDS:
            self.forget()
        of_unit, long = self.find(value), ends - starts
        new = np.flatnonzero(of_unit < 0)
        if len(new):
            of_unit[new] = self.learn(value[new], data, starts[new], ends[new], run[new])
        # the same bytes as what the hash stands for
        same = long == self.text_at[of_unit + 1] - self.text_at[of_unit] - 1
        same[same] = equal_spans(np.append(data, np.zeros(8, np.uint8)), starts[same], self.text, self.text_at[of_unit[same]], long[same])
        flat, begin = self.flat, self.begin[of_unit]
        n = self.begin[of_unit + 1] - begin
        apart = np.flatnonzero(~same)
        if len(apart):
            raw, stop = spaced_spans(data, starts[apart], ends[apart])
            ids, size = self.encode(raw.tobytes(), stop, 0)
            begin[apart], n[apart] = np.cumsum(size) - size + self.n_ids, size
            flat = np.concatenate([flat[: self.n_ids], ids])
        stop = np.concatenate([[0], np.cumsum(n)])
        index = np.arange(stop[-1]) - np.repeat(stop[:-1] - begin, n)
        return flat[index], stop[of]


@lru_cache(maxsize=1)
def _kept_tokens(path: str, changed: int, size: int) -> WordTokens:
    return WordTokens(path)


def worker_tokens(path: str) -> WordTokens:
    """The tokenizer of that file with all that this process knows of it: a worker's next task does not begin anew."""
    now = os.stat(path)
    return _kept_tokens(path, now.st_mtime_ns, now.st_size)


def _tokenize(path: str, most: int, with_ids: bool) -> Callable:
    """Rows of pieces: their place in the document, digest and number among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tokens, seen = worker_tokens(path), np.zeros(most + 1, np.int64)
        for whole in batches:
            for batch in pieces(whole, "text", LOOKED_AT):
                ids, at = tokens.ids(batch.column("text"))
                total = np.diff(at) + 1
                n = -(-total // most)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * most
                length = np.minimum(total[row] - start, most)
                raw = np.insert(ids, at[1:], END_ID).astype("<u4")
                first = at[:-1][row] + row + start
                view = memoryview(raw.tobytes())
                crc = np.array([zlib.crc32(view[4 * i : 4 * (i + k)]) for i, k in zip(first.tolist(), length.tolist(), strict=True)], np.int64)
                order = np.argsort(length, kind="stable")
                same = np.searchsorted(length[order], length[order])
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - same
                nth += seen[length]
                seen += np.bincount(length, minlength=most + 1)
                cols = [batch.column("id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(nth), pa.array(np.full(len(row), part, np.int32))]
                names = ["id", "piece", "start", "length", "ids_crc32", "nth", "part"]
                if with_ids:
                    lists = [raw[i : i + k].astype(np.int32) for i, k in zip(first.tolist(), length.tolist(), strict=True)]
                    cols, names = [*cols, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def plan_packing(count: dict[int, int], most: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first, number, first sequence, offset): the pieces of a length numbered first
    to first + number - 1 go to as many sequences in a row, all at that offset.

    Works on counts of lengths alone, of which there are at most ``most``. From the longest down, a
    piece's gap is looked up among the lengths, then the sums of two and of three lengths that are
    still there; the first combination whose counts allow it (the piece's own length included) is
    consumed as often as they do. Pieces without an exact filling go, longest first, to the open sequence with the least gap that holds them.
    """
    left = {k: n for k, n in count.items() if n > 0}
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def take(parts: list[int], times: int, at: int, offset: int) -> None:
        for p in parts:
            runs.append((p, used[p], times, at, offset))
            used[p] += times
            left[p] -= times
            offset += p

    def times_of(parts: list[int]) -> int:
        return min(left.get(p, 0) // parts.count(p) for p in set(parts))

    # the index of sums: which lengths are there; a bit set of them, and its mirror image, whose overlap
    # at a shift are all pairs with that sum
    here, mirror = 0, 0
    for k in left:
        here, mirror = here | 1 << k, mirror | 1 << (most - k)

    def gone(parts: list[int]) -> None:
        nonlocal here, mirror
        for p in parts:
            if left[p] <= 0:
                here, mirror = here & ~(1 << p), mirror & ~(1 << (most - p))

    def bits(x: int) -> Iterator[int]:
        """Set bits, the highest first."""
        while x:
            top = x.bit_length() - 1
            yield top
            x ^= 1 << top

    def pairs(total: int) -> Iterator[list[int]]:
        """Present lengths a >= b with that sum, the most unequal first."""
        both = here & (mirror >> (most - total) if total <= most else 0)
        for a in bits(both >> (total + 1) // 2 << (total + 1) // 2):
            yield [a, total - a]

    def filling(length: int, gap: int) -> list[int] | None:
        """The first single, pair or triple that fills the gap with what is there besides ``length``."""
        fits = lambda parts: times_of([length, *parts]) > 0
        if here >> gap & 1 and fits([gap]):
            return [gap]
        for two in pairs(gap) if gap > 1 else ():
            if fits(two):
                return two
        for a in bits(here & ((1 << gap) - 1)) if gap > 2 else ():
            if 3 * a < gap:
                break
            for two in pairs(gap - a) if gap - a > 1 else ():
                if two[0] <= a and fits([a, *two]):
                    return [a, *two]
        return None

    rest: dict[int, int] = {}
    for length in sorted(left, reverse=True):
        while left[length] > 0:
            found = [] if length == most else filling(length, most - length)
            if found is None:
                # no exact filling for this length now: all of it waits for best fit
                rest[length] = left[length]
                left[length] = 0
                gone([length])
                break
            parts = [length, *found]
            n = times_of(parts)
            take(parts, n, sequence, 0)
            gone(parts)
            sequence += n

    # best fit by counts: open sequences by gap, each kind a list of [first, number]
    gaps: list[int] = []
    open_: dict[int, list[list[int]]] = {}
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            i = bisect.bisect_left(gaps, length)
            if i < len(gaps):
                gap = gaps[i]
                first, number = open_[gap][-1]
                k = min(n, number)
                if k == number:
                    open_[gap].pop()
                    if not open_[gap]:
                        del open_[gap]
                        gaps.pop(i)
                else:
                    open_[gap][-1] = [first + k, number - k]
            else:
                gap, first, k = most, sequence, n if 2 * length > most else -(-n // (most // length))
                sequence += k
            runs.append((length, used[length], k, first, most - gap))
            used[length] += k
            n -= k
            if gap > length:
                if gap - length not in open_:
                    open_[gap - length] = []
                    bisect.insort(gaps, gap - length)
                open_[gap - length].append([first, k])
    return runs


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", most: int = 4096, with_ids: bool = False) -> DataFrame:
    """Packs the token ids of all texts, each followed by id 1, into sequences of at most ``most``.

    Longer documents are cut into pieces of ``most``. The driver gets the number of pieces of each
    length (``most`` numbers however many documents there are) and plans by exact-complement hashing
    (plan_packing); the plan is a list of runs of a length, bounded by ``most`` too, and each piece finds its
    run by its number among the pieces of its length: its number in its task, plus those of the tasks before.

    ``tokenizer`` is the path of a tokenizers file that drops white space and never joins words.
    Returns a row for each piece: id (named ``id_col``), piece, start, length, ids_crc32,
    sequence_id, offset and, ``with_ids``, the ids. Null and empty texts are the one id 1. Null ids
    and repeated rows are documents like any other. An empty table gives an empty result.
    """
    need(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, nth long, part int" + ", ids array<int>" * with_ids
    found = table(rows.mapInArrow(_tokenize(tokenizer, most, with_ids), schema), "pieces")
    per = found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    # at most ``most`` rows
    counts = {r[0]: r[1] for r in found.groupBy("length").agg(F.count(F.lit(1))).collect()}
    runs = plan_packing(counts, most)
    plan = docs.sparkSession.createDataFrame([(int(a), int(b), int(b + c), int(d), int(e)) for a, b, c, d, e in runs], "length long, from long, to long, sequence long, offset long")
    plan = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("from", "to", "sequence", "offset"))).alias("runs"))
    numbered = found.join(before, ["length", "part"]).withColumn("nth", F.col("nth") + F.col("before")).drop("part", "before")
    # the plan's size is bounded by the sequence length, not by the documents
    placed = numbered.join(F.broadcast(plan), "length")
    run = F.get(F.filter("runs", lambda r: (r["from"] <= F.col("nth")) & (F.col("nth") < r["to"])), F.lit(0))
    placed = placed.withColumn("run", run)
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("run.sequence") + F.col("nth") - F.col("run.from")).alias("sequence_id"), F.col("run.offset").alias("offset"), *(["ids"] if with_ids else [])
    )
