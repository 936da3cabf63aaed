"""Vectorised work on the UTF-8 bytes of many texts at once, for the inside of Arrow functions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the polynomial hashes over n-grams of bytes and runs of words, and their inverses modulo
#: 2**64. Such a hash is blind to some long contents, so it serves short ones only, and names no equality that a result hangs on.
BYTE_P, WORD_P = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
CHUNK_BYTES = 1 << 20
#: Bytes of a word that are hashed eight at a time; a longer word is hashed on its own.
LANES = 64
#: Bytes of a digest that stands for a content.
DIGEST_BYTES = 16


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string or binary column; nulls are empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind).fill_null(b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``most`` bytes of text, so that memory is bounded
    by the longest text and not by the number of rows."""
    if not len(batch):
        return
    _, at = utf8(batch.column(column))
    row = 0
    while row < len(batch):
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


class Hasher:
    """Polynomial prefix hashes; powers are kept for the life of a task."""

    def __init__(self) -> None:
        # one fixed random value a byte
        self.of_byte = mix(np.arange(256, dtype=U64) + U64(77))
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def power(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        got = self.powers.get(base)
        if got is None or len(got[0]) < n:
            size = max(n, 1 << 16)
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(size, b, U64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            got = self.powers[base] = tuple(both)
        return got

    def prefix(self, values: np.ndarray, base: int) -> np.ndarray:
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.power(base, len(values) + 1)[0][: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
        """Hash of values[start:end]; equal contents hash alike wherever they stand."""
        inverse = self.power(base, len(prefix))[1]
        return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64))

    def words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and where each row's words begin in them."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        space = self.space[data]
        before, after = np.empty_like(space), np.empty_like(space)
        before[0], before[1:], after[-1], after[:-1] = True, space[:-1], True, space[1:]
        inner = at[(at > 0) & (at < len(data))]
        before[inner], after[inner - 1] = True, True
        starts = np.flatnonzero(~space & before)
        ends = np.flatnonzero(~space & after) + 1
        return starts, ends, np.searchsorted(starts, at)

    def word_hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each word. Words of up to eight bytes and one length never have the same."""
        size = ends - starts
        out = mix(size.astype(U64))
        lanes = np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
        long = size > LANES
        live = np.flatnonzero(~long)
        for at in range(0, LANES, 8):
            live = live[size[live] > at]
            if not len(live):
                break
            lane = lanes[starts[live] + at] & ~U64(0) >> (U64(8) * (8 - np.minimum(size[live] - at, 8)).astype(U64))
            out[live] = mix(out[live] ^ lane)
        for k in np.flatnonzero(long).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
        return out


def digest(raw: bytes | memoryview) -> bytes:
    """Contents with equal digests count as equal: no one can make two."""
    return hashlib.blake2b(raw, digest_size=DIGEST_BYTES).digest()


def equal_spans(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a and b hold the same ``size`` bytes from these places on, for each pair of places. Both have
    eight bytes to spare behind all spans."""
    one, other = (np.ndarray((len(x) - 7,), "<u8", x, strides=(1,)) for x in (a, b))
    same, live = np.ones(len(size), bool), np.arange(len(size))
    for at in range(0, LANES, 8):
        live = live[size[live] > at]
        if not len(live):
            return same
        unused = U64(8) * (8 - np.minimum(size[live] - at, 8)).astype(U64)
        same[live] &= (one[a_at[live] + at] ^ other[b_at[live] + at]) << unused == 0
    for k in live[size[live] > LANES].tolist():
        same[k] = np.array_equal(a[a_at[k] : a_at[k] + size[k]], b[b_at[k] : b_at[k] + size[k]])
    return same


def spaced_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all spans one after another, each with a space behind it, and where each one's space ends."""
    size = ends - starts + 1
    stop = np.cumsum(size)
    raw = data.take(np.arange(stop[-1]) - np.repeat(stop - size - starts, size), mode="clip")
    raw[stop - 1] = 32
    return raw, stop


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray, keep: np.ndarray | None = None) -> tuple[bytes, list[int], np.ndarray]:
    """The kept words (places in ``starts``; all by default) of all rows, those of a row joined by one
    space: the bytes one after another, the rows' offsets in them, and the rows' offsets in ``keep``."""
    keep = np.arange(len(starts)) if keep is None else keep
    words_at = np.searchsorted(keep, of)
    # each word but a row's last goes with the byte behind it, made a space
    last = np.zeros(len(keep), bool)
    last[words_at[1:][np.diff(words_at) > 0] - 1] = True
    stop = ends[keep] + ~last
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts[keep]] += 1
    np.add.at(inside, stop, -1)
    spaced = data.copy()
    spaced[ends[keep][~last]] = 32
    raw = spaced[np.cumsum(inside[:-1], dtype=np.int8) > 0].tobytes()
    return raw, np.concatenate([[0], np.cumsum(stop - starts[keep])])[words_at].tolist(), words_at


def rows_of(at: np.ndarray) -> np.ndarray:
    """The row of each element, from the rows' offsets."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))
