"""Words of whole Arrow batches as numpy arrays.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. UTF-8 never uses those bytes inside a character, so byte runs are character runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes of text handled at once; bounds the memory of the arrays below (about 60 times as much).
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def strings(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array without nulls: null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.fill_null("") if col.null_count else col


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most so many bytes of text each, or one longer text alone."""
    n, col = batch.num_rows, strings(batch.column(text))
    ends = offsets(col).astype(np.int64)[1:]
    at = 0
    base = int(offsets(col)[0]) if n else 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        base, at = int(ends[to - 1]), to


def offsets(col: pa.Array) -> np.ndarray:
    wide = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if len(col) == 0:
        return np.zeros(1, wide)
    return np.frombuffer(col.buffers()[1], wide)[col.offset : col.offset + len(col) + 1]


@dataclass
class Words:
    """data: all nonspace bytes, word after word; first: where each word begins in data; doc: words of document i are doc[i]:doc[i + 1]."""

    data: np.ndarray
    first: np.ndarray
    length: np.ndarray
    doc: np.ndarray

    @property
    def count(self) -> int:
        return len(self.first)

    def inside(self) -> np.ndarray:
        """Place of each byte of data in its word."""
        return np.arange(len(self.data)) - np.repeat(self.first, self.length)

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit Rabin-Karp hash of each word, mixed with its length."""
        if not self.count:
            return np.zeros(0, np.uint64)
        byte = seeded(256, seed)
        power = powers(0x9FB21C651E98DF25 + 2 * seed, int(self.length.max()))
        value = np.add.reduceat(byte[self.data] * power[self.inside()], self.first)
        return mix(value + self.length.astype(np.uint64) * U64(0xD6E8FEB86659FD93))

    def joined(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the (kept) words with one space after each, and where each of them begins, with the end."""
        data, length = self.data, self.length
        if keep is not None:
            data, length = data[np.repeat(keep, length)], length[keep]
        begin = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length + 1, out=begin[1:])
        out = np.full(begin[-1], 0x20, np.uint8)
        out[np.arange(len(data)) + np.repeat(np.arange(len(length)), length)] = data
        return out, begin


def words_of(col: pa.Array, lower: bool = False) -> Words:
    col = strings(col)
    off = offsets(col).astype(np.int64)
    raw = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(col) and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    solid = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    begin = np.flatnonzero(start)
    length = np.flatnonzero(stop) + 1 - begin
    data = raw[solid]
    first = np.zeros(len(begin), np.int64)
    np.cumsum(length[:-1], out=first[1:]) if len(begin) > 1 else None
    return Words(LOWER[data] if lower else data, first, length, np.searchsorted(begin, off))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then those of start[1], and so on."""
    if not len(count) or not count.sum():
        return np.zeros(0, np.int64)
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(start - before, count)
