"""Byte-level BPE encoding and decoding with a given vocabulary file.

Text is split at added tokens, then into pieces; each piece is a doubly linked list of symbols, and a
heap of (merge rank, place) yields the next merge. Entries whose symbols have changed since they were
pushed are stale and skipped. Pieces are remembered in two generations of bounded size. Decoding
concatenates the vocabulary's byte strings.

The vocabulary file (a bounded one, a few MB) is read once on the driver and broadcast.

Defined results: null text counts as empty (no ids); ids that are not in the vocabulary raise an
error; bytes that are not UTF-8 decode to the replacement character; other columns pass through, and
the operator's own columns replace any of the same name.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from phasegrid.llm.store import extended
from phasegrid.llm.tokens import offsets, slices, strings

#: The split of byte-level BPE vocabularies of this family.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHIFT = 32
PLACE = (1 << SHIFT) - 1


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it prints, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(free))
        free += b not in shown
    return out


class Codec:
    """Encoder and decoder of one vocabulary file's text."""

    def __init__(self, text: str, remember: int = 200_000) -> None:
        spec = json.loads(text)
        vocab: dict[str, int] = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in enumerate(alphabet)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.byte_id = [vocab[c] for c in alphabet]
        self.rank: dict[int, int] = {}
        self.pair: list[int] = []
        self.made: list[int] = []
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            key = vocab[a] << SHIFT | vocab[b]
            self.rank.setdefault(key, len(self.pair))
            self.pair.append(key)
            self.made.append(vocab[a + b])
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.strings: list[bytes | None] = [None] * size
        for s, i in vocab.items():
            self.strings[i] = bytes(to_byte[c] for c in s)
        for s, i in self.added.items():
            self.strings[i] = s.encode()
        self.split = regex.compile(PIECES).findall
        self.stops = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.pieces = Pieces(self, remember)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one piece."""
        sym = [self.byte_id[b] for b in word]
        n, rank, pair = len(sym), self.rank.get, self.pair
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << SHIFT | i for i in range(n - 1) if (r := rank(sym[i] << SHIFT | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> SHIFT, top & PLACE
            j = after[i]
            if j >= n or sym[i] < 0 or sym[i] << SHIFT | sym[j] != pair[r]:
                continue  # stale: one of the two has merged with another
            sym[i], sym[j] = self.made[r], -1
            k, p = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := rank(sym[i] << SHIFT | sym[k])) is not None:
                    heapq.heappush(heap, r << SHIFT | i)
            if p >= 0 and (r := rank(sym[p] << SHIFT | sym[i])) is not None:
                heapq.heappush(heap, r << SHIFT | p)
        return [s for s in sym if s >= 0]

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        get = self.pieces.__getitem__
        if self.stops is None or not self.stops.search(text):
            return b"".join(map(get, self.split(text)))
        out, at = [], 0
        for m in self.stops.finditer(text):
            out += map(get, self.split(text[at : m.start()]))
            out.append(pack([self.added[m[0]]]))
            at = m.end()
        return b"".join([*out, *map(get, self.split(text[at:]))])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes() if len(ids) > 16 else b"".join(i.to_bytes(4, "little") for i in ids)


class Pieces(dict):
    """Packed ids by piece. When full it becomes the old generation; what is asked for again moves over."""

    def __init__(self, codec: Codec, most: int) -> None:
        super().__init__()
        self.codec, self.most, self.old = codec, most, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = pack(self.codec.merge(piece.encode()))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


_codecs: dict[int, Codec] = {}


def _codec(text: str) -> Codec:
    """One a worker process, as it takes a while to build."""
    if hash(text) not in _codecs:
        _codecs.clear()
        _codecs[hash(text)] = Codec(text)
    return _codecs[hash(text)]


def _lists(packed: list[bytes]) -> pa.Array:
    off = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=off[1:])
    values = pa.Array.from_buffers(pa.int32(), int(off[-1]), [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(off), values)


def _transform(df: DataFrame, vocabulary: str, added: str, drop: tuple[str, ...], by: str, work) -> DataFrame:
    told = df.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    df = df.drop(*drop)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(told.value)
        for batch in batches:
            for part in slices(batch, by) if by == "text" else [batch.slice(i, 256) for i in range(0, batch.num_rows, 256)]:
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *work(codec, part)], [*names, *drop])

    return df.mapInArrow(run, extended(df.schema, added))


def bpe_encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs (text, ...) plus ids array<int>."""
    return _transform(docs, vocabulary, "ids array<int>", ("ids",), "text", lambda c, b: [_lists([c.encode_packed(t) for t in strings(b.column("text")).to_pylist()])])


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """encoded (ids, ...) plus decoded string; null ids count as none."""
    return _transform(encoded, vocabulary, "decoded string", ("decoded",), "ids", lambda c, b: [pa.array([c.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())])


def bpe_round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Both in one pass: docs plus ids_packed (little-endian unsigned 32-bit integers) and decoded string."""

    def work(c: Codec, b: pa.RecordBatch) -> list[pa.Array]:
        packed = [c.encode_packed(t) for t in strings(b.column("text")).to_pylist()]
        texts = [c.decode(array("I", p)) for p in packed]
        return [pa.array(packed, pa.binary()), pa.array(texts, pa.string())]

    return _transform(docs, vocabulary, "ids_packed binary, decoded string", ("ids_packed", "decoded"), "text", work)
