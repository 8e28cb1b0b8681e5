"""SimHash fingerprints and near-duplicate groups by BK-trees.

Equal fingerprints collapse first, so copies cost nothing. Distinct fingerprints are dealt into
shards by bands: with radius r, two fingerprints that differ in at most r bits agree on one of r + 1
bands. Each shard is a BK-tree (children keyed by Hamming distance to their parent) and a search
follows only the edges whose key is within r of the node's distance. A shard that holds more than
`leaf` fingerprints is dealt again by bands of the remaining bits, and what still is too large after
that becomes trees of bounded size, each of which is searched by all blocks of the shard. Shard trees
travel by shuffle, not by broadcast: their size grows with the data.

Each shard reports a spanning set of links (one a fingerprint), never all pairs, and a distributed
star contraction turns them into components.

Defined results: null or wordless text has fingerprint zero and links like any other; a null doc_id
takes part in links but never names a component if another id is there; rows that repeat are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.blocks import paired_blocks, runs_by_key
from phasegrid.llm.components import components
from phasegrid.llm.store import cut, extended, packed, row_hash
from phasegrid.llm.tokens import ranges, slices, words_of

#: For each byte, its bits as eight byte-wide counters, the lowest bit in the lowest byte.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
#: Shingles that byte-wide counters can hold.
FULL = 255


def fingerprints_of(col: pa.Array, shingle: int, seed: int) -> np.ndarray:
    """The 64-bit SimHash of each text, over its lower-cased word shingles with repeats."""
    words = words_of(col, lower=True)
    text, begin = words.joined()
    raw, count = text.tobytes(), np.diff(words.doc)
    n = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    at = ranges(words.doc[:-1], n)
    ends = begin[np.minimum(at + shingle, np.repeat(words.doc[1:], n))] - 1
    digest = xxhash.xxh64_digest
    hashes = b"".join(map(digest, map(raw.__getitem__, map(slice, begin[at].tolist(), ends.tolist())), repeat(seed)))
    return majority(np.frombuffer(hashes, np.uint8).reshape(-1, 8)[:, ::-1], n)  # digests are big-endian


def majority(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each text, of whose hashes (rows of 8 bytes, the lowest first) there are n, text by text: the bits that over half of them set."""
    lanes = SPREAD[hashes]
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    pieces = -(-n[some] // FULL)
    start = np.repeat((np.cumsum(n) - n)[some], pieces) + FULL * ranges(np.zeros(len(some), np.int64), pieces)
    part = np.add.reduceat(lanes, start, axis=0)
    bits = np.add.reduceat(part.view(np.uint8).reshape(len(start), 64), np.cumsum(pieces) - pieces, axis=0, dtype=np.int64)
    out[some] = np.packbits(2 * bits > n[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, mark, fingerprint as a long) of every row; mark is a hash of the text, to tell rows that share a doc_id apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                f = fingerprints_of(part.column("text"), shingle, seed)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(f.view(np.int64))], ["doc_id", "mark", "fingerprint"])

    ids = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return ids.mapInArrow(work, extended(ids.select("doc_id", "mark").schema, "fingerprint long"))


class BKTree:
    """Values under integer Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The place of the value, which is added unless it is there."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while d := (self.values[at] ^ value).bit_count():
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = below
        return at

    def within(self, value: int, radius: int) -> list[int]:
        """Places of all values at most so far away."""
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if len(below) <= 2 * radius + 1:
                todo += [c for k, c in below.items() if d - radius <= k <= d + radius]
            else:
                todo += [below[k] for k in range(d - radius, d + radius + 1) if k in below]
        return found


class Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def tree_links(mine: list[int], others: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning links among mine, or between mine and others, each at most radius long."""
    tree, values = BKTree(), [*mine, *others]
    union = Union(len(values))
    links = []
    for i, v in enumerate(mine):
        if not others:
            links += [(v, values[j]) for j in tree.within(v, radius) if union.join(i, j)]
        tree.add(v)  # distinct values: place i
    for i, v in enumerate(others, len(mine)):
        links += [(v, values[j]) for j in tree.within(v, radius) if union.join(i, j)]
    return links


def bands_of(mask_bits: list[int], parts: int) -> list[int]:
    """The bits dealt into so many masks, as signed 64-bit values."""
    out = []
    for p in range(parts):
        m = sum(1 << b for b in mask_bits[p * len(mask_bits) // parts : (p + 1) * len(mask_bits) // parts])
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def fingerprint_links(distinct: DataFrame, radius: int = 2, leaf: int = 2048) -> DataFrame:
    """distinct: fingerprint (long), no repeats. Spanning links (a, b) of the graph of all pairs at most radius bits apart."""
    first = bands_of(list(range(64)), radius + 1)
    level1 = distinct.select("fingerprint", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m)) for m in first])).alias("band", "value"))
    counts = level1.groupBy("band", "value").count().filter("count > 1")
    level1 = cut(level1.join(counts, ["band", "value"]), "bands")
    small = level1.filter(F.col("count") <= leaf).select("fingerprint", F.col("band").alias("shard"), "value")
    # shards too large for one tree: bands of the bits that the first band leaves open
    second = []
    for b, m in enumerate(first):
        rest = bands_of([x for x in range(64) if not (m >> x) & 1], radius + 1)
        for k, sub in enumerate(rest):
            second.append(F.when(F.col("band") == b, F.struct(F.lit(100 + 10 * b + k).alias("shard"), F.col("fingerprint").bitwiseAND(F.lit(m | sub)).alias("value"))))
    large = level1.filter(F.col("count") > leaf).select("fingerprint", F.explode(F.array_compact(F.array(*second))).alias("s")).select("fingerprint", "s.*")
    units = paired_blocks(small.unionAll(large), ["shard", "value"], "fingerprint", leaf)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs_by_key(batches, ["shard", "value", "unit_a", "unit_b"]):
            value, side = unit.column("fingerprint").to_numpy(), unit.column("side").to_numpy()
            mine, others = (value[side == k].view(np.uint64).tolist() for k in (0, 1))
            if len(mine) + len(others) < 2 or (not others and unit.column("unit_a")[0].as_py() != unit.column("unit_b")[0].as_py()):
                continue
            links = np.array(tree_links(mine, others, radius), np.uint64).reshape(-1, 2).view(np.int64)
            if len(links):
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], ["a", "b"])

    return units.mapInArrow(search, "a long, b long")


def simhash_dedup(docs: DataFrame, shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """(doc_id, mark, fingerprint long, component_id, group long) of every row of docs; component_id is the smallest doc_id
    reachable over links, group the component's own key: doc_ids that are null or repeat don't tell components apart."""
    prints = cut(fingerprints(docs, shingle, seed), "simhash")
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    groups = components(fingerprint_links(classes.select("fingerprint"), radius))
    named = classes.join(groups, classes.fingerprint == groups.node, "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("_group"))
    least = named.groupBy("_group").agg(F.min("least").alias("component_id"))
    label = named.join(least, "_group").select("fingerprint", "component_id", F.col("_group").alias("group"))
    return prints.join(label, "fingerprint").select("doc_id", "mark", "fingerprint", "component_id", "group")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each group of found (doc_id, mark and group of each row of docs) one row, with the
    smallest doc_id; of rows with that id and text the one with the least hash of its columns. All columns pass, whatever their names."""
    stays = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("r")).select("r.doc_id", "r.mark")
    rows = docs.select(packed(docs), F.col("doc_id").alias("id"), F.xxhash64("text").alias("own"), row_hash(docs).alias("order"))
    met = rows.join(stays, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("mark")))
    return met.groupBy("id", "own").agg(F.min_by("row", "order").alias("row")).select("row.*")
