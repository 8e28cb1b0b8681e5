"""Near copies: groups of texts over pairs whose word shingle sets have a Jaccard similarity of 4/5 or more.

The method is SimHash with BK-trees. A pair at the threshold differs in about 10 of 64 bits and, by
simulation over sets of 4 to 1,000 shingles, in 24 or fewer in all of 36,000 draws, so the search radius is
25. Bands can't deal fingerprints into shards at that radius (they would have two bits each), so shards are
dealt by pairs of least hashes of the shingles: a pair at the threshold shares one of KEYS shards but for
4 cases in 100,000, and fewer above it. Each shard is a BK-tree (trees of bounded size where many texts
share a shard), searches follow only edges within the radius, and every link is checked on the whole sets.

A family of copies needs few links to become one group. So the first round proposes for each text only its
nearest predecessors in its tree, and the shard's first text; these proposals are checked and groups made. Shards
that still hold several groups are searched again without any limit, the sets beside the fingerprints, so that
proposals are checked where they are made: what comes out are spanning links, never the pairs of a group.

Defined results: wordless and null texts are equal to each other and like no other; a text of fewer
words than a shingle is one shingle; repeated rows are in one group. Texts are told apart by 64-bit
hashes, and so are shingles. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.blocks import paired_blocks, runs_by_key
from phasegrid.llm.components import components
from phasegrid.llm.simhash import BKTree, Union, majority
from phasegrid.llm.store import settled
from phasegrid.llm.substring import window_hashes
from phasegrid.llm.tokens import U64, mix, ranges, seeded, slices, words_of

#: The threshold as a fraction.
ENOUGH, OF = 4, 5
RADIUS = 25
#: Shards a text is in, each named by two least hashes.
KEYS = 10
#: Texts of a tree, and the shingles of a block of the second round.
BLOCK, SHINGLES = 1024, 1 << 21
#: Proposals a text makes in the first round.
NEAREST = 2


def shingle_sets(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document row and hash of each distinct shingle, by row, hashes ascending; every row has one at least."""
    words = words_of(col, lower=True)
    count = np.diff(words.doc)
    long = count >= size
    n = np.where(long, count - size + 1, 0)
    rows, hashes = [np.repeat(np.arange(len(n)), n)], [window_hashes(words, size, 23)[ranges(words.doc[:-1], n)] if long.any() else np.zeros(0, np.uint64)]
    single = words.hashes(29)
    for i in np.flatnonzero(~long).tolist():
        h = U64(0)
        for x in single[words.doc[i] : words.doc[i + 1]]:
            h = mix(np.array([h]) * U64(0x9FB21C651E98DF25) + x)[0]
        rows.append(np.array([i]))
        hashes.append(np.array([h], np.uint64))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def sketches(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, number of distinct shingles and KEYS shard names of each text, over its set of shingles."""
    row, h = shingle_sets(col, size)
    n = np.bincount(row, minlength=len(col))
    first = np.cumsum(n) - n
    least = [np.minimum.reduceat(h * (x | U64(1)), first) for x in seeded(2 * KEYS, 43)]
    names = [mix(a ^ mix(b + U64(k + 1))) for k, (a, b) in enumerate(zip(least[::2], least[1::2]))]
    return majority(h.view(np.uint8).reshape(-1, 8), n), n, np.stack(names, axis=1)


def _shards(docs: DataFrame, size: int) -> DataFrame:
    """(s, mark, fp, n, texts, pivot): the shards of more than one text; pivot is the least mark in it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp, n, names = sketches(part.column("text"), size)
                mark = part.column("mark").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64).ravel()), *(pa.array(np.repeat(x, KEYS)) for x in (mark, fp.view(np.int64), n))], ["s", "mark", "fp", "n"])

    dealt = settled(docs.select("mark", "text").mapInArrow(work, "s long, mark long, fp long, n long").distinct(), "sketches")
    several = dealt.groupBy("s").agg(F.count("*").alias("texts"), F.min("mark").alias("pivot")).filter("texts > 1")
    return settled(dealt.join(several, "s"), "shards")


def _sets(docs: DataFrame, need: DataFrame, size: int) -> DataFrame:
    """(mark, set, names) of the needed texts: their shingles as sorted 64-bit hashes, and the shards they are in."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, h = shingle_sets(part.column("text"), size)
                names, raw, off = sketches(part.column("text"), size)[2], h.tobytes(), 8 * np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))])
                yield pa.RecordBatch.from_arrays([part.column("mark"), pa.array([raw[i:j] for i, j in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary()), pa.array([x.tobytes() for x in names], pa.binary())], ["mark", "set", "names"])

    texts = docs.select("mark", "text").join(need.select("mark").distinct(), "mark", "left_semi").groupBy("mark").agg(F.first("text").alias("text"))
    return settled(texts.mapInArrow(work, "mark long, set binary, names binary"), "sets")


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that are near."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                near.append(OF * both >= ENOUGH * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    met = pairs.join(sets.select(F.col("mark").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("mark").alias("b"), F.col("set").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def nearest(fp: list[int], n: list[int]) -> list[tuple[int, int]]:
    """Each place of a tree with the nearest places before it, within RADIUS and of sizes that allow the threshold."""
    tree, holds, found = BKTree(), [], []
    for i, v in enumerate(fp):
        near, left = tree.within(v, RADIUS), NEAREST
        near.sort(key=lambda at: (tree.values[at] ^ v).bit_count())
        for j in (j for at in near for j in holds[at]):
            if OF * min(n[i], n[j]) >= ENOUGH * max(n[i], n[j]):
                found.append((j, i))
                left -= 1
                if not left:
                    break
        at = tree.add(v)
        if at == len(holds):
            holds.append([])
        holds[at].append(i)
    return found


def spanning(fp: list[int], sets: list[np.ndarray], names: np.ndarray, group: list[int], side: np.ndarray | None, shard: int) -> list[tuple[int, int]]:
    """Links between the groups of a unit that join them all: pairs of places within RADIUS (of two sides if sides are
    given) whose sets are near. A pair counts in the first shard that both are in. The largest group asks nothing, as the others ask it."""
    tree, holds = BKTree(), []
    for i, v in enumerate(fp):
        at = tree.add(v)
        if at == len(holds):
            holds.append([])
        holds[at].append(i)
    known, label = np.unique(group, return_inverse=True)
    union, n = Union(len(known)), np.array([len(x) for x in sets])
    off = np.concatenate([[0], np.cumsum(n)])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros(len(values), bool)
    most, links = int(np.bincount(label).argmax()), []
    tops = np.arange(len(known))
    for i in np.flatnonzero(label != most).tolist():
        near = np.array([j for at in tree.within(fp[i], RADIUS) for j in holds[at]], np.int64)
        near = near[(tops[label[near]] != tops[label[i]]) & (OF * np.minimum(n[near], n[i]) >= ENOUGH * np.maximum(n[near], n[i]))]
        if side is not None:
            near = near[side[near] != side[i]]
        if len(near):
            shared = names[near] == names[i]
            near = near[names[i][shared.argmax(axis=1)] == shard]
        if not len(near):
            continue
        has[place[off[i] : off[i + 1]]] = True
        both = np.add.reduceat(has[place[ranges(off[near], n[near])]], np.cumsum(n[near]) - n[near], dtype=np.int64)
        has[place[off[i] : off[i + 1]]] = False
        for j in near[OF * both >= ENOUGH * (n[near] + n[i] - both)].tolist():
            if union.join(int(label[i]), int(label[j])):
                links.append((i, j))
                tops = np.array([union.top(x) for x in range(len(known))])
    return links


def _emit(mark: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(pairs, np.int64).reshape(-1, 2)
    a, b = mark[at[:, 0]], mark[at[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _first_proposals(shards: DataFrame) -> DataFrame:
    """Pairs (a, b) of marks, a < b: each text's nearest predecessors in its tree, and the pivot of a shard of several trees."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs_by_key(batches, ["s", "tree"]):
            if unit.num_rows > 1:
                yield _emit(unit.column("mark").to_numpy(), nearest(unit.column("fp").to_numpy().view(np.uint64).tolist(), unit.column("n").to_pylist()))

    units = shards.select("s", F.pmod(F.xxhash64("mark"), F.ceil(F.col("texts") / BLOCK)).alias("tree"), "mark", "fp", "n")
    inside = units.repartition("s", "tree").sortWithinPartitions("s", "tree", "mark").mapInArrow(work, "a long, b long")
    large = shards.filter(F.col("texts") > BLOCK)
    pivots = large.filter("mark = pivot").select("s", F.col("fp").alias("pivot_fp"), F.col("n").alias("pivot_n"))
    star = large.filter("mark <> pivot").join(pivots, "s").filter((F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot_fp"))) <= RADIUS) & (OF * F.least("n", "pivot_n") >= ENOUGH * F.greatest("n", "pivot_n")))
    return inside.unionAll(star.select(F.least("mark", "pivot").alias("a"), F.greatest("mark", "pivot").alias("b"))).distinct()


def _links_left(shards: DataFrame, sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Spanning links (a, b) of shards that hold several groups (node, component)."""
    grouped = shards.select("s", "mark", "fp", "n").join(groups, F.col("mark") == F.col("node"), "left").withColumn("g", F.coalesce("component", "mark")).drop("node", "component")
    several = grouped.groupBy("s").agg(F.min("g").alias("_l"), F.max("g").alias("_m")).filter("_l < _m").select("s")
    units = paired_blocks(settled(grouped.join(several, "s"), "open").join(sets, "mark"), ["s"], "mark", BLOCK, "n", SHINGLES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs_by_key(batches, ["s", "unit_a", "unit_b"]):
            group = unit.column("g").to_pylist()
            two = unit.column("unit_a")[0].as_py() != unit.column("unit_b")[0].as_py()
            if len(set(group)) < 2:
                continue
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in unit.column("set")]
            names = np.stack([np.frombuffer(x.as_buffer(), np.int64) for x in unit.column("names")])
            pairs = spanning(unit.column("fp").to_numpy().view(np.uint64).tolist(), sets, names, group, unit.column("side").to_numpy() if two else None, unit.column("s")[0].as_py())
            if pairs:
                yield _emit(unit.column("mark").to_numpy(), pairs)

    return units.mapInArrow(work, "a long, b long")


def near_copies(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, mark, group long) of every row of docs (doc_id, text); mark is a hash of the text."""
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    shards = _shards(marked, shingle)
    sets = _sets(marked, shards, shingle)
    links = settled(_checked(settled(_first_proposals(shards), "proposed"), sets.select("mark", "set")), "links")
    groups = settled(components(links), "groups")
    links = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(settled(_links_left(shards, sets, groups), "links"))
    groups = settled(components(links), "groups")
    return marked.select("doc_id", "mark").join(groups, F.col("mark") == F.col("node"), "left").select("doc_id", "mark", F.coalesce("component", "mark").alias("group"))
