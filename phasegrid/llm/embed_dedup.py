"""Embedding near-duplicates by spherical-cap filters.

Equal vectors of a label collapse into classes first. A random product code (the vector, randomly
rotated, is cut into parts; each part has its own codewords; a filter is one codeword a part) gives
codewords ** parts filter directions; several independent codes even out how many of them a vector
gets. Each class vector (all turned by one random rotation, of
which every code takes the coordinates in an order of its own) is list-decoded to all filters whose
inner product with it exceeds the cap's height: partial sums of the first half of the parts are kept
only if the best of the other half can lift them over it. Vectors that share a filter are compared
exactly; a pair counts under its smallest common filter only, so it counts once. Buckets of any size
are cut into blocks and every block meets every other, one work unit each, from which one row a vector
comes back: its links and a spanning link, never the pairs.

The code is chosen for each length of vectors (code_for): the caps' height so that a filter holds about
BUCKET of the largest label's vectors, and as many filters as are needed for a pair at the threshold to
share one but for 1 - RECALL of such pairs, as measured on random pairs (pairs above it are missed less). The code's
directions are random, so this holds for any data. Nothing below the threshold is ever linked.

Defined results: vectors with a null vec_id or label, or that are null, empty, zero or hold null or
non-finite components link with nothing; vectors of different length are never compared; repeated
rows are vectors of their own; of an empty table nothing comes back. Lengths of any size are compared (vectors
are scaled by their largest component first). Columns other than vec_id, embedding and label are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.blocks import paired_blocks, runs_by_key
from phasegrid.llm.components import components
from phasegrid.llm.simhash import Union
from phasegrid.llm.store import cut


@dataclass(frozen=True)
class Code:
    """parts must be even or 1; height is in standard deviations of a random inner product."""

    codes: int = 12
    parts: int = 2
    codewords: int = 128
    height: float = 3.55
    seed: int = 17


#: Vectors of a label that a filter should hold, the least and greatest share of them, and the wanted recall at the threshold.
BUCKET, LEAST, MOST, RECALL = 256, 1e-6, 0.05, 0.999
#: Random pairs on which a code is tried; vectors shorter than SHORT are not cut
#: into parts, and longer ones than LONG, whose inner products are spread alike, take the code of that length.
PAIRS, SHORT, LONG = 3000, 8, 128


@lru_cache(maxsize=64)
def code_for(dim: int, rows: int, threshold: float, seed: int = 17) -> Code:
    """A code for vectors of this length, of which a label has up to `rows`."""
    real, dim = dim, min(dim, LONG)
    rng = np.random.default_rng([seed, dim])
    share, parts = min(MOST, max(LEAST, BUCKET / max(1, rows))), 2 if dim >= SHORT else 1
    x = rng.standard_normal((PAIRS, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if real == 1:
        return Code(codes=12, parts=1, codewords=2, height=0.5, seed=seed)
    away = rng.standard_normal((PAIRS, dim))
    away -= (away * x).sum(1)[:, None] * x
    away /= np.linalg.norm(away, axis=1)[:, None]
    y = threshold * x + np.sqrt(1 - threshold**2) * away
    # the height that a random inner product exceeds with this share: its square is Beta(1/2, (dim - 1) / 2) distributed
    grid = np.linspace(0, 1, 200_001)
    density = np.maximum(1 - grid**2, 0) ** ((dim - 3) / 2) if dim > 2 else 1 / np.sqrt(np.maximum(1 - grid**2, 1e-9))
    above = np.cumsum(density[::-1])[::-1]
    height = float(min(grid[np.searchsorted(-above / (2 * above[0]), -share)], (1 + np.sqrt((1 + threshold) / 2)) / 2 - 0.08) * np.sqrt(dim))  # a cap that holds such pairs
    codes, filters = 32, (11 + 9 * np.log10(MOST / share)) / share  # about what 64 dimensions take
    while True:
        words = max(2, int(np.ceil((filters / codes) ** (1 / parts))))
        code = Code(codes, parts, words, height, seed)
        missed = 0
        for at in range(0, PAIRS, 1000):
            (r, f), (q, g) = list_decode(x[at : at + 1000], code), list_decode(y[at : at + 1000], code)
            width = codes * words**parts
            missed += 1000 - len(np.unique(np.intersect1d(r * width + f, q * width + g) // width))
        if missed <= (1 - RECALL) * PAIRS:
            return code
        filters *= 1.2


@lru_cache(maxsize=8)
def rotation(seed: int, dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))[0]


@lru_cache(maxsize=256)
def code_words(code: Code, which: int, dim: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order in which a code takes the coordinates of the rotated vector, and for each part its codewords as columns; every filter direction has length one."""
    rng = np.random.default_rng([code.seed, which, dim])
    order = rng.permutation(dim)
    parts = code.parts if dim >= code.parts else 1
    words = []
    for block in np.array_split(np.arange(dim), parts):
        w = rng.standard_normal((len(block), code.codewords))
        words.append(w / np.linalg.norm(w, axis=0) / np.sqrt(parts))
    return order, words


def _sums(products: list[np.ndarray]) -> np.ndarray:
    out = products[0]
    for p in products[1:]:
        out = (out[:, :, None] + p[:, None, :]).reshape(len(out), -1)
    return out


def list_decode(unit: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every filter of all codes whose cap holds the row's unit vector, by row, filters ascending."""
    turned = unit @ rotation(code.seed, unit.shape[1])
    found = [_decode(turned, code, k) for k in range(code.codes)]
    row, f = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((f, row))
    return row[order], f[order]


def _decode(turned: np.ndarray, code: Code, which: int) -> tuple[np.ndarray, np.ndarray]:
    dim = turned.shape[1]
    order, words = code_words(code, which, dim)
    turned = turned[:, order]
    ends = np.cumsum([w.shape[0] for w in words])
    products = [turned[:, e - w.shape[0] : e] @ w for e, w in zip(ends, words)]
    least, half, first = code.height / np.sqrt(dim), len(products) // 2, which * code.codewords**code.parts
    if not half:
        row, f = np.nonzero(products[0] >= least)
        return row, first + f
    left, right = _sums(products[:half]), _sums(products[half:])
    row, a = np.nonzero(left >= (least - right.max(axis=1))[:, None])
    rows, filters = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(row), 4096):
        r, x = row[k : k + 4096], a[k : k + 4096]
        i, b = np.nonzero(right[r] >= (least - left[r, x])[:, None])
        rows.append(r[i])
        filters.append(first + x[i] * right.shape[1] + b)
    return np.concatenate(rows), np.concatenate(filters)


def _units(col: pa.Array, dim: int) -> np.ndarray:
    """The vectors with length one."""
    v = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), dim)
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def filtered(classes: DataFrame, codes: dict[int, Code]) -> DataFrame:
    """classes (rep, label, dim, n, embedding): one row a filter that holds the vector, with all its filters in ascending order. codes: by dim."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                dims = part.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    own = part.filter(pa.array(dims == dim))
                    row, f = list_decode(_units(own.column("embedding"), dim), codes[dim])
                    count = np.bincount(row, minlength=own.num_rows)
                    off = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(off), pa.array(f.astype(np.int32)))
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([*(own.column(c).take(take) for c in ("rep", "label", "dim", "n", "embedding")), pa.array(f.astype(np.int32)), lists.take(take)], ["rep", "label", "dim", "n", "embedding", "filter", "filters"])

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.select("rep", "label", "dim", "n", "embedding").mapInArrow(work, f"rep long, label {classes.schema['label'].dataType.simpleString()}, dim int, n long, embedding {kind}, filter int, filters array<int>")


def _smaller_shared(filters: pa.Array, f: int) -> np.ndarray:
    """Of the vectors of one bucket f: which pairs share a smaller filter too."""
    off = np.asarray(filters.offsets)
    values = np.asarray(filters.values)[off[0] : off[-1]]
    row = np.repeat(np.arange(len(filters)), np.diff(off))
    below = values < f
    names, place = np.unique(values[below], return_inverse=True)
    has = np.zeros((len(filters), len(names)), np.float32)
    has[row[below], place] = 1
    return has @ has.T > 0


def compare(unit: pa.RecordBatch, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rep, links and a spanning link (another rep of the same cluster, or itself) of the vectors of a unit that link."""
    dim, f = unit.column("dim")[0].as_py(), unit.column("filter")[0].as_py()
    v = _units(unit.column("embedding"), dim)
    rep, n, side = (unit.column(c).to_numpy() for c in ("rep", "n", "side"))
    linked = v @ v.T >= threshold
    linked &= ~_smaller_shared(unit.column("filters"), f)
    if unit.column("unit_a")[0].as_py() != unit.column("unit_b")[0].as_py():
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    union = Union(len(rep))
    seen = np.zeros(len(rep), bool)
    for i in range(len(rep)):  # breadth first, so that every vector is joined once
        if seen[i] or not linked[i].any():
            continue
        todo, seen[i] = [i], True
        while todo:
            x = todo.pop()
            new = np.flatnonzero(linked[x] & ~seen)
            seen[new] = True
            for y in new.tolist():
                union.join(x, y)
            todo += new.tolist()
    some = np.flatnonzero(linked.any(axis=1))
    return rep[some], (linked[some] @ n), rep[[union.top(int(i)) for i in some]] if len(some) else rep[:0]


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, code: Code | None = None, block: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label). code: one for all lengths, instead of code_for()'s."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False))
    keyed = rows.withColumns({"h1": F.when(good, F.xxhash64("label", "embedding")), "h2": F.when(good, F.xxhash64("embedding", F.lit(1), "label"))})
    classes = keyed.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = cut(classes.withColumn("dim", F.size("embedding")), "classes")
    sizes = classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("rows")).collect()  # a row a length
    codes = {r.dim: code or code_for(r.dim, 1 << (r.rows - 1).bit_length(), threshold) for r in sizes}
    listed = cut(filtered(classes, codes), "filters")
    units = paired_blocks(listed, ["label", "dim", "filter"], "rep", block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs_by_key(batches, ["label", "dim", "filter", "unit_a", "unit_b"]):
            if unit.num_rows > 1:
                rep, links, to = compare(unit, threshold)
                if len(rep):
                    yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links.astype(np.int64)), pa.array(to)], ["rep", "links", "to"])

    found = cut(units.mapInArrow(work, "rep long, links long, to long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    told = classes.select("h1", "h2", "rep", "n").join(links, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    told = told.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("component", "rep").alias("_component"))
    out = keyed.select("vec_id", "h1", "h2").join(told, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
