"""Places: tiles, stations, boxes and polygons, conversions between coordinates and pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile_count(length: Column, size: float, overlap: float) -> Column:
    return F.rint((length - overlap) / (size - overlap)).cast("int")


def tile_size(length: Column, size: float, overlap: float) -> Column:
    """Of each of the tiles that cover the length evenly."""
    n = tile_count(length, size, overlap)
    return (length + (n - 1) * overlap) / n


def extent(places: DataFrame) -> DataFrame:
    """One row: left, right, bottom, top of lon and lat."""
    return places.agg(F.min("lon").alias("left"), F.max("lon").alias("right"), F.min("lat").alias("bottom"), F.max("lat").alias("top"))


def tiles(box: DataFrame, size: float, overlap: float) -> DataFrame:
    """Tiles (i, j, lat, lon, height, width) of a box (left, right, bottom, top), bottom to top, left to right."""
    w, h = F.col("right") - F.col("left"), F.col("top") - F.col("bottom")
    t = box.select("left", "bottom", tile_size(w, size, overlap).alias("width"), tile_size(h, size, overlap).alias("height"), F.explode(F.sequence(F.lit(0), tile_count(h, size, overlap) - 1)).alias("i"), tile_count(w, size, overlap).alias("_n"))
    t = t.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return t.select("i", "j", (F.col("bottom") + F.col("i") * (F.col("height") - overlap)).alias("lat"), (F.col("left") + F.col("j") * (F.col("width") - overlap)).alias("lon"), "height", "width")


def overlapping(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes that overlap: both have left, right, bottom, top and an id (a_id, b_id). Boxes meet through the grid cells that they touch; a pair counts in the cell of the larger left bottom corner only."""

    def cells(df: DataFrame, p: str) -> DataFrame:
        x = F.explode(F.sequence(F.floor(F.col("left") / cell), F.floor(F.col("right") / cell)))
        y = F.explode(F.sequence(F.floor(F.col("bottom") / cell), F.floor(F.col("top") / cell)))
        return df.withColumn("_x", x).withColumn("_y", y).select(f"{p}_id", "_x", "_y", *[F.col(c).alias(f"{p}_{c}") for c in ("left", "right", "bottom", "top")])

    met = cells(a, "a").join(cells(b, "b"), ["_x", "_y"]).filter("a_left < b_right and b_left < a_right and a_bottom < b_top and b_bottom < a_top")
    own = (F.col("_x") == F.floor(F.greatest("a_left", "b_left") / cell)) & (F.col("_y") == F.floor(F.greatest("a_bottom", "b_bottom") / cell))
    return met.filter(own).select("a_id", "b_id")


def in_box(left: float, right: float, bottom: float, top: float) -> Column:
    return F.col("lon").between(left, right) & F.col("lat").between(bottom, top)


def in_polygon(points: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Points (lon, lat) inside a ring, by counting crossings with a ray; the box is checked first."""
    xs, ys = np.array(ring, float).T
    names = points.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("lon", "lat"))
            x0, y0, x1, y1 = xs[:-1], ys[:-1], xs[1:], ys[1:]
            over = (y0 > y) != (y1 > y)
            at = x0 + (y - y0) * (x1 - x0) / np.where(y1 == y0, 1, y1 - y0)
            yield b.filter(pa.array((over & (x < at)).sum(1) % 2 == 1))

    return points.filter(in_box(xs.min(), xs.max(), ys.min(), ys.max())).select(names).mapInArrow(work, points.schema)


def ring_area_sign(ring: Column) -> Column:
    """Twice the signed area of a closed ring (array of structs x, y): the shoelace sum."""
    n = F.size(ring)
    parts = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.element_at(ring, i)["x"] * F.element_at(ring, i + 1)["y"] - F.element_at(ring, i + 1)["x"] * F.element_at(ring, i)["y"])
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def pixel_of(lat: Column, lon: Column, y_first: float, y_step: float, x_first: float, x_step: float) -> tuple[Column, Column]:
    """Nearest (row, col) on a regular grid."""
    return F.rint((lat - y_first) / y_step).cast("int"), F.rint((lon - x_first) / x_step).cast("int")


#: Places of a block, which is searched as a whole, points of a task in a block, and places that stand for a block where borders are drawn.
BLOCK, CHUNK, DRAWN = 65_536, 262_144, 64
#: Places of a leaf of a block's tree.
LEAF = 64


class Tree:
    """Places (y, x) halved along the wider side down to leaves; nodes have boxes, which close tightly around the places unless told others."""

    def __init__(self, y: np.ndarray, x: np.ndarray, leaf: int):
        self.y, self.x, self.leaves, self.box, self.node = y, x, [], [], []
        self._grow(np.arange(len(y)), leaf)

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        y, x, k = self.y[rows], self.x[rows], len(self.node)
        self.box.append((y.min(), y.max(), x.min(), x.max()))
        self.node.append(None)
        v, axis = (y, 0) if y.max() - y.min() >= x.max() - x.min() else (x, 1)
        cut = np.partition(v, len(v) // 2)[len(v) // 2]
        low = v < cut if v.min() < cut else v <= cut  # many places may share the middle value
        if len(rows) <= leaf or low.all():
            self.node[k] = len(self.leaves)
            self.leaves.append(rows)
        else:
            at = cut if v.min() < cut else np.nextafter(cut, np.inf)
            self.node[k] = (axis, at, self._grow(rows[low], leaf), self._grow(rows[~low], leaf))
        return k

    def close(self, boxes: dict[int, tuple[float, float, float, float]]) -> None:
        """Gives the leaves other boxes."""
        for k in reversed(range(len(self.node))):
            n = self.node[k]
            if isinstance(n, tuple):
                a, b = self.box[n[2]], self.box[n[3]]
                self.box[k] = (min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]))
            else:
                self.box[k] = boxes[n]

    def home(self, y: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, which of the points lie on its side of all borders)."""
        todo = [(0, np.arange(len(y)))]
        while todo:
            k, idx = todo.pop()
            n = self.node[k]
            if not len(idx):
                continue
            if isinstance(n, tuple):
                low = (y if n[0] == 0 else x)[idx] < n[1]
                todo += [(n[2], idx[low]), (n[3], idx[~low])]
            else:
                yield n, idx

    def within(self, y: np.ndarray, x: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, which of the points have its box at a squared distance of `most` or less); `most` may fall meanwhile.

        Differences, squares and sums are rounded alike here and for places, and rounding keeps order: no place in a box comes out nearer than the box.
        """
        todo = [(0, np.arange(len(y)))]
        while todo:
            k, idx = todo.pop()
            b, n = self.box[k], self.node[k]
            dy, dx = np.maximum(np.maximum(b[0] - y[idx], y[idx] - b[1]), 0), np.maximum(np.maximum(b[2] - x[idx], x[idx] - b[3]), 0)
            idx = idx[dy * dy + dx * dx <= most[idx]]
            if not len(idx):
                continue
            if isinstance(n, tuple):
                todo += [(n[2], idx), (n[3], idx)]
            else:
                yield n, idx

    def search(self, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance and row of the nearest place of each point; of equally near ones the first row."""
        best, at = np.full(len(y), np.inf), np.full(len(y), len(self.y))
        for way in (self.home(y, x), self.within(y, x, best)):
            for leaf, idx in way:
                rows = self.leaves[leaf]
                for i in np.array_split(idx, -(-len(idx) * len(rows) // 1_000_000)):
                    dy, dx = self.y[rows] - y[i, None], self.x[rows] - x[i, None]
                    d = dy * dy + dx * dx
                    j = d.argmin(1)  # rows of a leaf ascend
                    d, r = d[np.arange(len(i)), j], rows[j]
                    won = (d < best[i]) | ((d == best[i]) & (r < at[i]))
                    best[i[won]], at[i[won]] = d[won], r[won]
        return best, at


def _doubles(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(c).to_numpy(zero_copy_only=False) for c in names]


def nearest(points: DataFrame, grid: DataFrame) -> DataFrame:
    """points (name, lat, lon) with the nearest grid pixel (prow, pcol, lat, lon) and its distance, however far it is; of equally near pixels the least (prow, pcol).

    Grids of up to a block are searched where the points are. Larger ones are dealt into blocks of neighbours, whose
    borders are drawn from some of the places; the nearest of those places bounds the distance, so that a point goes
    to the blocks within that bound only. Pixels at one place count once. Points without a place are left out.
    """
    there = "lat is not null and lon is not null and not isnan(lat) and not isnan(lon)"
    kinds, name = dict(grid.dtypes), dict(points.dtypes)["name"]
    points = points.select("name", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).filter(there)
    places = grid.filter(there).groupBy(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).agg(F.min(F.struct("prow", "pcol")).alias("p")).select("lat", "lon", "p.prow", "p.pcol")
    out = f"name {name}, d double, prow {kinds['prow']}, pcol {kinds['pcol']}"
    n = places.count()
    if n <= BLOCK:
        whole = places.orderBy("prow", "pcol").toArrow()
        prow, pcol = (pa.concat_arrays(whole.column(c).chunks) if n else None for c in ("prow", "pcol"))
        tree = Tree(whole.column("lat").to_numpy(), whole.column("lon").to_numpy(), LEAF) if n else None

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if tree and b.num_rows:
                    d, at = tree.search(*_doubles(b, "lat", "lon"))
                    yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(d), prow.take(pa.array(at)), pcol.take(pa.array(at))], ["name", "d", "prow", "pcol"])

        found = points.mapInArrow(here, out)
    else:
        found = _by_blocks(points, places, n, out)
    best = found.groupBy("name").agg(F.min(F.struct("d", "prow", "pcol")).alias("b"))
    return best.select("name", "b.prow", "b.pcol", F.sqrt("b.d").alias("distance"))


def _by_blocks(points: DataFrame, places: DataFrame, n: int, out: str) -> DataFrame:
    drawn = places.filter(F.pmod(F.xxhash64("lat", "lon"), F.lit(BLOCK // DRAWN)) == 0).select("lat", "lon").toArrow()
    if not drawn.num_rows:
        drawn = places.select("lat", "lon").limit(1).toArrow()
    borders = Tree(drawn.column("lat").to_numpy(), drawn.column("lon").to_numpy(), DRAWN)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = np.empty(b.num_rows, np.int64)
            for leaf, idx in borders.home(*_doubles(b, "lat", "lon")):
                block[idx] = leaf
            yield b.append_column("block", pa.array(block))

    dealt = places.mapInArrow(deal, places.select("*", F.lit(0).cast("bigint").alias("block")).schema)
    ends = dealt.groupBy("block").agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).collect()
    near = Tree(borders.y, borders.x, DRAWN)
    near.close({r[0]: tuple(r)[1:] for r in ends})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, x = _doubles(b, "lat", "lon")
            for leaf, idx in near.within(y, x, borders.search(y, x)[0]):
                yield b.take(pa.array(idx)).append_column("block", pa.array(np.full(len(idx), leaf, np.int64)))

    routed = points.mapInArrow(route, points.select("*", F.lit(0).cast("bigint").alias("block")).schema)
    # blocks that many points go to are searched by several tasks
    tasks = [(r["block"], -(-r["count"] // CHUNK)) for r in routed.groupBy("block").count().collect()]
    spark, kinds = points.sparkSession, dict(places.dtypes)
    tasks = F.broadcast(spark.createDataFrame(tasks, "block bigint, tasks bigint"))
    a = dealt.join(tasks, "block").withColumn("task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)))
    a = a.select("block", "task", F.lit(0).alias("kind"), F.lit(None).cast(dict(points.dtypes)["name"]).alias("name"), "lat", "lon", "prow", "pcol")
    b = routed.join(tasks, "block").withColumn("task", F.pmod(F.xxhash64("name"), "tasks"))
    b = b.select("block", "task", F.lit(1).alias("kind"), "name", "lat", "lon", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("prow", "pcol")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, have, tree = None, [], None
        for b in batches:
            block, task, kind = _doubles(b, "block", "task", "kind")
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(task) != 0) | (np.diff(kind) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
                if i == j:
                    continue
                if (block[i], task[i]) != key:
                    key, have, tree = (block[i], task[i]), [], None
                part = b.slice(i, j - i)
                if kind[i] == 0:
                    have.append(part)
                    continue
                if tree is None:
                    y, x, prow, pcol = (pa.concat_arrays([h.column(c) for h in have]) for c in ("lat", "lon", "prow", "pcol"))
                    tree = Tree(y.to_numpy(), x.to_numpy(), LEAF)
                d, at = tree.search(*_doubles(part, "lat", "lon"))
                yield pa.RecordBatch.from_arrays([part.column("name"), pa.array(d), prow.take(pa.array(at)), pcol.take(pa.array(at))], ["name", "d", "prow", "pcol"])

    met = a.unionByName(b).repartition("block", "task").sortWithinPartitions("block", "task", "kind", "prow", "pcol")
    return met.mapInArrow(search, out)


def in_circles(points: DataFrame, circles: DataFrame) -> DataFrame:
    """circles (c_id, cx, cy, r) with whether any point (x, y) lies inside; met through cells as wide as the largest radius."""
    top = circles.agg(F.max("r")).first()[0] or 1.0
    p = points.select("x", "y", F.floor(F.col("x") / top).alias("_i"), F.floor(F.col("y") / top).alias("_j"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    c = circles.select("*", around.alias("_k")).withColumn("_i", F.floor(F.col("cx") / top) + F.col("_k.i")).withColumn("_j", F.floor(F.col("cy") / top) + F.col("_k.j"))
    hit = c.join(p, ["_i", "_j"]).filter(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2) <= F.col("r") * F.col("r")).groupBy("c_id").agg(F.count("*").alias("n"))
    return circles.join(hit, "c_id", "left").select("c_id", F.coalesce("n", F.lit(0)).alias("n_points"), F.col("n").isNotNull().alias("known"))


def box_ring(lat: Column, lon: Column, height: Column, width: Column) -> Column:
    """GeoJSON polygon of a tile."""
    corners = [(lon, lat), (lon + width, lat), (lon + width, lat + height), (lon, lat + height), (lon, lat)]
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*[F.array(x, y) for x, y in corners])).alias("coordinates")))


def tiles_of_axis(pixels: Column) -> Column:
    """Tiles of an axis for unwrapping: three over 1000 pixels, two over 500."""
    return F.when(pixels > 1000, 3).when(pixels > 500, 2).otherwise(1)
