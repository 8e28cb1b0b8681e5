"""Per-pixel and per-layer preparation of image stacks: masks, means, references, ramps, elevation trends.

A stack is a long table (layer key, prow, pcol, value). Everything is a grouped sum or an equal join;
coefficients per layer (a few numbers) go back to the pixels by a join that is broadcast while small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.operators.quality import percentiles

PIXEL = ("prow", "pcol")
#: Keeps a mean defined where nothing was counted.
TINY = 1e-6
#: Share of a sum of squares that elimination must leave; less is rounding, and pixels don't determine the term.
LEFT = 1e-12


def pair_mask(pairs: DataFrame, masks: DataFrame) -> DataFrame:
    """A pair's pixel is masked if either date's is: pairs (ifg_idx, early, late), masks (date, prow, pcol, masked)."""
    a = masks.select(F.col("date").alias("early"), *PIXEL, F.col("masked").alias("_a"))
    b = masks.select(F.col("date").alias("late"), *PIXEL, F.col("masked").alias("_b"))
    return pairs.join(a, "early").join(b, ["late", *PIXEL]).select("ifg_idx", *PIXEL, (F.col("_a") | F.col("_b")).alias("masked"))


def mask_depth(masks: DataFrame) -> DataFrame:
    return masks.groupBy(*PIXEL).agg(F.sum(F.col("masked").cast("int")).alias("depth"))


def stack_mean(stack: DataFrame, value: str = "value", where: Column | None = None) -> DataFrame:
    """Mean of the present values over count + 1e-6."""
    x = F.when(~F.isnan(value), F.col(value))
    x = F.when(where, x) if where is not None else x
    return stack.groupBy(*PIXEL).agg((F.coalesce(F.sum(x), F.lit(0.0)) / (F.count(x) + TINY)).alias("mean"))


def auto_threshold(stack: DataFrame, value: str, share: float = 0.6) -> DataFrame:
    """One row: the percentile of the present values, interpolated."""
    return percentiles(stack, [], value, [share]).withColumnRenamed("p0", "threshold")


def below_threshold_to_zero(stack: DataFrame, weight: str, value: str, threshold: float) -> DataFrame:
    low = F.col(weight) < threshold
    return stack.withColumns({weight: F.when(low, 0.0).otherwise(F.col(weight)), value: F.when(low, 0.0).otherwise(F.col(value))})


def in_window(row: int, col: int, size: int) -> Column:
    """Pixels at most size // 2 away."""
    w = size // 2
    return F.col("prow").between(row - w, row + w) & F.col("pcol").between(col - w, col + w)


def in_even_window(row: int, col: int, size: int) -> Column:
    """Half-open: [row - h, row + h), h = size // 2 but at least 1."""
    h = max(size // 2, 1)
    return F.col("prow").between(row - h, row + h - 1) & F.col("pcol").between(col - h, col + h - 1)


def window_mean(stack: DataFrame, layer: str, value: str, inside: Column) -> DataFrame:
    return stack.filter(inside).groupBy(layer).agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias("reference"))


def reference_shift(stack: DataFrame, layer: str, value: str, row: int, col: int, size: int = 5) -> DataFrame:
    """Every layer minus the mean of its reference window; a window without values leaves null."""
    return stack.join(F.broadcast(window_mean(stack, layer, value, in_window(row, col, size))), layer, "left").withColumn(value, F.col(value) - F.col("reference")).drop("reference")


def basis(order: int) -> list[Column]:
    """Terms of a ramp in columns (x) and rows (y), from 0: 1, x, y and, for order 2, xy, x², y²."""
    x, y = F.col("pcol").cast("double"), F.col("prow").cast("double")
    return [F.lit(1.0), x, y] + ([x * y, x * x, y * y] if order == 2 else [])


def ramp_fit(stack: DataFrame, layer: str, value: str, order: int = 1, where: Column | None = None, least: int = 0) -> DataFrame:
    """Least-squares coefficients c0, c1, ... of each layer, from the present values (where told); layers with fewer than `least` of them are left out, and where they don't determine a ramp (too few, in a line) its coefficients are null."""
    ok = F.col(value).isNotNull() & ~F.isnan(value)
    rows = stack.filter(ok & where if where is not None else ok)
    b = basis(order)
    n = len(b)
    aggs = [F.sum(b[i] * b[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(b[i] * F.col(value)).alias(f"b{i}") for i in range(n)]
    s = rows.groupBy(layer).agg(F.count("*").alias("_n"), *aggs).filter(F.col("_n") >= least)
    # each elimination step becomes columns of its own, else the expressions grow without bound
    cell = {(i, j): f"a{min(i, j)}_{max(i, j)}" for i in range(n) for j in range(n)} | {(i, n): f"b{i}" for i in range(n)}
    for k in range(n):
        new = {}
        for i in range(k + 1, n):
            for j in range(k + 1, n + 1):
                new[(i, j)] = f"s{k}_{i}_{j}"
        s = s.withColumn(f"p{k}", F.when(F.col(cell[(k, k)]) > LEFT * F.col(f"a{k}_{k}"), F.col(cell[(k, k)])))
        s = s.withColumns({new[ij]: F.col(cell[ij]) - F.col(cell[(ij[0], k)]) / F.col(f"p{k}") * F.col(cell[(k, ij[1])]) for ij in new})
        cell |= new
    for i in reversed(range(n)):
        rest = F.col(cell[(i, n)])
        for j in range(i + 1, n):
            rest = rest - F.col(cell[(i, j)]) * F.col(f"c{j}")
        s = s.withColumn(f"c{i}", rest / F.col(f"p{i}"))
    return s.select(layer, *[f"c{i}" for i in range(n)])


def deramp(stack: DataFrame, layer: str, value: str, order: int = 1, where: Column | None = None, how: str = "left") -> DataFrame:
    """Every layer minus its ramp, which is fitted where told and subtracted everywhere. Layers whose pixels don't determine a ramp
    become null; those without any pixel to fit too, or (how="inner") are left out."""
    fit = ramp_fit(stack, layer, value, order, where)
    model = sum((F.col(f"c{i}") * t for i, t in enumerate(basis(order))), F.lit(0.0))
    return stack.join(F.broadcast(fit), layer, how).withColumn(value, F.col(value) - model).drop(*[f"c{i}" for i in range(len(basis(order)))])


def elevation_trend(stack: DataFrame, dem: DataFrame, layer: str, value: str, looks: int = 1, where: Column | None = None) -> DataFrame:
    """Every layer minus its straight line over elevation, which is fitted on looked-down pixels (absent values count as 0) and subtracted at full resolution."""
    met = stack.join(dem.select(*PIXEL, "elev"), list(PIXEL))
    seen = met.filter(where) if where is not None else met
    down = seen.groupBy(layer, F.floor(F.col("prow") / looks).alias("_r"), F.floor(F.col("pcol") / looks).alias("_c")).agg(F.avg(F.coalesce(F.when(~F.isnan(value), F.col(value)), F.lit(0.0))).alias("y"), F.avg("elev").alias("x"))
    fit = down.groupBy(layer).agg(F.regr_slope("y", "x").alias("_m"), F.regr_intercept("y", "x").alias("_b"))
    return met.join(F.broadcast(fit), layer).withColumn(value, F.col(value) - (F.col("_m") * F.col("elev") + F.col("_b"))).drop("_m", "_b", "elev")


def multilook(stack: DataFrame, keys: list[str], value: str, rows: int, cols: int) -> DataFrame:
    """Means of whole blocks of rows x cols pixels; blocks that are not whole are dropped."""
    blocks = stack.groupBy(*keys, F.floor(F.col("prow") / rows).cast("int").alias("brow"), F.floor(F.col("pcol") / cols).cast("int").alias("bcol"))
    return blocks.agg(F.avg(value).alias(value), F.count("*").alias("_n")).filter(F.col("_n") == rows * cols).drop("_n").withColumnsRenamed({"brow": "prow", "bcol": "pcol"})


def multilook_any(masks: DataFrame, keys: list[str], rows: int, cols: int) -> DataFrame:
    return masks.groupBy(*keys, F.floor(F.col("prow") / rows).cast("int").alias("brow"), F.floor(F.col("pcol") / cols).cast("int").alias("bcol")).agg(F.bool_or("masked").alias("masked")).withColumnsRenamed({"brow": "prow", "bcol": "pcol"})


def strided(stack: DataFrame, rows: int, cols: int) -> DataFrame:
    """The last pixel of every block."""
    return stack.filter(((F.col("prow") + 1) % rows == 0) & ((F.col("pcol") + 1) % cols == 0))


def spread(stack: DataFrame, keys: list[str], value: str, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each pixel's value sent to the pixels at the given offsets: one shuffle for the grouping that follows, combined on the map side."""
    cells = F.array(*[F.struct((F.col("prow") + dr).alias("prow"), (F.col("pcol") + dc).alias("pcol"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in offsets])
    return stack.select(*keys, F.col(value).alias("_v"), F.explode(cells).alias("_c")).select(*keys, F.col("_c.prow").alias("prow"), F.col("_c.pcol").alias("pcol"), F.col("_c.dr").alias("dr"), F.col("_c.dc").alias("dc"), F.col("_v").alias(value))


SQUARE = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]


def binary_opening(masks: DataFrame, keys: list[str]) -> DataFrame:
    """Erosion, then dilation by a 3 x 3 square; outside counts as false. Input must hold every pixel; output holds the true ones."""
    eroded = spread(masks.filter("masked"), keys, "masked", SQUARE).groupBy(*keys, *PIXEL).agg(F.count("*").alias("n")).filter("n = 9").withColumn("masked", F.lit(True)).drop("n")
    return spread(eroded, keys, "masked", SQUARE).select(*keys, *PIXEL).distinct()


def transfer_turns(high: DataFrame, low: DataFrame, keys: list[str], value: str, scale: int) -> DataFrame:
    """High-resolution phases moved by whole turns to lie nearest to the low-resolution ones (nearest pixel)."""
    two_pi = 6.283185307179586
    h = high.withColumn("_r", F.floor(F.col("prow") / scale).cast("int")).withColumn("_c", F.floor(F.col("pcol") / scale).cast("int"))
    l = low.select(*keys, F.col("prow").alias("_r"), F.col("pcol").alias("_c"), F.col(value).alias("_low"))
    turns = F.rint((F.col(value) - F.col("_low")) / two_pi)
    return h.join(l, [*keys, "_r", "_c"]).withColumn(value, F.col(value) - two_pi * turns).drop("_r", "_c", "_low")


def coordinates(stack: DataFrame, y_first: float, y_step: float, x_first: float, x_step: float) -> DataFrame:
    return stack.withColumns({"lat": F.lit(y_first) + F.col("prow") * F.lit(y_step), "lon": F.lit(x_first) + F.col("pcol") * F.lit(x_step)})


def half_pixel_shift(stack: DataFrame, y_step: float, x_step: float) -> DataFrame:
    return stack.withColumns({"lat": F.col("lat") - 0.5 * abs(y_step), "lon": F.col("lon") + 0.5 * x_step})


def extremes(images: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, least and greatest value of each image and their pixels (low_row, low_col, high_row, high_col); ties go to the first row and column."""
    v = F.when(~F.isnan(value), F.col(value))
    low, high = F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), *PIXEL))), F.min(F.when(v.isNotNull(), F.struct((-v).alias("v"), *PIXEL)))
    e = images.groupBy(*keys).agg(low.alias("_l"), high.alias("_h"))
    return e.select(*keys, F.col("_l.v").alias("low"), F.col("_l.prow").alias("low_row"), F.col("_l.pcol").alias("low_col"), (-F.col("_h.v")).alias("high"), F.col("_h.prow").alias("high_row"), F.col("_h.pcol").alias("high_col"))
