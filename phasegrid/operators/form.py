"""Interferograms, coherence and filters over images: block sums and neighbourhood sums.

Neighbourhoods send each pixel's value to the offsets of the kernel and sum where they meet: one
shuffle with map-side sums, however large the image.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.functions.phase import power, times_conjugate

PIXEL = ("prow", "pcol")
#: Machine epsilon of 32-bit floats, added to coherence's denominator.
EPSILON = 1.1920928955078125e-07


def pair_images(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """pairs (ifg_idx, early, late) with both dates' complex pixels: re1, im1, re2, im2."""
    one = images.select(F.col("date").alias("early"), *PIXEL, F.col("re").alias("re1"), F.col("im").alias("im1"))
    two = images.select(F.col("date").alias("late"), *PIXEL, F.col("re").alias("re2"), F.col("im").alias("im2"))
    return pairs.select("ifg_idx", "early", "late").join(one, "early").join(two, ["late", *PIXEL])


def interferogram(met: DataFrame, rows: int = 1, cols: int = 1) -> DataFrame:
    """Block means of one · conj(two), with both powers: (ifg_idx, prow, pcol, re, im, p1, p2); blocks that are not whole are dropped."""
    re, im = times_conjugate((F.col("re1"), F.col("im1")), (F.col("re2"), F.col("im2")))
    g = met.groupBy("ifg_idx", F.floor(F.col("prow") / rows).cast("int").alias("r"), F.floor(F.col("pcol") / cols).cast("int").alias("c"))
    out = g.agg(F.avg(re).alias("re"), F.avg(im).alias("im"), F.avg(power(F.col("re1"), F.col("im1"))).alias("p1"), F.avg(power(F.col("re2"), F.col("im2"))).alias("p2"), F.count("*").alias("n"))
    return out.filter(F.col("n") == rows * cols).drop("n").withColumnsRenamed({"r": "prow", "c": "pcol"})


def coherence(ifg: DataFrame) -> DataFrame:
    size = F.sqrt(power(F.col("re"), F.col("im")))
    return ifg.withColumn("cor", size / (EPSILON + F.sqrt("p1") * F.sqrt("p2")))


def triangle(size: int) -> list[float]:
    """Symmetric weights of an odd window: 1, 2, ..., 2, 1 over their largest."""
    if size % 2 == 0:
        raise ValueError("the window must be odd")
    half = size // 2 + 1
    return [(half - abs(k - size // 2)) / half for k in range(size)]


def gaussian(sigma: float, reach: int) -> list[float]:
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    return [x / sum(w) for x in w]


def _spread(images: DataFrame, keys: list[str], axis: str, values: list[str], weights: list[float]) -> DataFrame:
    """Each value's weighted sum along one axis; places without a pixel of their own get sums too."""
    cells = F.array(*[F.struct(F.lit(k - len(weights) // 2).alias("d"), F.lit(w).alias("w")) for k, w in enumerate(weights)])
    sent = images.select(*keys, *PIXEL, *values, F.explode(cells).alias("_k"))
    sent = sent.withColumn(axis, F.col(axis) - F.col("_k.d"))
    return sent.groupBy(*keys, *PIXEL).agg(*[F.sum(F.col("_k.w") * F.col(v)).alias(v) for v in values])


def weighted_neighbours(images: DataFrame, keys: list[str], values: list[str], rows: list[float], cols: list[float]) -> DataFrame:
    """keys, pixel, each value's weighted sum over the window around it, and w, the weights that fell on present pixels. Pixels outside
    the image count nowhere. The window is a product, so sums go along rows first and then along columns: a pixel makes
    as many rows as the window has sides, not cells."""
    base = images.select(*keys, *PIXEL, *values, F.when(F.col(values[0]).isNotNull(), 1.0).alias("w"))
    across = _spread(base, keys, "pcol", [*values, "w"], cols)
    return images.select(*keys, *PIXEL).join(_spread(across, keys, "prow", [*values, "w"], rows), [*keys, *PIXEL])


def window_coherence(met: DataFrame, size: int) -> DataFrame:
    """|Σ w one conj(two)| / √(Σ w |one|² Σ w |two|²) over a triangular window."""
    re, im = times_conjugate((F.col("re1"), F.col("im1")), (F.col("re2"), F.col("im2")))
    base = met.select("ifg_idx", *PIXEL, re.alias("re"), im.alias("im"), power(F.col("re1"), F.col("im1")).alias("p1"), power(F.col("re2"), F.col("im2")).alias("p2"))
    s = weighted_neighbours(base, ["ifg_idx"], ["re", "im", "p1", "p2"], triangle(size), triangle(size))
    return s.select("ifg_idx", *PIXEL, (F.sqrt(power(F.col("re"), F.col("im"))) / (EPSILON + F.sqrt("p1") * F.sqrt("p2"))).alias("cor"))


def smooth_present(images: DataFrame, keys: list[str], value: str, sigma: float, reach: int) -> DataFrame:
    """Gaussian mean over the present neighbours only."""
    w = gaussian(sigma, reach)
    s = weighted_neighbours(images, keys, [value], w, w)
    return s.select(*keys, *PIXEL, F.try_divide(F.col(value), F.col("w")).alias(value))


def high_pass_in_time(series: DataFrame, value: str, sigma: float, reach: int) -> DataFrame:
    """Each pixel's series less its Gaussian mean over dates; dates outside count as zero. step must count dates from 0."""
    w = Window.partitionBy(*PIXEL).orderBy("step")
    g = gaussian(sigma, reach)
    low = sum((g[k + reach] * F.coalesce(F.lead(value, k).over(w) if k >= 0 else F.lag(value, -k).over(w), F.lit(0.0)) for k in range(-reach, reach + 1)), F.lit(0.0))
    return series.withColumn(value, F.col(value) - low)


def atmosphere_filter(series: DataFrame, value: str = "value", time_sigma: float = 3, space_sigma: float = 5, time_reach: int = 12, space_reach: int = 20) -> DataFrame:
    """Atmosphere: high-pass in time, then low-pass in space over the present pixels."""
    return smooth_present(high_pass_in_time(series, value, time_sigma, time_reach), ["step"], value, space_sigma, space_reach)


def structure_tensor(images: DataFrame, keys: list[str], value: str = "value", sigma: float = 1.0, reach: int = 2) -> DataFrame:
    """Eigenvalues l1 ≥ l2 of the smoothed gradient products and coherence ((l1 - l2) / (l1 + l2))²."""
    by_row, by_col = Window.partitionBy(*keys, "prow").orderBy("pcol"), Window.partitionBy(*keys, "pcol").orderBy("prow")
    dx = (F.lead(value).over(by_row) - F.lag(value).over(by_row)) / 2
    dy = (F.lead(value).over(by_col) - F.lag(value).over(by_col)) / 2
    g = images.withColumn("_x", dx).withColumn("_y", dy).filter("_x is not null and _y is not null")
    w = gaussian(sigma, reach)
    s = weighted_neighbours(g.select(*keys, *PIXEL, (F.col("_x") * F.col("_x")).alias("xx"), (F.col("_x") * F.col("_y")).alias("xy"), (F.col("_y") * F.col("_y")).alias("yy")), keys, ["xx", "xy", "yy"], w, w)
    root = F.sqrt(F.pow(F.col("xx") - F.col("yy"), 2) + 4 * F.col("xy") * F.col("xy"))
    l1, l2 = (F.col("xx") + F.col("yy") + root) / 2, (F.col("xx") + F.col("yy") - root) / 2
    return s.select(*keys, *PIXEL, l1.alias("l1"), l2.alias("l2"), F.coalesce(F.try_divide(F.pow(l1 - l2, 2), F.pow(l1 + l2, 2)), F.lit(0.0)).alias("coherence"))


def hessian(images: DataFrame, keys: list[str], value: str = "value", sigma: float = 1.0, reach: int = 2) -> DataFrame:
    """Eigenvalues l1 ≥ l2 of the smoothed image's second differences (central differences of central differences), where
    all pixels two steps away are there; reach 0 doesn't smooth."""
    w = gaussian(sigma, reach)
    smooth = weighted_neighbours(images, keys, [value], w, w).select(*keys, *PIXEL, F.try_divide(F.col(value), F.col("w")).alias("v")) if reach else images.select(*keys, *PIXEL, F.col(value).alias("v"))
    taps = {(0, 0): (-0.5, -0.5, 0.0), (2, 0): (0.25, 0.0, 0.0), (-2, 0): (0.25, 0.0, 0.0), (0, 2): (0.0, 0.25, 0.0), (0, -2): (0.0, 0.25, 0.0)}
    taps |= {(i, j): (0.0, 0.0, 0.25 * i * j) for i in (1, -1) for j in (1, -1)}
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), *[F.lit(x).alias(n) for n, x in zip(("rr", "cc", "rc"), ws)]) for (i, j), ws in taps.items()])
    sent = smooth.filter("v is not null").select(*keys, *PIXEL, "v", F.explode(cells).alias("_k"))
    sent = sent.withColumns({"prow": F.col("prow") - F.col("_k.i"), "pcol": F.col("pcol") - F.col("_k.j")})
    s = sent.groupBy(*keys, *PIXEL).agg(F.count("*").alias("_n"), *[F.sum(F.col(f"_k.{n}") * F.col("v")).alias(n) for n in ("rr", "cc", "rc")]).filter(F.col("_n") == len(taps))
    root = F.sqrt(F.pow(F.col("rr") - F.col("cc"), 2) + 4 * F.col("rc") * F.col("rc"))
    return s.select(*keys, *PIXEL, ((F.col("rr") + F.col("cc") + root) / 2).alias("l1"), ((F.col("rr") + F.col("cc") - root) / 2).alias("l2"))


def line_votes(points: DataFrame, angles: int, step: float) -> DataFrame:
    """Hough accumulator (theta index, rho index, votes) of points (prow, pcol): each point votes once an angle."""
    a = F.explode(F.sequence(F.lit(0), F.lit(angles - 1)))
    v = points.select("prow", "pcol", a.alias("theta"))
    rad = F.col("theta") * (math.pi / angles)
    rho = F.floor((F.col("pcol") * F.cos(rad) + F.col("prow") * F.sin(rad)) / step + 0.5).cast("int")
    return v.groupBy("theta", rho.alias("rho")).agg(F.count("*").alias("votes"))


def event_stack(stack: DataFrame, pairs: DataFrame, inside, value: str = "phase", rate: bool = False, min_cor: float | None = None, scale: float = 1.0) -> DataFrame:
    """Stack of pairs around an event: sum of the present phases less their reference window's mean, over their count (or over their days), zero where the mean correlation is low."""
    met = stack.join(F.broadcast(pairs.select("ifg_idx", F.col("dt_days").cast("double").alias("_dt"))), "ifg_idx")
    x = F.when(~F.isnan(value), F.col(value))
    aggs = [F.coalesce(F.sum(x), F.lit(0.0)).alias("total"), F.count(x).alias("n"), F.coalesce(F.sum(F.when(x.isNotNull(), F.col("_dt"))), F.lit(0.0)).alias("days")]
    aggs += [F.avg("cor").alias("cor")] if min_cor is not None else []
    s = met.groupBy(*PIXEL).agg(*aggs)
    ref = s.filter(inside).agg(F.avg("total").alias("ref"))
    out = s.join(F.broadcast(ref)).withColumn("stacked", F.try_divide((F.col("total") - F.col("ref")) * scale, F.col("days" if rate else "n")))
    if min_cor is not None:
        out = out.withColumn("stacked", F.when(F.col("cor") < min_cor, 0.0).otherwise(F.col("stacked")))
    return out.select(*PIXEL, "stacked", "n", "days")
