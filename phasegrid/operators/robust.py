"""Robust trends of point series: medians of pair slopes, deviations, plain regressions.

Series are (key, x, y). Slopes come from all pairs of a series' own points, joined on the key (and on
bins of the span where only spans near a period count).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1.4826


def pair_slopes(series: DataFrame, key: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """(key, slope, span) of all pairs x < x'; with limits only spans between them, met through bins of their width."""
    a = series.select(key, F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = series.select(key, F.col("x").alias("x2"), F.col("y").alias("y2"))
    on = [key]
    if low is not None:
        width = max(high - low, 1e-9)
        a = a.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("x1") + low) / width), F.floor((F.col("x1") + high) / width))))
        b = b.withColumn("_bin", F.floor(F.col("x2") / width))
        on = [key, "_bin"]
    met = a.join(b, on).filter("x2 > x1").withColumn("span", F.col("x2") - F.col("x1"))
    if low is not None:
        met = met.filter(F.col("span").between(low, high))
    # a null condition on the slope may be pushed below the filter: no error for equal x then
    return met.select(key, F.try_divide(F.col("y2") - F.col("y1"), F.col("span")).alias("slope"), "span")


def median_of(sorted_values: Column) -> Column:
    """Median of a sorted array; null for an empty one."""
    n = F.size(sorted_values)
    low, high = F.floor((n + 1) / 2).cast("int"), (F.floor(n / 2) + 1).cast("int")
    return F.when(n > 0, (F.element_at(sorted_values, F.greatest(low, F.lit(1))) + F.element_at(sorted_values, F.least(high, n))) / 2)


def spread_of(values: Column, middle: Column) -> Column:
    """Scaled median absolute deviation."""
    return SCALE * median_of(F.array_sort(F.transform(values, lambda x: F.abs(x - middle))))


def sorted_slopes(slopes: DataFrame, key: str) -> DataFrame:
    """(key, s): each series' slopes as one sorted array; medians of medians then need no further pass over the pairs."""
    return slopes.groupBy(key).agg(F.array_sort(F.collect_list("slope")).alias("s"))


def median_trend(series: DataFrame, arrays: DataFrame, key: str) -> DataFrame:
    """Median slope, intercept (median of y - slope x), sigma (scaled median deviation) and formal error."""
    t = arrays.filter(F.size("s") > 0).withColumn("slope", median_of(F.col("s")))
    t = t.select(key, "slope", spread_of(F.col("s"), F.col("slope")).alias("sigma"), F.size("s").alias("n"))
    points = series.groupBy(key).agg(F.collect_list(F.struct("x", "y")).alias("p"))
    met = t.join(points, key)
    icpt = median_of(F.array_sort(F.transform("p", lambda p: p["y"] - F.col("slope") * p["x"])))
    error = 3 * F.sqrt(F.lit(1.5707963267948966)) * F.col("sigma") / F.sqrt(F.col("n") / 4)
    return met.select(key, "slope", icpt.alias("intercept"), "sigma", error.alias("error"))


def theil_sen(series: DataFrame, key: str) -> DataFrame:
    return median_trend(series, sorted_slopes(pair_slopes(series, key), key), key)


def interannual(series: DataFrame, key: str, period: float, tolerance: float, multiple: float | None = None) -> DataFrame:
    """Only spans near `multiple` periods, or near any whole number of them."""
    if multiple is not None:
        s = pair_slopes(series, key, period * multiple - tolerance, period * multiple + tolerance)
    else:
        over = F.pmod("span", F.lit(period))
        s = pair_slopes(series, key).filter((over <= tolerance) | (period - over <= tolerance))
    return median_trend(series, sorted_slopes(s, key), key)


def midas(series: DataFrame, key: str, period: float, tolerance: float) -> DataFrame:
    """Spans near one period; slopes more than two sigma from the median are left out once."""
    s = sorted_slopes(pair_slopes(series, key, period - tolerance, period + tolerance), key).withColumn("_m", median_of(F.col("s"))).withColumn("_s", spread_of(F.col("s"), F.col("_m")))
    kept = F.filter("s", lambda x: x.between(F.col("_m") - 2 * F.col("_s"), F.col("_m") + 2 * F.col("_s")))
    return median_trend(series, s.select(key, kept.alias("s")), key)


def deviation_cutoff(rows: DataFrame, key: str, value: str, times: float) -> DataFrame:
    """Median, median absolute deviation, and median(|x|) + times · deviation."""
    m = rows.groupBy(key).agg(F.median(value).alias("median"), F.median(F.abs(value)).alias("_a"))
    d = rows.join(m, key).groupBy(key, "median", "_a").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return d.select(key, "median", "mad", (SCALE * F.col("mad")).alias("sigma"), (F.col("_a") + times * F.col("mad")).alias("cutoff"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    b = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return rows.filter(F.col(value).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def regressions(series: DataFrame, key: str) -> DataFrame:
    """Slope and intercept; slope through the origin with its error."""
    through = F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))
    rss = F.sum(F.col("y") * F.col("y")) - F.pow(F.sum(F.col("x") * F.col("y")), 2) / F.sum(F.col("x") * F.col("x"))
    return series.groupBy(key).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), through.alias("slope0"), F.sqrt(rss / (F.count("*") - 1) / F.sum(F.col("x") * F.col("x"))).alias("error0"))


def rms_and_max(rows: DataFrame, key: str, value: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.sqrt(F.avg(value * value)).alias("rms"), F.max(F.abs(value)).alias("max_abs"))


def last_mean(series: DataFrame, key: str, n: int = 3) -> DataFrame:
    """Mean of the last n values."""
    w = Window.partitionBy(key).orderBy(F.desc("x"))
    return series.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).groupBy(key).agg(F.avg("y").alias("mean"))
