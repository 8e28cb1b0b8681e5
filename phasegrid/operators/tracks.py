"""Several tracks and dates: decomposition, merging, differencing, referencing to stations, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ("prow", "pcol")


def los_mask(history: DataFrame, quality: DataFrame, value: str, max_missing: int | None = None, min_cor: float | None = None, min_coh: float | None = None) -> DataFrame:
    """Zero on every date where the pixel misses too much or is too incoherent."""
    bad = F.lit(False)
    for col, limit, over in (("missing", max_missing, True), ("cor_mean", min_cor, False), ("temp_coh", min_coh, False)):
        if limit is not None:
            bad |= (F.col(col) > limit) if over else (F.col(col) < limit)
    marks = quality.select(*PIXEL, F.coalesce(bad, F.lit(False)).alias("_bad"))
    return history.join(marks, list(PIXEL)).withColumn(value, F.when(F.col("_bad"), 0.0).otherwise(F.col(value))).drop("_bad")


def east_up(asc: DataFrame, desc: DataFrame, keys: list[str], value: str = "los") -> DataFrame:
    """East and up of two lines of sight, north left out: each side has keys, value, e, u."""
    a = asc.select(*keys, F.col(value).alias("a"), F.col("e").alias("ea"), F.col("u").alias("ua"))
    d = desc.select(*keys, F.col(value).alias("d"), F.col("e").alias("ed"), F.col("u").alias("ud"))
    det = F.col("ea") * F.col("ud") - F.col("ed") * F.col("ua")
    east = F.try_divide(F.col("a") * F.col("ud") - F.col("d") * F.col("ua"), det)
    up = F.try_divide(F.col("ea") * F.col("d") - F.col("ed") * F.col("a"), det)
    return a.join(d, keys).select(*keys, east.alias("east"), up.alias("up"))


def merge_blended(west: DataFrame, east: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Both where only one is there; in the overlap a linear ramp from west to east over its columns."""
    both = west.select(*keys, *PIXEL, F.col(value).alias("w")).join(east.select(*keys, *PIXEL, F.col(value).alias("e")), [*keys, *PIXEL], "full_outer")
    lap = both.filter("w is not null and e is not null").groupBy(*keys).agg(F.min("pcol").alias("_l"), F.max("pcol").alias("_h"))
    t = F.when(F.col("_h") > F.col("_l"), (F.col("pcol") - F.col("_l")) / (F.col("_h") - F.col("_l"))).otherwise(0.5)
    mixed = F.when(F.col("w").isNull(), F.col("e")).when(F.col("e").isNull(), F.col("w")).otherwise((1 - t) * F.col("w") + t * F.col("e"))
    return both.join(F.broadcast(lap), keys, "left").select(*keys, *PIXEL, mixed.alias(value))


def overlay(top: DataFrame, bottom: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The top image where it has data (not null, not zero), else the bottom one."""
    t = top.select(*keys, F.when(F.col(value) != 0, F.col(value)).alias("_t"))
    return t.join(bottom.select(*keys, F.col(value).alias("_b")), keys, "full_outer").select(*keys, F.coalesce("_t", "_b", F.lit(0.0)).alias(value))


def overlap_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    x = a.filter(F.col(value) != 0).select(*keys, F.col(value).alias("_a"))
    return x.join(b.filter(F.col(value) != 0).select(*keys, F.col(value).alias("_b")), keys).select(*keys, (F.col("_a") - F.col("_b")).alias("difference"))


def stitch(parts: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Of several images of one date, the first that has data at a pixel."""
    return parts.groupBy(*keys).agg(F.coalesce(F.min_by(value, F.when(F.col(value) != 0, F.col(order))), F.lit(0.0)).alias(value))


def lag_difference(history: DataFrame, keys: list[str], order: str, value: str, steps: list[int]) -> DataFrame:
    """value minus the one `step` dates before, for each step."""
    w = Window.partitionBy(*keys).orderBy(order)
    diffs = F.array(*[F.struct(F.lit(k).alias("step"), (F.col(value) - F.lag(value, k).over(w)).alias("difference")) for k in steps])
    return history.select(*keys, order, diffs.alias("_d")).select(*keys, order, F.explode("_d").alias("_d")).select(*keys, order, "_d.*").filter("difference is not null")


def since_first(history: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return history.withColumn(value, F.col(value) - F.first_value(value).over(w))


def daily(series: DataFrame, key: str, value: str) -> DataFrame:
    """One row a day from each key's first to its last date, the last known value carried on."""
    ends = series.groupBy(key).agg(F.min("date").alias("a"), F.max("date").alias("b")).select(key, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return ends.join(series.select(key, "date", value), [key, "date"], "left").withColumn(value, F.last(value, True).over(w))


def centred_mean(series: DataFrame, key: str, value: str, days: int) -> DataFrame:
    """Rolling mean over `days` rows, of which days / 2 are before; fewer at the ends."""
    w = Window.partitionBy(key).orderBy("date").rowsBetween(-(days // 2), days - days // 2 - 1)
    return series.withColumn(value, F.avg(value).over(w))


def reference_to_station(history: DataFrame, station: DataFrame, at: Column, days: int = 720) -> DataFrame:
    """history (prow, pcol, date, value) plus, per date, station minus image at the station's pixel; exact zeros stay, and any unknown correction cancels all of them.

    station: (name, date, value), one name.
    """
    gps = centred_mean(daily(station, "name", "value"), "name", "value", days).select("date", F.col("value").alias("_g"))
    off = history.filter(at).select("date", F.col("value").alias("_i")).join(gps, "date").select("date", (F.col("_g") - F.col("_i")).alias("_c"))
    gone = off.agg(F.coalesce(F.max(F.col("_c").isNull() | F.isnan("_c")), F.lit(False)).alias("_gone"))
    met = history.join(F.broadcast(off), "date", "inner").join(F.broadcast(gone))
    c = F.when(F.col("_gone"), 0.0).otherwise(F.col("_c"))
    return met.withColumn("value", F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.col("value") + c)).drop("_c", "_gone")


def resample(history: DataFrame, keys: list[str], value: str, targets: DataFrame) -> DataFrame:
    """Values at target dates, linear between the dates around them; targets outside are left out."""
    known = history.select(*keys, "date", F.col(value).alias("_v"))
    ask = history.select(*keys).distinct().join(F.broadcast(targets.select("date").distinct())).withColumn("_v", F.lit(None).cast("double")).withColumn("_ask", F.lit(True))
    rows = known.withColumn("_ask", F.lit(False)).unionByName(ask)
    day = F.unix_date("date")
    back = Window.partitionBy(*keys).orderBy("date", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("date", F.desc("_ask")).rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col("_v").isNotNull(), F.struct(day.alias("d"), F.col("_v").alias("v")))
    met = rows.withColumn("_p", F.last(here, True).over(back)).withColumn("_n", F.first(here, True).over(ahead)).filter("_ask and _p is not null and _n is not null")
    mix = F.when(F.col("_n.d") == F.col("_p.d"), F.col("_p.v")).otherwise(F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (day - F.col("_p.d")) / (F.col("_n.d") - F.col("_p.d")))
    return met.select(*keys, "date", mix.alias(value))


def project(east: Column, north: Column, up: Column, e: Column, n: Column, u: Column) -> Column:
    """Along a line of sight."""
    return east * e + north * n + up * u
