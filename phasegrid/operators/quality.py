"""Quality measures: coherence, peak-to-peak, closure, ambiguities, unwrapping errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.functions.phase import ambiguity, angle, rewrap
from phasegrid.session import made_once

PIXEL = ("prow", "pcol")


def correlation_summary(cor: DataFrame, threshold: float | None = None, weight: str | None = None) -> DataFrame:
    """Mean (weighted if told; of the values at or over a threshold) and population deviation a pixel."""
    x = F.col("cor") if threshold is None else F.when(F.col("cor") >= threshold, F.col("cor"))
    mean = F.avg(x) if weight is None else F.sum(F.col(weight) * x) / F.sum(F.when(x.isNotNull(), F.col(weight)))
    return cor.groupBy(*PIXEL).agg(mean.alias("cor_mean"), F.stddev_pop("cor").alias("cor_std"))


def mean_of_pairs(cor: DataFrame, pairs: DataFrame) -> DataFrame:
    return cor.join(F.broadcast(pairs.select("ifg_idx").distinct()), "ifg_idx", "left_semi").groupBy(*PIXEL).agg(F.avg("cor").alias("cor_mean"))


def phasor_coherence(phase: Column) -> Column:
    """|Σ exp(i phase)| / n, to aggregate with."""
    return F.sqrt(F.pow(F.sum(F.cos(phase)), 2) + F.pow(F.sum(F.sin(phase)), 2)) / F.count("*")


def wrapped_coherence(stack: DataFrame) -> DataFrame:
    """Of complex pixels (prow, pcol, re, im)."""
    return stack.groupBy(*PIXEL).agg(phasor_coherence(angle(F.col("re"), F.col("im"))).alias("temp_coh"))


#: Bins of the histogram that finds where a percentile lies.
BINS = 4096


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys, p0, p1, ...: the interpolated percentiles of the present values of each group, exactly.

    No task gets a group: a histogram (combined before the shuffle) tells which bins hold the two ranks that a
    percentile lies between, and only the distinct values of those bins are sorted. Groups without values have nulls.
    The rows are made once and kept, as all passes must see the same values: sums of doubles differ in their last bits
    each time that they are made, and a least value that moves leaves its bin.
    """
    rows = made_once(rows.select(*keys, F.col(value).cast("double").alias("_v")))
    present = rows.filter("_v is not null and not isnan(_v)")
    stats = present.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    met = present.join(stats, keys) if keys else present.join(F.broadcast(stats))  # one row without keys
    bin_ = F.when(F.col("_high") > F.col("_low"), F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BINS), F.lit(BINS - 1))).otherwise(0)
    met = met.withColumn("_bin", bin_)
    wants = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(p) * (F.col("_n") - 1)), F.ceil(F.lit(p) * (F.col("_n") - 1))) for p in shares])))

    def ranked(counted: DataFrame, group: list[str], by: str) -> DataFrame:
        """Rows that hold a wanted rank, and how many values lie before them; at most BINS rows a group, or the values of a few bins."""
        order = Window.partitionBy(*[F.col(k) for k in group] or [F.lit(0)]).orderBy(by)
        before = F.coalesce(F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counted.withColumn("_before", before + F.col("_start")).filter(F.exists("_wants", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c"))))

    bins = ranked(met.groupBy(*keys, "_bin").agg(F.count("*").alias("_c"), F.first(wants).alias("_wants")).withColumn("_start", F.lit(0)), keys, "_bin")
    found = met.join(bins.select(*keys, "_bin", F.col("_before").alias("_at"), "_wants"), [*keys, "_bin"])
    inner = found.groupBy(*keys, "_bin", "_v").agg(F.count("*").alias("_c"), F.first("_at").alias("_start"), F.first("_wants").alias("_wants"), F.first("_n").alias("_n"))
    values = ranked(inner, [*keys, "_bin"], "_v")
    out = []
    for k, p in enumerate(shares):
        place = F.lit(p) * (F.col("_n") - 1)

        def at(rank):
            return F.max(F.when((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_c")), F.col("_v")))

        low, high = at(F.floor(place)), at(F.ceil(place))
        share = F.max(place - F.floor(place))
        out.append((low + (high - low) * share).alias(f"p{k}"))
    made = values.groupBy(*keys).agg(*out)
    return rows.select(*keys).distinct().join(made, keys, "left") if keys else made


def peak_to_peak(stack: DataFrame, key: str, value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Range of each image, or between two percentiles of it."""
    if low is None:
        return stack.groupBy(key).agg((F.max(value) - F.min(value)).alias("ptp"))
    p = percentiles(stack, [key], value, [low, high])
    return p.select(key, (F.col("p1") - F.col("p0")).alias("ptp"))


def closure(stack: DataFrame, triplets: DataFrame, value: str = "phase", wrapped: bool = False) -> DataFrame:
    """φ12 + φ23 - φ13 of each triplet and pixel: each phase goes to its triplets and is summed there with its sign. Triplets
    grow with the cube of the dates, so it's left to their size whether they are broadcast."""
    ends = triplets.select("d1", "d2", "d3", F.explode(F.array(F.struct(F.col("i12").alias("ifg_idx"), F.lit(1.0).alias("s")), F.struct(F.col("i23").alias("ifg_idx"), F.lit(1.0).alias("s")), F.struct(F.col("i13").alias("ifg_idx"), F.lit(-1.0).alias("s")))).alias("e")).select("d1", "d2", "d3", "e.*")
    out = stack.join(ends, "ifg_idx").groupBy("d1", "d2", "d3", *PIXEL).agg(F.sum(F.col("s") * F.col(value)).alias("closure"), F.count(value).alias("_n")).filter("_n = 3").drop("_n")
    return out.withColumn("closure", rewrap(F.col("closure"))) if wrapped else out


def closure_ambiguity(closures: DataFrame) -> DataFrame:
    return closures.withColumn("turns", ambiguity(F.col("closure")))


def ambiguity_count(closures: DataFrame) -> DataFrame:
    return closure_ambiguity(closures).groupBy(*PIXEL).agg(F.sum((F.col("turns") != 0).cast("int")).alias("n_ambiguous"))


def unwrapping_error(stack: DataFrame, keys: list[str], value: str = "phase", mask: str = "mask") -> DataFrame:
    """Sum of jumps of π or more between neighbours along rows and columns, where the first of the two is in the mask."""
    right = F.lead(value).over(Window.partitionBy(*keys, "prow").orderBy("pcol"))
    down = F.lead(value).over(Window.partitionBy(*keys, "pcol").orderBy("prow"))

    def jump(other: str) -> Column:
        d = F.abs(F.col(value) - F.col(other))
        return F.sum(F.when(F.col(mask) & (d >= 3.141592653589793), d).otherwise(0.0))

    met = stack.withColumn("_right", right).withColumn("_down", down)
    return met.groupBy(*keys).agg((jump("_right") + jump("_down")).alias("error"))
