"""Acquisition dates and date pairs: deriving, pairing, filtering, matrices.

Tables here are small (dates, pairs); pair conditions that are ranges are rewritten into equal joins on
bins, so nothing plans as a nested loop however long the lists are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dates_of(pairs: DataFrame) -> DataFrame:
    """Sorted distinct endpoints, numbered from 0: (slc_idx, date)."""
    both = pairs.select(F.explode(F.array("early", "late")).alias("date")).distinct()
    return both.select((F.row_number().over(Window.orderBy("date")) - 1).cast("int").alias("slc_idx"), "date")


def span(early: str = "early", late: str = "late") -> Column:
    return F.datediff(late, early)


def ranked(dates: DataFrame) -> DataFrame:
    return dates.select("date", (F.dense_rank().over(Window.orderBy("date")) - 1).cast("int").alias("rank"))


def pairs_within(dates: DataFrame, most: int) -> DataFrame:
    """Each date with the next `most` dates: (early, late), by equal joins on ranks."""
    d = ranked(dates.select("date").distinct())
    later = d.select(F.col("date").alias("late"), F.col("rank").alias("to"))
    step = d.select(F.col("date").alias("early"), F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + most)).alias("to"))
    return step.join(later, "to").select("early", "late")


def all_pairs(dates: DataFrame) -> DataFrame:
    """Every early < late, numbered early-major: (ifg_idx, early, late, dt_days). One sorted list of the dates, no join."""
    d = dates.agg(F.array_sort(F.collect_set("date")).alias("ds")).select("ds", F.posexplode("ds").alias("i", "early"))
    return numbered(d.select("early", F.explode(F.slice("ds", F.col("i") + 2, F.size("ds"))).alias("late")))


def pinned(small: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A table of dates or pairs as local rows, so that plans that use it often don't make it anew each time; a longer one stays as it is."""
    rows = small.limit(most + 1).collect()
    return small if len(rows) > most else small.sparkSession.createDataFrame(rows, small.schema)


def numbered(pairs: DataFrame) -> DataFrame:
    w = Window.orderBy("early", "late")
    return pairs.select((F.row_number().over(w) - 1).cast("int").alias("ifg_idx"), "early", "late", span().alias("dt_days"))


def between_dates(pairs: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Strictly inside on both members."""
    if low:
        pairs = pairs.filter((F.col("early") > F.lit(low).cast("date")) & (F.col("late") > F.lit(low).cast("date")))
    if high:
        pairs = pairs.filter((F.col("early") < F.lit(high).cast("date")) & (F.col("late") < F.lit(high).cast("date")))
    return pairs


def without_dates(pairs: DataFrame, ignored: DataFrame) -> DataFrame:
    """Pairs neither of whose dates is ignored."""
    for side in ("early", "late"):
        pairs = pairs.join(ignored.select(F.col("date").alias(side)).distinct(), side, "left_anti")
    return pairs


def bandwidth(pairs: DataFrame) -> DataFrame:
    """pairs plus steps: how many acquisitions (of these pairs' dates) later the second member is."""
    rank = dates_of(pairs)
    for side in ("early", "late"):
        pairs = pairs.join(F.broadcast(rank.select(F.col("date").alias(side), F.col("slc_idx").alias(f"_{side}"))), side)
    return pairs.withColumn("steps", F.col("_late") - F.col("_early")).drop("_early", "_late")


def is_annual(tolerance: int = 30) -> Column:
    return F.abs(span() - 365) <= tolerance


def filter_network(pairs: DataFrame, low: str | None = None, high: str | None = None, ignored: DataFrame | None = None, max_days: int | None = None, max_steps: int | None = None, min_steps: int | None = None, annual: bool = False, annual_tolerance: int = 30) -> tuple[DataFrame, DataFrame]:
    """(dates, pairs) that stay; pairs keep their ifg_idx. Near-annual pairs pass the length limits if `annual`."""
    pairs = between_dates(pairs, low, high)
    if ignored is not None:
        pairs = without_dates(pairs, ignored)
    ok = F.lit(True)
    if max_days is not None:
        ok &= span() <= max_days
    if max_steps is not None or min_steps is not None:
        pairs = bandwidth(pairs)
        ok &= F.col("steps").between(min_steps or 0, max_steps if max_steps is not None else 1 << 30)
    if annual:
        ok |= is_annual(annual_tolerance)
    kept = pairs.filter(ok)
    return dates_of(kept), kept


def short_pairs(dates: DataFrame, max_days: int, max_spatial: float | None = None) -> DataFrame:
    """Pairs at most so many days (and so much of `position`) apart.

    A range join as an equal join: each date goes to its bin of max_days, each later member to its own
    and the one before.
    """
    d = dates.withColumn("_day", F.unix_date("date")).withColumn("_bin", F.floor(F.col("_day") / max_days))
    a = d.select(F.col("date").alias("early"), F.col("_day").alias("_a"), "_bin", *([F.col("position").alias("_pa")] if max_spatial is not None else []))
    b = d.select(F.col("date").alias("late"), F.col("_day").alias("_b"), F.explode(F.array(F.col("_bin"), F.col("_bin") - 1)).alias("_bin"), *([F.col("position").alias("_pb")] if max_spatial is not None else []))
    met = a.join(b, "_bin").filter((F.col("_b") > F.col("_a")) & (F.col("_b") - F.col("_a") <= max_days))
    if max_spatial is not None:
        met = met.filter(F.abs(F.col("_pb") - F.col("_pa")) <= max_spatial)
    return met.select("early", "late")


def closure_triplets(pairs: DataFrame) -> DataFrame:
    """(d1, d2, d3) with pairs 12, 23 and 13 all there, and their ifg_idx."""
    a = pairs.select(F.col("early").alias("d1"), F.col("late").alias("d2"), F.col("ifg_idx").alias("i12"))
    b = pairs.select(F.col("early").alias("d2"), F.col("late").alias("d3"), F.col("ifg_idx").alias("i23"))
    c = pairs.select(F.col("early").alias("d1"), F.col("late").alias("d3"), F.col("ifg_idx").alias("i13"))
    return a.join(b, "d2").join(c, ["d1", "d3"]).select("d1", "d2", "d3", "i12", "i23", "i13")


def incidence(pairs: DataFrame) -> DataFrame:
    """Long A matrix (ifg_idx, k, v): -1 at the early date, +1 at the late one, the first date left out (k counts from 0 at the second)."""
    d = dates_of(pairs)
    ends = pairs.select("ifg_idx", F.explode(F.array(F.struct(F.col("early").alias("date"), F.lit(-1).alias("v")), F.struct(F.col("late").alias("date"), F.lit(1).alias("v")))).alias("e")).select("ifg_idx", "e.*")
    return ends.join(F.broadcast(d), "date").filter("slc_idx > 0").select("ifg_idx", (F.col("slc_idx") - 1).alias("k"), "v")


def date_steps(dates: DataFrame) -> DataFrame:
    """(k, dt): days between consecutive dates."""
    w = Window.orderBy("date")
    return dates.select((F.row_number().over(w) - 2).cast("int").alias("k"), F.datediff("date", F.lag("date").over(w)).alias("dt")).filter("k >= 0")


def velocity_matrix(pairs: DataFrame, linear: bool = False) -> DataFrame:
    """Long B matrix (ifg_idx, k, v): the length of each interval inside the pair; linear: their sum alone."""
    if linear:
        return pairs.select("ifg_idx", F.lit(0).alias("k"), span().alias("v"))
    d = dates_of(pairs)
    for side in ("early", "late"):
        pairs = pairs.join(F.broadcast(d.select(F.col("date").alias(side), F.col("slc_idx").alias(f"_{side}"))), side)
    inside = pairs.select("ifg_idx", F.explode(F.sequence("_early", F.col("_late") - 1)).alias("k"))
    return inside.join(F.broadcast(date_steps(d)), "k").select("ifg_idx", "k", F.col("dt").alias("v"))


def subset_matrix(matrix: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Entries of the given ifg_idx and k."""
    return matrix.join(rows.select("ifg_idx").distinct(), "ifg_idx", "left_semi").join(cols.select("k").distinct(), "k", "left_semi")


def difference_matrix(spark, n: int, order: int = 1) -> DataFrame:
    """Long (i, j, v). Order 1: (n - 1) x n, +1 then -1. Order 2: n x n, 2 on the diagonal (1 at both ends) with -1 beside it."""
    i = spark.range(n - 1 if order == 1 else n).select(F.col("id").cast("int").alias("i"))
    if order == 1:
        cells = F.array(F.struct(F.col("i").alias("j"), F.lit(1).alias("v")), F.struct((F.col("i") + 1).alias("j"), F.lit(-1).alias("v")))
        return i.select("i", F.explode(cells).alias("c")).select("i", "c.*")
    edge = (F.col("i") == 0) | (F.col("i") == n - 1)
    cells = [F.struct((F.col("i") + d).cast("int").alias("j"), (F.lit(-1) if d else F.when(edge, 1).otherwise(2)).alias("v")) for d in (-1, 0, 1)]
    return i.select("i", F.explode(F.array(*cells)).alias("c")).select("i", "c.*").filter(F.col("j").between(0, n - 1))


def polynomial(days: Column, degree: int) -> Column:
    """[1, t, t², ...]"""
    return F.transform(F.sequence(F.lit(0), F.lit(degree)), lambda k: F.pow(days, k))


def merge_baselines(pairs: DataFrame, baselines: DataFrame) -> DataFrame:
    """pairs with the baselines (slc1, slc2, temporal, spatial) that are known."""
    return pairs.join(baselines.withColumnsRenamed({"slc1": "early", "slc2": "late"}), ["early", "late"])


def pair_index(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (early, late) with ifg_idx; a pair that isn't there is an error."""
    met = wanted.join(pairs.select("early", "late", "ifg_idx"), ["early", "late"], "left")
    gone = F.raise_error(F.concat(F.lit("no such pair: "), F.col("early").cast("string"), F.lit(" "), F.col("late").cast("string")))
    return met.withColumn("ifg_idx", F.coalesce("ifg_idx", gone.cast("int")))


def straddling(dates: DataFrame, event: str, n: int) -> DataFrame:
    """The n dates before the event, each paired with the date that comes as many places after it: (early, late)."""
    e = F.lit(event).cast("date")
    before = dates.filter(F.col("date") < e).select(F.col("date").alias("early"), F.row_number().over(Window.orderBy(F.desc("date"))).alias("_r"))
    after = dates.filter(F.col("date") > e).select(F.col("date").alias("late"), F.row_number().over(Window.orderBy("date")).alias("_r"))
    first = before.filter(F.col("_r") <= n).select("early", (n + 1 - F.col("_r")).alias("_r"))
    return first.join(after, "_r").select("early", "late")


def before_event(pairs: DataFrame, event: str) -> DataFrame:
    e = F.lit(event).cast("date")
    return pairs.filter((F.col("early") < e) & (F.col("late") < e))


def after_event(pairs: DataFrame, event: str) -> DataFrame:
    e = F.lit(event).cast("date")
    return pairs.filter((F.col("early") > e) & (F.col("late") > e))


def crosses(event: str) -> Column:
    """1 if both members are after the event, else 0: the jump column of the linear-and-jump model."""
    e = F.lit(event).cast("date")
    return ((F.col("early") > e) & (F.col("late") > e)).cast("int")


def temporal_weights(pairs: DataFrame) -> DataFrame:
    """1 / √dt, the largest made 1."""
    w = 1 / F.sqrt(span())
    return pairs.withColumn("weight", w / F.max(w).over(Window.partitionBy(F.lit(0))))
