"""Robust trends and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasegrid.functions import names
from phasegrid.operators import robust
from phasegrid.queries.cubes import CUBE_L, cube_l, query, six, table

#: Monthly means of each supplier column as a series: x in years.
POINTS = """pts AS (SELECT CAST(l_suppkey % 8 AS INTEGER) AS key, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1) / CAST(12 AS DOUBLE) AS x, avg(l_extendedprice) * CAST(0.000987654321 AS DOUBLE) AS y FROM lineitem GROUP BY 1, 2),
pairs AS (SELECT a.key, (b.y - a.y) / (b.x - a.x) AS slope, b.x - a.x AS span FROM pts a JOIN pts b ON b.key = a.key AND b.x > a.x)"""


def _points(spark, sf):
    x = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1) / F.lit(12.0)
    return table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 8).cast("int").alias("key"), x.alias("x")).agg((F.avg("l_extendedprice") * F.lit(0.000987654321)).alias("y"))


def _trend_sql(kept: str) -> str:
    return f"""WITH {POINTS}, kept AS ({kept}), m AS (SELECT key, median(slope) AS slope, count(*) AS n FROM kept GROUP BY 1),
d AS (SELECT key, 1.4826::DOUBLE * median(abs(k.slope - m.slope)) AS sigma FROM kept k JOIN m USING (key) GROUP BY 1), i AS (SELECT key, median(y - slope * x) AS intercept FROM pts JOIN m USING (key) GROUP BY 1)
SELECT key, round(slope, 5) + 0.0 AS slope, round(intercept, 5) + 0.0 AS intercept, round(sigma, 5) + 0.0 AS sigma, round(3 * sqrt(pi() / 2) * sigma / sqrt(n / 4.0), 5) + 0.0 AS error FROM m JOIN d USING (key) JOIN i USING (key)"""


def _five(df):
    return df.select("key", *[(F.round(c, 5) + 0.0).alias(c) for c in ("slope", "intercept", "sigma", "error")])


@query(_trend_sql("SELECT * FROM pairs"))
def theil_sen(spark, sf):
    return _five(robust.theil_sen(_points(spark, sf), "key"))


@query(_trend_sql("SELECT * FROM pairs WHERE span - floor(span) <= 0.1::DOUBLE OR 1 - (span - floor(span)) <= 0.1::DOUBLE"))
def theil_sen_interannual(spark, sf):
    return _five(robust.interannual(_points(spark, sf), "key", 1.0, 0.1))


@query(_trend_sql("SELECT * FROM pairs WHERE span BETWEEN 1.9::DOUBLE AND 2.1::DOUBLE"))
def theil_sen_two_years(spark, sf):
    return _five(robust.interannual(_points(spark, sf), "key", 1.0, 0.1, 2.0))


@query(_trend_sql("SELECT p.* FROM (SELECT * FROM pairs WHERE span BETWEEN 0.9::DOUBLE AND 1.1::DOUBLE) p JOIN (SELECT key, a.m, 1.4826::DOUBLE * median(abs(slope - a.m)) AS s FROM pairs JOIN (SELECT key, median(slope) AS m FROM pairs WHERE span BETWEEN 0.9::DOUBLE AND 1.1::DOUBLE GROUP BY 1) a USING (key) WHERE span BETWEEN 0.9::DOUBLE AND 1.1::DOUBLE GROUP BY 1, 2) b USING (key) WHERE slope BETWEEN m - 2 * s AND m + 2 * s"))
def midas(spark, sf):
    return _five(robust.midas(_points(spark, sf), "key", 1.0, 0.1))


@query(f"WITH {POINTS}, s AS (SELECT key, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, count(*) AS n FROM pts GROUP BY 1) SELECT key, round(slope, 5) + 0.0 AS slope, round(intercept, 5) + 0.0 AS intercept, round(xy / xx, 5) + 0.0 AS slope0, round(sqrt((yy - xy * xy / xx) / (n - 1) / xx), 5) + 0.0 AS error0 FROM s")
def ols_regressions(spark, sf):
    r = robust.regressions(_points(spark, sf), "key")
    return r.select("key", *[(F.round(c, 5) + 0.0).alias(c) for c in ("slope", "intercept", "slope0", "error0")])


@query(f"WITH {CUBE_L}, m AS (SELECT prow, median(value) AS median, median(abs(value)) AS a FROM cube_l GROUP BY 1), d AS (SELECT prow, m.median, a, median(abs(value - m.median)) AS mad FROM cube_l JOIN m USING (prow) GROUP BY 1, 2, 3) SELECT prow, round(median, 6) + 0.0 AS median, round(mad, 6) + 0.0 AS mad, round(1.4826 * mad, 6) + 0.0 AS sigma, round(a + 3 * mad, 6) + 0.0 AS cutoff FROM d")
def mad_cutoff(spark, sf):
    return six(robust.deviation_cutoff(cube_l(spark, sf), "prow", "value", 3), "median", "mad", "sigma", "cutoff")


@query("SELECT CAST(least(floor((l_extendedprice - 0) / (110000.0::DOUBLE / 22)), 21) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 110000 GROUP BY 1")
def histogram(spark, sf):
    return robust.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 0.0, 110000.0, 22)


@query("SELECT hour(ts) AS hour, event_type, count(*) AS n, round(avg(hour(ts) + minute(ts) / 60 + second(ts) / 3600), 6) + 0.0 AS clock FROM events GROUP BY 1, 2")
def counts_by_hour(spark, sf):
    e = table(spark, sf, "events")
    return six(e.groupBy(F.hour("ts").cast("bigint").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.avg(names.hour_of_day(F.col("ts"))).alias("clock")), "clock")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand")
def groups_by_count(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand")


@query("SELECT p_size // 10 AS threshold, p_brand, count(*) AS n, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY 1, 2")
def feature_counts(spark, sf):
    return table(spark, sf, "part").groupBy(F.expr("cast(p_size div 10 as int)").alias("threshold"), "p_brand").agg(F.count("*").alias("n"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


@query()
def looks_and_phase_spread(spark, sf):
    """Spread of the phase of averaged random complex numbers, by looks (seeded)."""
    from phasegrid.operators import pixels

    out = None
    for looks in (1, 2, 4):
        g = spark.range(64 * 64).select((F.col("id") / 64).cast("int").alias("prow"), (F.col("id") % 64).cast("int").alias("pcol"), (F.randn(1) + 1).alias("re"), F.randn(2).alias("im"))
        m = pixels.multilook(g.withColumn("k", F.lit(0)), ["k"], "re", looks, looks).join(pixels.multilook(g.withColumn("k", F.lit(0)), ["k"], "im", looks, looks), ["k", "prow", "pcol"])
        s = m.agg(F.lit(looks).alias("looks"), F.stddev_pop(F.atan2("im", "re")).alias("spread"))
        out = s if out is None else out.unionByName(s)
    return out
