"""Cubes derived from the driver's tables, in Spark and in SQL, and the list of queries.

events: pixels (user_id mod 4, event type), ten epochs of three days, v the mean value.
lineitem: pixels (supplier mod 8, part mod 8), one layer a month, with a correlation and a mask.
embeddings: each vector as an 8 x 8 image, and as 4 x 8 complex samples; its id counts as its date.
orders: one acquisition a month.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.functions.phase import r6
from phasegrid.operators import network as net

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c).cast("double")) for c in columns})


_kept: dict[tuple[str, str, str], DataFrame] = {}


def release() -> None:
    """Forgets all cubes: the next query reads the tables again."""
    while _kept:
        _kept.popitem()[1].unpersist()


def kept(build: Query) -> Query:
    """Derived cubes (aggregates of the tables, small beside them) are made once a session and folder and persisted, as a plan uses them in several places."""

    def get(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, build.__name__)
        if key not in _kept:
            _kept[key] = build(spark, sf).persist()
        return _kept[key]

    return get


def listed(build: Query) -> Query:
    """Lists of dates and pairs are made once and held as local rows."""

    def get(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, build.__name__)
        if key not in _kept:
            _kept[key] = net.pinned(build(spark, sf))
        return _kept[key]

    return get


# --- events

TYPES = "types AS (SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS pcol FROM (SELECT DISTINCT event_type FROM events))"
CUBE_E = TYPES + """,
cube_e AS (SELECT CAST(user_id % 4 AS INTEGER) AS prow, pcol, CAST(floor((day(ts) - 1) / 3) AS INTEGER) AS t, avg(value) AS v
           FROM events JOIN types USING (event_type) GROUP BY 1, 2, 3)"""
NET_E = CUBE_E + """,
epochs AS (SELECT DISTINCT t FROM cube_e),
net_e AS (SELECT CAST(row_number() OVER (ORDER BY a.t, b.t) - 1 AS INTEGER) AS ifg_idx, a.t AS e, b.t AS l,
                 DATE '2024-01-01' + 3 * a.t AS early, DATE '2024-01-01' + 3 * b.t AS late, 3 * (b.t - a.t) AS dt_days
          FROM epochs a JOIN epochs b ON b.t > a.t)"""
STACK_E = NET_E + """,
stack_e AS (SELECT ifg_idx, x.prow, x.pcol, y.v - x.v + ((x.prow * 31 + x.pcol * 17 + x.t * 7 + y.t * 13) % 11 - 5) * CAST(0.01 AS DOUBLE) AS phase
            FROM net_e JOIN cube_e x ON x.t = e JOIN cube_e y ON y.t = l AND y.prow = x.prow AND y.pcol = x.pcol),
cor_e AS (SELECT ifg_idx, prow, pcol, ((prow * 13 + pcol * 7 + ifg_idx * 5) % 10) / CAST(10 AS DOUBLE) AS cor FROM stack_e)"""


@kept
def cube_e(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    types = e.select("event_type").distinct().select("event_type", F.expr("cast(dense_rank() over (order by event_type) - 1 as int)").alias("pcol"))
    rows = e.join(F.broadcast(types), "event_type")
    return rows.groupBy((F.col("user_id") % 4).cast("int").alias("prow"), "pcol", F.floor((F.dayofmonth("ts") - 1) / 3).cast("int").alias("t")).agg(F.avg("value").alias("v"))


def epoch_date(t: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), 3 * t)


@listed
def net_e(spark: SparkSession, sf: str) -> DataFrame:
    """(ifg_idx, e, l, early, late, dt_days) of all pairs of epochs."""
    days = cube_e(spark, sf).select("t").distinct().select(epoch_date(F.col("t")).alias("date"))
    p = net.all_pairs(days)
    base = F.lit("2024-01-01").cast("date")
    return p.withColumn("e", (F.datediff("early", base) / 3).cast("int")).withColumn("l", (F.datediff("late", base) / 3).cast("int"))


@kept
def stack_e(spark: SparkSession, sf: str) -> DataFrame:
    c = cube_e(spark, sf)
    a = c.select("prow", "pcol", F.col("t").alias("e"), F.col("v").alias("ve"))
    b = c.select("prow", "pcol", F.col("t").alias("l"), F.col("v").alias("vl"))
    noise = ((F.col("prow") * 31 + F.col("pcol") * 17 + F.col("e") * 7 + F.col("l") * 13) % 11 - 5) * F.lit(0.01)
    return F.broadcast(net_e(spark, sf)).join(a, "e").join(b, ["l", "prow", "pcol"]).select("ifg_idx", "prow", "pcol", (F.col("vl") - F.col("ve") + noise).alias("phase"))


def cor_e(spark: SparkSession, sf: str) -> DataFrame:
    return stack_e(spark, sf).select("ifg_idx", "prow", "pcol", (((F.col("prow") * 13 + F.col("pcol") * 7 + F.col("ifg_idx") * 5) % 10) / F.lit(10.0)).alias("cor"))


SERIES_E = CUBE_E + """,
series_e AS (SELECT prow, pcol, CAST(3 * t AS DOUBLE) AS t, DATE '2024-01-01' + 3 * t AS date, v AS value FROM cube_e)"""


def series_e(spark: SparkSession, sf: str) -> DataFrame:
    return cube_e(spark, sf).select("prow", "pcol", (3 * F.col("t")).cast("double").alias("t"), epoch_date(F.col("t")).alias("date"), F.col("v").alias("value"))


# --- lineitem

CUBE_L = """cube_l AS (SELECT CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS layer,
    CAST(l_suppkey % 8 AS INTEGER) AS prow, CAST(l_partkey % 8 AS INTEGER) AS pcol,
    avg(l_extendedprice) * CAST(0.000987654321 AS DOUBLE) AS value, avg(l_discount) * CAST(9.87654321 AS DOUBLE) AS cor, avg(l_quantity) AS quantity,
    bool_or(l_returnflag = 'R' AND l_linenumber = 1) AS masked
  FROM lineitem GROUP BY 1, 2, 3)"""
DEM_L = "dem AS (SELECT CAST(p_partkey // 8 % 8 AS INTEGER) AS prow, CAST(p_partkey % 8 AS INTEGER) AS pcol, avg(p_retailprice) AS elev FROM part GROUP BY 1, 2)"


@kept
def cube_l(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem")
    layer = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int")
    return x.groupBy(layer.alias("layer"), (F.col("l_suppkey") % 8).cast("int").alias("prow"), (F.col("l_partkey") % 8).cast("int").alias("pcol")).agg(
        (F.avg("l_extendedprice") * F.lit(0.000987654321)).alias("value"), (F.avg("l_discount") * F.lit(9.87654321)).alias("cor"), F.avg("l_quantity").alias("quantity"),
        F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)).alias("masked"))


def dem_l(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.groupBy(F.expr("cast(p_partkey div 8 % 8 as int)").alias("prow"), (F.col("p_partkey") % 8).cast("int").alias("pcol")).agg(F.avg("p_retailprice").alias("elev"))


# --- embeddings

IMAGES = """images AS (SELECT vec_id AS date, CAST(k // 8 AS INTEGER) AS prow, CAST(k % 8 AS INTEGER) AS pcol, CAST(embedding[k + 1] AS DOUBLE) AS value
  FROM embeddings, range(64) r(k))"""
CPX = """cpx AS (SELECT vec_id AS date, CAST(k // 8 AS INTEGER) AS prow, CAST(k % 8 AS INTEGER) AS pcol,
    CAST(embedding[2 * k + 1] AS DOUBLE) AS re, CAST(embedding[2 * k + 2] AS DOUBLE) AS im FROM embeddings, range(32) r(k)),
cnet AS (SELECT a.vec_id AS ifg_idx, a.vec_id AS early, b.vec_id AS late FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
met AS (SELECT ifg_idx, x.prow, x.pcol, x.re AS re1, x.im AS im1, y.re AS re2, y.im AS im2,
    x.re * y.re + x.im * y.im AS re, x.im * y.re - x.re * y.im AS im, x.re * x.re + x.im * x.im AS p1, y.re * y.re + y.im * y.im AS p2
  FROM cnet JOIN cpx x ON x.date = early JOIN cpx y ON y.date = late AND y.prow = x.prow AND y.pcol = x.pcol)"""


def images(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("date"), F.posexplode("embedding").alias("k", "x"))
    return e.select("date", F.floor(F.col("k") / 8).cast("int").alias("prow"), (F.col("k") % 8).alias("pcol"), F.col("x").cast("double").alias("value"))


def cpx(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.element_at("embedding", 2 * k + 1).cast("double").alias("re"), F.element_at("embedding", 2 * k + 2).cast("double").alias("im")))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("date"), F.posexplode(pairs).alias("k", "s"))
    return e.select("date", F.floor(F.col("k") / 8).cast("int").alias("prow"), (F.col("k") % 8).alias("pcol"), "s.re", "s.im")


def cnet(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector with the next id."""
    v = table(spark, sf, "embeddings").select("vec_id")
    nxt = v.select((F.col("vec_id") - 1).alias("ifg_idx"), F.col("vec_id").alias("late"))
    return v.select(F.col("vec_id").alias("ifg_idx"), F.col("vec_id").alias("early")).join(nxt, "ifg_idx")


# --- orders

MONTHS = """months AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n, avg(o_totalprice) / 1000 AS position FROM orders GROUP BY 1),
ignored AS (SELECT date FROM months WHERE n < (SELECT avg(n) FROM months)),
mnet AS (SELECT CAST(row_number() OVER (ORDER BY a.date, b.date) - 1 AS INTEGER) AS ifg_idx, a.date AS early, b.date AS late,
    CAST(b.date - a.date AS INTEGER) AS dt_days FROM months a JOIN months b ON b.date > a.date)"""


@listed
def months(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("date")).agg(F.count("*").alias("n"), (F.avg("o_totalprice") / 1000).alias("position"))


def ignored(spark: SparkSession, sf: str) -> DataFrame:
    m = months(spark, sf)
    return m.join(F.broadcast(m.agg(F.avg("n").alias("a")))).filter("n < a").select("date")


@listed
def mnet(spark: SparkSession, sf: str) -> DataFrame:
    return net.all_pairs(months(spark, sf).select("date"))
