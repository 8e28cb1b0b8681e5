"""Dates and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasegrid.functions import names
from phasegrid.operators import network as net
from phasegrid.queries.cubes import MONTHS, NET_E, ignored, mnet, months, net_e, query, six, table

PAIR = ("ifg_idx", "early", "late", "dt_days")


@query(f"WITH {MONTHS} SELECT CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS slc_idx, date FROM (SELECT early AS date FROM mnet UNION SELECT late FROM mnet)")
def slc_dates(spark, sf):
    return net.dates_of(mnet(spark, sf))


@query(f"WITH {MONTHS} SELECT * FROM mnet")
def date_pairs(spark, sf):
    return mnet(spark, sf).select(*PAIR)


@query(f"WITH {MONTHS} SELECT ifg_idx, strftime(early, '%Y%m%d') || '_' || strftime(late, '%Y%m%d') || '.int' AS name, dt_days FROM mnet ORDER BY early, late")
def temporal_baseline(spark, sf):
    p = mnet(spark, sf)
    named = p.select("ifg_idx", names.pair_name(F.col("early"), F.col("late"), ".int").alias("name"))
    early, late = names.pair_in(F.col("name"))
    return named.select("ifg_idx", "name", F.datediff(late, early).alias("dt_days"))


@query(f"WITH {MONTHS} SELECT * FROM mnet WHERE early > DATE '1996-03-01' AND late < DATE '1999-01-01'")
def filter_min_max_date(spark, sf):
    return net.between_dates(mnet(spark, sf), "1996-03-01", "1999-01-01").select(*PAIR)


@query(f"WITH {MONTHS} SELECT * FROM mnet WHERE early NOT IN (SELECT date FROM ignored) AND late NOT IN (SELECT date FROM ignored)")
def filter_ignore_antijoin(spark, sf):
    return net.without_dates(mnet(spark, sf), ignored(spark, sf)).select(*PAIR)


@query(f"WITH {MONTHS} SELECT * FROM mnet WHERE dt_days <= 184")
def filter_max_baseline(spark, sf):
    return mnet(spark, sf).filter(net.span() <= 184).select(*PAIR)


@query(f"WITH {MONTHS} SELECT * FROM mnet WHERE dt_days < 184")
def filter_below_temporal(spark, sf):
    return mnet(spark, sf).filter(net.span() < 184).select(*PAIR)


RANKS = MONTHS + ", ranks AS (SELECT date, row_number() OVER (ORDER BY date) AS r FROM months)"


@query(f"WITH {RANKS} SELECT mnet.*, CAST(b.r - a.r AS INTEGER) AS steps FROM mnet JOIN ranks a ON a.date = early JOIN ranks b ON b.date = late WHERE b.r - a.r BETWEEN 2 AND 5")
def filter_bandwidth(spark, sf):
    return net.bandwidth(mnet(spark, sf)).filter("steps between 2 and 5").select(*PAIR, "steps")


@query(f"WITH {MONTHS} SELECT * FROM mnet WHERE dt_days <= 93 OR abs(dt_days - 365) <= 30")
def include_annual(spark, sf):
    return net.filter_network(mnet(spark, sf), max_days=93, annual=True)[1].select(*PAIR)


FILTERED = RANKS + """, f AS (SELECT * FROM mnet WHERE early > DATE '1995-06-01' AND late > DATE '1995-06-01' AND early NOT IN (SELECT date FROM ignored) AND late NOT IN (SELECT date FROM ignored)),
fd AS (SELECT date, row_number() OVER (ORDER BY date) AS r FROM (SELECT early AS date FROM f UNION SELECT late FROM f)),
kept AS (SELECT f.* FROM f JOIN fd a ON a.date = early JOIN fd b ON b.date = late WHERE (dt_days <= 400 AND b.r - a.r BETWEEN 0 AND 6) OR abs(dt_days - 365) <= 30)"""


def _filtered(spark, sf):
    return net.filter_network(mnet(spark, sf), low="1995-06-01", ignored=ignored(spark, sf), max_days=400, max_steps=6, annual=True)


@query(f"WITH {FILTERED} SELECT * FROM kept")
def network_filter(spark, sf):
    return _filtered(spark, sf)[1].select(*PAIR)


@query(f"WITH {FILTERED} SELECT CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS slc_idx, date FROM (SELECT early AS date FROM kept UNION SELECT late FROM kept)")
def network_dates(spark, sf):
    return _filtered(spark, sf)[0]


@query(f"WITH {MONTHS} SELECT a.date AS early, b.date AS late FROM months a JOIN months b ON b.date > a.date AND b.date - a.date <= 100 AND abs(b.position - a.position) <= 5")
def short_baseline_pairs(spark, sf):
    return net.short_pairs(months(spark, sf), 100, 5.0)


@query(f"WITH {RANKS} SELECT a.date AS early, b.date AS late FROM ranks a JOIN ranks b ON b.r > a.r AND b.r <= a.r + 3")
def neighbour_pairs(spark, sf):
    return net.pairs_within(months(spark, sf), 3)


DATES_E = NET_E + ", d AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS i FROM (SELECT early AS date FROM net_e UNION SELECT late FROM net_e))"


@query(f"WITH {DATES_E} SELECT ifg_idx, CAST(i - 1 AS INTEGER) AS k, CASE WHEN date = late THEN 1 ELSE -1 END AS v FROM net_e JOIN d ON date IN (early, late) WHERE i > 0")
def incidence_matrix(spark, sf):
    return net.incidence(net_e(spark, sf))


STEPS_E = DATES_E + ", s AS (SELECT CAST(a.i AS INTEGER) AS k, CAST(b.date - a.date AS INTEGER) AS dt, a.date AS start, b.date AS stop FROM d a JOIN d b ON b.i = a.i + 1)"


@query(f"WITH {STEPS_E} SELECT ifg_idx, k, dt AS v FROM net_e JOIN s ON start >= early AND stop <= late")
def velocity_matrix(spark, sf):
    return net.velocity_matrix(net_e(spark, sf))


@query(f"WITH {NET_E} SELECT ifg_idx, 0 AS k, CAST(dt_days AS INTEGER) AS v FROM net_e")
def velocity_matrix_linear(spark, sf):
    return net.velocity_matrix(net_e(spark, sf), linear=True)


@query(f"WITH {STEPS_E} SELECT k, dt FROM s")
def date_differences(spark, sf):
    return net.date_steps(net.dates_of(net_e(spark, sf)))


@query(f"WITH {DATES_E} SELECT ifg_idx, CAST(i - 1 AS INTEGER) AS k, CASE WHEN date = late THEN 1 ELSE -1 END AS v FROM net_e JOIN d ON date IN (early, late) WHERE i BETWEEN 1 AND 5 AND dt_days <= 9")
def subset_matrix(spark, sf):
    p = net_e(spark, sf)
    m = net.incidence(p)
    return net.subset_matrix(m, p.filter("dt_days <= 9"), m.filter("k < 5"))


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1 ELSE -1 END AS v FROM range(9) a(i), range(10) b(j) WHERE j - i IN (0, 1)")
def difference_matrix_first(spark, sf):
    return net.difference_matrix(spark, 10, 1)


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i <> j THEN -1 WHEN i IN (0, 9) THEN 1 ELSE 2 END AS v FROM range(10) a(i), range(10) b(j) WHERE abs(i - j) <= 1")
def difference_matrix_second(spark, sf):
    return net.difference_matrix(spark, 10, 2)


@query(f"WITH {MONTHS} SELECT a.early AS d1, a.late AS d2, b.late AS d3, a.ifg_idx AS i12, b.ifg_idx AS i23, c.ifg_idx AS i13 FROM mnet a JOIN mnet b ON b.early = a.late JOIN mnet c ON c.early = a.early AND c.late = b.late WHERE a.dt_days <= 92 AND b.dt_days <= 92 AND c.dt_days <= 92")
def closure_triplets(spark, sf):
    return net.closure_triplets(mnet(spark, sf).filter("dt_days <= 92"))


BASELINES = MONTHS + ", base AS (SELECT a.date AS slc1, b.date AS slc2, CAST(b.date - a.date AS DOUBLE) AS temporal, b.position - a.position AS spatial FROM months a JOIN months b ON b.date > a.date AND b.date - a.date <= 62)"


@query(f"WITH {BASELINES} SELECT ifg_idx, early, late, dt_days, temporal, round(spatial, 6) + 0.0 AS spatial FROM mnet JOIN base ON slc1 = early AND slc2 = late")
def baselines_merge(spark, sf):
    m = months(spark, sf)
    p = net.short_pairs(m, 62)
    a, b = (m.select(F.col("date").alias(c), F.col("position").alias(f"_{c}")) for c in ("early", "late"))
    base = p.join(a, "early").join(b, "late").select(F.col("early").alias("slc1"), F.col("late").alias("slc2"), F.datediff("late", "early").cast("double").alias("temporal"), (F.col("_late") - F.col("_early")).alias("spatial"))
    return six(net.merge_baselines(mnet(spark, sf), base), "spatial").select(*PAIR, "temporal", "spatial")


@query(f"WITH {MONTHS} SELECT early, late, ifg_idx FROM mnet WHERE dt_days <= 62")
def pair_index_lookup(spark, sf):
    return net.pair_index(mnet(spark, sf), net.short_pairs(months(spark, sf), 62)).select("early", "late", "ifg_idx")


@query("""WITH used AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS date FROM lineitem), m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1)
SELECT date, n FROM m WHERE date IN (SELECT date FROM used)""")
def used_dates_semijoin(spark, sf):
    used = table(spark, sf, "lineitem").select(F.date_trunc("month", "l_shipdate").cast("date").alias("date"))
    return months(spark, sf).select("date", "n").join(used, "date", "left_semi")


EVENT = "1998-01-15"


@query(f"WITH {MONTHS}, b AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS r FROM months WHERE date < DATE '{EVENT}'), a AS (SELECT date, row_number() OVER (ORDER BY date) AS r FROM months WHERE date > DATE '{EVENT}') SELECT b.date AS early, a.date AS late FROM b JOIN a ON a.r = 6 - b.r WHERE b.r <= 5")
def event_pairs(spark, sf):
    return net.straddling(months(spark, sf), EVENT, 5)


@query(f"WITH {MONTHS} SELECT * FROM mnet WHERE late < DATE '{EVENT}'")
def pre_event_pairs(spark, sf):
    return net.before_event(mnet(spark, sf), EVENT).select(*PAIR)


@query(f"WITH {MONTHS} SELECT * FROM mnet WHERE early > DATE '{EVENT}'")
def post_event_pairs(spark, sf):
    return net.after_event(mnet(spark, sf), EVENT).select(*PAIR)


@query(f"WITH {MONTHS} SELECT ifg_idx, CASE WHEN early > DATE '{EVENT}' AND late > DATE '{EVENT}' THEN 1 ELSE 0 END AS jump FROM mnet")
def event_crossing(spark, sf):
    return mnet(spark, sf).select("ifg_idx", net.crosses(EVENT).alias("jump"))


@query(f"WITH {MONTHS} SELECT ifg_idx, round((1 / sqrt(dt_days)) / max(1 / sqrt(dt_days)) OVER (), 6) + 0.0 AS weight FROM mnet")
def temporal_weights(spark, sf):
    return six(net.temporal_weights(mnet(spark, sf)), "weight").select("ifg_idx", "weight")


@query(f"WITH {NET_E} SELECT ifg_idx, CAST(k AS INTEGER) AS k, power(CAST(dt_days AS DOUBLE), k) AS v FROM net_e, range(4) r(k)")
def polynomial_design(spark, sf):
    p = net_e(spark, sf)
    return p.select("ifg_idx", F.posexplode(net.polynomial(F.col("dt_days").cast("double"), 3)).alias("k", "v"))


@query("SELECT year(o_orderdate) AS y, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_dates, count(*) AS n FROM orders GROUP BY 1")
def date_counts(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("y")).agg(F.countDistinct(F.col("o_orderdate").cast("date")).alias("n_dates"), F.count("*").alias("n"))


@query("SELECT CAST(step AS INTEGER) AS step FROM (VALUES (1), (3), (4), (5), (9), (10)) t(step)")
def step_selection(spark, sf):
    parts = F.transform(F.split(F.lit("1,3-5,9-10,4"), ","), lambda p: F.split(p, "-"))
    steps = F.flatten(F.transform(parts, lambda p: F.sequence(p[0].cast("int"), F.element_at(p, -1).cast("int"))))
    return spark.range(1).select(F.explode(F.array_distinct(steps)).alias("step"))
