"""Inversion of pairs into histories. Histories are held against closed forms of complete networks, and
general designs against their normal equations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from phasegrid.functions.phase import PHASE_TO_CM
from phasegrid.operators import form, invert, pixels
from phasegrid.operators.network import temporal_weights
from phasegrid.plans.workflow import Inversion, run_inversion
from phasegrid.queries.cubes import CUBE_L, STACK_E, cor_e, cube_l, net_e, query, six, stack_e

PX = ("prow", "pcol")
#: In a complete network of n dates the least-squares value of a date is the mean of its signed differences, less that of the first date.
CLOSED = STACK_E + """, both_e AS (SELECT prow, pcol, l AS i, phase AS d FROM stack_e JOIN net_e USING (ifg_idx) UNION ALL SELECT prow, pcol, e, -phase FROM stack_e JOIN net_e USING (ifg_idx)),
n_e AS (SELECT count(*) AS n FROM epochs), m_e AS (SELECT prow, pcol, i, sum(d) / any_value(n) AS m FROM both_e, n_e GROUP BY 1, 2, 3),
h_e AS (SELECT a.prow, a.pcol, a.i, DATE '2024-01-01' + 3 * a.i AS date, a.m - b.m AS phi FROM m_e a JOIN m_e b ON b.prow = a.prow AND b.pcol = a.pcol AND b.i = 0)"""
CM = f"{PHASE_TO_CM!r}::DOUBLE"


def _history(spark, sf, **options):
    return invert.invert(stack_e(spark, sf), net_e(spark, sf), **options)


@query(f"WITH {CLOSED} SELECT prow, pcol, date, round(phi * {CM}, 6) + 0.0 AS defo FROM h_e")
def sbas_inversion(spark, sf):
    return six(_history(spark, sf, scale=PHASE_TO_CM), "defo")


@query(f"WITH {CLOSED} SELECT prow, pcol, date, round(phi * {CM}, 6) + 0.0 AS defo FROM h_e")
def sbas_packed(spark, sf):
    """The same by one matrix product an Arrow batch."""
    ids, ends, dates = invert.collected(net_e(spark, sf))
    p = invert.pseudo_inverse(invert.design(ends, dates))
    x = invert.invert_packed(invert.packed(stack_e(spark, sf)), p)
    long = x.select(*PX, F.posexplode(F.concat(F.array(F.lit(0.0)), "x")).alias("k", "v"))
    return six(long.select(*PX, F.element_at(F.array(*[F.lit(d) for d in dates]), F.col("k") + 1).alias("date"), (F.col("v") * PHASE_TO_CM).alias("defo")), "defo")


@query(f"WITH {CLOSED} SELECT prow, pcol, date, round(phi, 6) + 0.0 AS defo FROM h_e")
def sbas_by_velocity(spark, sf):
    """Interval velocities, integrated: the same history where the network is connected."""
    return six(_history(spark, sf, velocity=True), "defo")


@query(f"""WITH {CLOSED}, r AS (SELECT s.prow, s.pcol, s.phase, s.phase - (b.phi - a.phi) AS r FROM stack_e s JOIN net_e USING (ifg_idx) JOIN h_e a ON a.prow = s.prow AND a.pcol = s.pcol AND a.i = e JOIN h_e b ON b.prow = s.prow AND b.pcol = s.pcol AND b.i = l)
SELECT prow, pcol, round(CASE WHEN sum(phase) = 0 THEN 0 ELSE sqrt(power(sum(cos(r)), 2) + power(sum(sin(r)), 2)) / count(*) END, 6) + 0.0 AS temp_coh FROM r GROUP BY 1, 2""")
def temporal_coherence(spark, sf):
    s, n = stack_e(spark, sf), net_e(spark, sf)
    return six(invert.temporal_coherence(s, n, invert.invert(s, n)), "temp_coh")


@query(f"""WITH {CLOSED}, r AS (SELECT s.prow, s.pcol, s.phase, s.phase - (b.phi - a.phi) AS r FROM stack_e s JOIN net_e USING (ifg_idx) JOIN h_e a ON a.prow = s.prow AND a.pcol = s.pcol AND a.i = e JOIN h_e b ON b.prow = s.prow AND b.pcol = s.pcol AND b.i = l),
c AS (SELECT prow, pcol, sqrt(power(sum(cos(r)), 2) + power(sum(sin(r)), 2)) / count(*) AS temp_coh FROM r GROUP BY 1, 2)
SELECT prow, pcol, date, round(phi * {CM}, 6) + 0.0 AS defo, round(temp_coh, 6) + 0.0 AS temp_coh FROM h_e JOIN c USING (prow, pcol)""")
def sbas_with_coherence(spark, sf):
    """The flagship: network, inversion and coherence as one workflow."""
    out = run_inversion(stack_e(spark, sf), net_e(spark, sf), settings=Inversion())
    return six(out["history"].join(out["coherence"], list(PX)), "defo", "temp_coh")


NORMAL = f"WITH {STACK_E} SELECT prow, pcol, date, 0.0::DOUBLE AS gradient FROM (SELECT DISTINCT prow, pcol FROM stack_e), (SELECT DISTINCT late AS date FROM net_e)"


def _gradient(spark, sf, pairs, history, weight=None):
    """Aᵀ W² (A x - φ) per pixel and later date."""
    s = stack_e(spark, sf).join(F.broadcast(pairs), "ifg_idx")
    for side in ("early", "late"):
        s = s.join(history.select(*PX, F.col("date").alias(side), F.col("defo").alias(f"_{side}")), [*PX, side])
    w = F.pow(F.col(weight), 2) if weight else F.lit(1.0)
    r = w * (F.col("_late") - F.col("_early") - F.col("phase"))
    ends = F.explode(F.array(F.struct(F.col("late").alias("date"), r.alias("g")), F.struct(F.col("early").alias("date"), (-r).alias("g"))))
    g = s.select(*PX, ends.alias("x")).groupBy(*PX, F.col("x.date").alias("date")).agg(F.sum("x.g").alias("gradient"))
    return g.filter(F.col("date") > F.lit("2024-01-01").cast("date")).withColumn("gradient", F.round("gradient", 5) + 0.0)


@query(NORMAL)
def sbas_weighted_normal(spark, sf):
    """Weighted by 1 / √dt: the weighted normal equations hold."""
    n = temporal_weights(net_e(spark, sf)).select("ifg_idx", "early", "late", "weight")
    return _gradient(spark, sf, n, _history(spark, sf, weighted=True), "weight")


@query(NORMAL)
def sbas_narrow_normal(spark, sf):
    """Pairs of at most four epochs' distance."""
    n = net_e(spark, sf).filter("l - e <= 4")
    h = invert.invert(stack_e(spark, sf).join(F.broadcast(n.select("ifg_idx")), "ifg_idx", "left_semi"), n)
    return _gradient(spark, sf, n.select("ifg_idx", "early", "late"), h)


def _ridge_sql() -> str:
    """Tikhonov by the eigenvalues of a complete network: AᵀA of all dates but the first is n I - 1, so x = (b + 1 Σb / (1 + α²)) / (n + α²)."""
    return f"""WITH {CLOSED}, b AS (SELECT prow, pcol, i, m * n AS b FROM m_e, n_e WHERE i > 0), t AS (SELECT prow, pcol, sum(b) AS s FROM b GROUP BY 1, 2)
SELECT prow, pcol, DATE '2024-01-01' + 3 * i AS date, round((b + s / (1 + 4)) / (n + 4), 6) + 0.0 AS defo FROM b JOIN t USING (prow, pcol), n_e
UNION ALL SELECT prow, pcol, DATE '2024-01-01', 0.0 FROM t"""


@query(_ridge_sql())
def sbas_tikhonov(spark, sf):
    return six(_history(spark, sf, alpha=2.0), "defo")


@query(f"WITH {STACK_E} SELECT prow, pcol, round(sum(dt_days * phase) / sum(dt_days * dt_days), 6) + 0.0 AS velocity FROM stack_e JOIN net_e USING (ifg_idx) GROUP BY 1, 2")
def constant_velocity(spark, sf):
    return six(invert.constant_velocity(stack_e(spark, sf), net_e(spark, sf)), "velocity")


@query(f"WITH {STACK_E} SELECT prow, pcol, round(sum(phase) / sum(dt_days) * 365 * 10, 6) + 0.0 AS velocity FROM stack_e JOIN net_e USING (ifg_idx) GROUP BY 1, 2")
def stack_average_velocity(spark, sf):
    return six(invert.stack_velocity(stack_e(spark, sf), net_e(spark, sf), scale=3650.0), "velocity")


@query(f"WITH {STACK_E} SELECT b AS bandwidth, prow, pcol, round(sum(dt_days * phase) / sum(dt_days * dt_days) * 3650, 6) + 0.0 AS velocity, round(sum(phase) / sum(dt_days) * 3650, 6) + 0.0 AS stacked FROM stack_e JOIN net_e USING (ifg_idx) JOIN (VALUES (2), (4), (9)) v(b) ON l - e <= b GROUP BY 1, 2, 3")
def bandwidth_sweep_velocity(spark, sf):
    s, out = stack_e(spark, sf), None
    for b in (2, 4, 9):
        n = net_e(spark, sf).filter(F.col("l") - F.col("e") <= b)
        v = invert.constant_velocity(s, n).withColumn("velocity", F.col("velocity") * 3650).join(invert.stack_velocity(s, n, scale=3650.0).withColumnRenamed("velocity", "stacked"), list(PX))
        v = v.withColumn("bandwidth", F.lit(b))
        out = v if out is None else out.unionByName(v)
    return six(out, "velocity", "stacked").select("bandwidth", *PX, "velocity", "stacked")


@query(NORMAL.replace("SELECT prow, pcol, date,", "SELECT b AS bandwidth, prow, pcol, date,").replace("FROM (SELECT DISTINCT prow", "FROM (VALUES (2), (5)) v(b), (SELECT DISTINCT prow"))
def sbas_bandwidth_sweep(spark, sf):
    out = None
    for b in (2, 5):
        n = net_e(spark, sf).filter(F.col("l") - F.col("e") <= b)
        h = invert.invert(stack_e(spark, sf).join(F.broadcast(n.select("ifg_idx")), "ifg_idx", "left_semi"), n)
        g = _gradient(spark, sf, n.select("ifg_idx", "early", "late"), h).withColumn("bandwidth", F.lit(b))
        out = g if out is None else out.unionByName(g)
    return out.select("bandwidth", *PX, "date", "gradient")


@query(f"""WITH {STACK_E}, s AS (SELECT prow, pcol, sum(cor * cor * dt_days * dt_days) AS a, sum(cor * cor * dt_days * phase) AS b FROM stack_e JOIN cor_e USING (ifg_idx, prow, pcol) JOIN net_e USING (ifg_idx) GROUP BY 1, 2)
SELECT prow, pcol, round(b / a, 6) + 0.0 AS velocity FROM s""")
def cor_weighted_velocity(spark, sf):
    """Correlation-weighted normal equations with one unknown."""
    n = net_e(spark, sf)
    met = stack_e(spark, sf).join(cor_e(spark, sf), ["ifg_idx", *PX])
    packs = met.groupBy(*PX).agg(F.array_sort(F.collect_list(F.struct("ifg_idx", "phase", "cor"))).alias("s"))
    days = np.array([[float(r.dt_days)] for r in n.orderBy("ifg_idx").select("dt_days").collect()])
    p = packs.select(*PX, F.transform("s", lambda s: s["phase"]).alias("phase"), F.transform("s", lambda s: s["cor"]).alias("cor"))
    return six(invert.invert_by_correlation(p, days).select(*PX, F.col("x")[0].alias("velocity")), "velocity")


@query(NORMAL)
def cor_weighted_normal(spark, sf):
    """The full history with correlations as weights: the weighted normal equations hold."""
    ids, ends, dates = invert.collected(net_e(spark, sf))
    cor = cor_e(spark, sf).withColumn("cor", F.col("cor") + 0.1)
    met = stack_e(spark, sf).join(cor, ["ifg_idx", *PX])
    packs = met.groupBy(*PX).agg(F.array_sort(F.collect_list(F.struct("ifg_idx", "phase", "cor"))).alias("s"))
    p = packs.select(*PX, F.transform("s", lambda s: s["phase"]).alias("phase"), F.transform("s", lambda s: s["cor"]).alias("cor"))
    x = invert.invert_by_correlation(p, invert.design(ends, dates))
    h = x.select(*PX, F.posexplode(F.concat(F.array(F.lit(0.0)), "x")).alias("k", "defo")).select(*PX, F.element_at(F.array(*[F.lit(d) for d in dates]), F.col("k") + 1).alias("date"), "defo")
    n = net_e(spark, sf).select("ifg_idx", "early", "late")
    s = met.join(F.broadcast(n), "ifg_idx")
    for side in ("early", "late"):
        s = s.join(h.select(*PX, F.col("date").alias(side), F.col("defo").alias(f"_{side}")), [*PX, side])
    r = F.pow("cor", 2) * (F.col("_late") - F.col("_early") - F.col("phase"))
    ends_ = F.explode(F.array(F.struct(F.col("late").alias("date"), r.alias("g")), F.struct(F.col("early").alias("date"), (-r).alias("g"))))
    g = s.select(*PX, ends_.alias("x")).groupBy(*PX, F.col("x.date").alias("date")).agg(F.sum("x.g").alias("gradient"))
    return g.filter(F.col("date") > F.lit("2024-01-01").cast("date")).withColumn("gradient", F.round("gradient", 5) + 0.0)


@query(f"""WITH {STACK_E}, r AS (SELECT prow, pcol, phase / dt_days AS v, dt_days AS w FROM stack_e JOIN net_e USING (ifg_idx)),
c AS (SELECT *, sum(w) OVER (PARTITION BY prow, pcol ORDER BY v) AS cw, sum(w) OVER (PARTITION BY prow, pcol) AS tw FROM r)
SELECT prow, pcol, round(min(v), 6) + 0.0 AS velocity FROM c WHERE cw > tw / 2.0 GROUP BY 1, 2""")
def l1_velocity(spark, sf):
    """Least absolute residuals with one velocity: the median of phase / dt, weighted by dt."""
    days = np.array([[float(r.dt_days)] for r in net_e(spark, sf).orderBy("ifg_idx").select("dt_days").collect()])
    return six(invert.invert_l1(invert.packed(stack_e(spark, sf)), days).select(*PX, F.col("x")[0].alias("velocity")), "velocity")


@query()
def l1_history(spark, sf):
    """Least absolute residuals, all dates (iterative)."""
    ids, ends, dates = invert.collected(net_e(spark, sf))
    x = invert.invert_l1(invert.packed(stack_e(spark, sf)), invert.design(ends, dates))
    return x.select(*PX, F.posexplode("x").alias("k", "phase"))


@query(f"""WITH {STACK_E}, m AS (SELECT prow, pcol, phase, dt_days::DOUBLE AS t, CASE WHEN e > 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS j FROM stack_e JOIN net_e USING (ifg_idx)),
s AS (SELECT prow, pcol, sum(t * t) AS tt, sum(t * j) AS tj, sum(j) AS jj, sum(t * phase) AS ty, sum(j * phase) AS jy FROM m GROUP BY 1, 2)
SELECT prow, pcol, round((ty * jj - jy * tj) / (tt * jj - tj * tj), 6) + 0.0 AS velocity, round((tt * jy - tj * ty) / (tt * jj - tj * tj), 6) + 0.0 AS step FROM s""")
def velocity_jump(spark, sf):
    return six(invert.velocity_and_jump(stack_e(spark, sf), net_e(spark, sf), "2024-01-14"), "velocity", "step")


@query(f"""WITH {STACK_E}, s AS (SELECT prow, pcol, sum(phase) AS total, count(phase) AS n, sum(dt_days)::DOUBLE AS days FROM stack_e JOIN net_e USING (ifg_idx) WHERE e <= 4 AND l >= 5 GROUP BY 1, 2),
r AS (SELECT avg(total) AS ref FROM s WHERE prow BETWEEN 1 AND 3 AND pcol BETWEEN 1 AND 3)
SELECT prow, pcol, round((total - ref) / n, 6) + 0.0 AS stacked, n, days FROM s, r""")
def coseismic_stack(spark, sf):
    n = net_e(spark, sf).filter("e <= 4 and l >= 5")
    s = stack_e(spark, sf).join(F.broadcast(n.select("ifg_idx")), "ifg_idx", "left_semi")
    return six(form.event_stack(s, n, pixels.in_window(2, 2, 3)), "stacked")


@query(f"""WITH {STACK_E}, s AS (SELECT prow, pcol, sum(phase) AS total, sum(dt_days)::DOUBLE AS days, avg(cor) AS cor, count(phase) AS n FROM stack_e JOIN cor_e USING (ifg_idx, prow, pcol) JOIN net_e USING (ifg_idx) WHERE e <= 4 AND l >= 5 GROUP BY 1, 2),
r AS (SELECT avg(total) AS ref FROM s WHERE prow BETWEEN 1 AND 3 AND pcol BETWEEN 1 AND 3)
SELECT prow, pcol, round(CASE WHEN cor < 0.45 THEN 0 ELSE (total - ref) * {CM} / days END, 6) + 0.0 AS stacked, n, days FROM s, r""")
def coseismic_rate_masked(spark, sf):
    n = net_e(spark, sf).filter("e <= 4 and l >= 5")
    s = stack_e(spark, sf).join(cor_e(spark, sf), ["ifg_idx", *PX]).join(F.broadcast(n.select("ifg_idx")), "ifg_idx", "left_semi")
    return six(form.event_stack(s, n, pixels.in_window(2, 2, 3), rate=True, min_cor=0.45, scale=PHASE_TO_CM), "stacked")


@query(f"WITH {CUBE_L}, z AS (SELECT prow, pcol, layer, CASE WHEN (prow + pcol) % 2 = 0 THEN 0 ELSE value END AS value FROM cube_l) SELECT prow, pcol, round(CASE WHEN sum(abs(value)) = 0 THEN 0 ELSE sum(value * (layer + 1)) / sum((layer + 1) * (layer + 1)) END, 6) + 0.0 AS velocity FROM z GROUP BY 1, 2")
def empty_pixels_are_zero(spark, sf):
    z = cube_l(spark, sf).select(F.col("layer").alias("ifg_idx"), *PX, F.when((F.col("prow") + F.col("pcol")) % 2 == 0, 0.0).otherwise(F.col("value")).alias("phase"))
    n = z.select("ifg_idx", (F.col("ifg_idx") + 1).alias("dt_days")).distinct()
    return six(invert.constant_velocity(z, n), "velocity")


@query(f"WITH {CLOSED} SELECT prow, pcol, i, round(sum(dv) OVER (PARTITION BY prow, pcol ORDER BY i), 6) + 0.0 AS phi FROM (SELECT prow, pcol, i, coalesce(phi - lag(phi) OVER (PARTITION BY prow, pcol ORDER BY i), 0) AS dv FROM h_e)")
def integrate_velocities(spark, sf):
    """Velocities of each interval, integrated with running sums."""
    h = _history(spark, sf)
    w = Window.partitionBy(*PX).orderBy("date")
    v = h.withColumn("k", (F.row_number().over(w) - 2).cast("int")).withColumn("x", (F.col("defo") - F.lag("defo").over(w)) / 3).filter("k >= 0").withColumn("unknown", F.col("date"))
    days = [3.0] * 9
    out = invert.with_zero_date(invert.integrate(v, days), "2024-01-01")
    return six(out.select(*PX, (F.datediff("date", F.lit("2024-01-01").cast("date")) / 3).cast("int").alias("i"), F.col("defo").alias("phi")), "phi")
