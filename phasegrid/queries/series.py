"""Histories over time: models, atmosphere, local regression, differences, stations, several tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasegrid.functions.phase import add_keeping_zero
from phasegrid.operators import model, robust, tracks
from phasegrid.queries.cubes import CUBE_L, IMAGES, SERIES_E, cube_l, images, query, series_e, six, table

PX = ("prow", "pcol")
LINE = "line AS (SELECT prow, pcol, regr_slope(value, t) AS m, regr_intercept(value, t) AS b FROM series_e GROUP BY 1, 2), fit AS (SELECT s.*, m * s.t + b AS model FROM series_e s JOIN line USING (prow, pcol))"


@query(f"WITH {SERIES_E}, {LINE} SELECT prow, pcol, round(m, 6) + 0.0 AS slope, round(b, 6) + 0.0 AS intercept FROM line")
def polyfit_line(spark, sf):
    return six(model.line_fit(series_e(spark, sf)), "slope", "intercept")


@query(f"""WITH {SERIES_E}, s AS (SELECT prow, pcol, count(*)::DOUBLE AS a, sum(t) AS b, sum(t*t) AS c, sum(t*t*t) AS d, sum(t*t*t*t) AS e, sum(value) AS p, sum(t*value) AS q, sum(t*t*value) AS r FROM series_e GROUP BY 1, 2),
x AS (SELECT *, a*(c*e-d*d) - b*(b*e-c*d) + c*(b*d-c*c) AS det FROM s)
SELECT prow, pcol, round((p*(c*e-d*d) - b*(q*e-r*d) + c*(q*d-r*c)) / det, 5) + 0.0 AS c0, round((a*(q*e-r*d) - p*(b*e-c*d) + c*(b*r-c*q)) / det, 5) + 0.0 AS c1, round((a*(c*r-d*q) - b*(b*r-c*q) + p*(b*d-c*c)) / det, 5) + 0.0 AS c2 FROM x""")
def polyfit_parabola(spark, sf):
    f = model.parabola_fit(series_e(spark, sf))
    return f.select(*PX, *[(F.round(c, 5) + 0.0).alias(c) for c in ("c0", "c1", "c2")])


@query(f"WITH {SERIES_E}, {LINE} SELECT prow, pcol, t, round(model, 6) + 0.0 AS model FROM fit")
def polynomial_hat_matrix(spark, sf):
    """A line as one small matrix over the shared dates."""
    s = series_e(spark, sf)
    days = [r.t for r in s.select("t").distinct().orderBy("t").collect()]
    return six(model.polynomial_by_hat(s, days, 1), "model")


ATMO = LINE + """, d AS (SELECT *, model - value - first_value(model - value) OVER (PARTITION BY prow, pcol ORDER BY t) AS rel, row_number() OVER (PARTITION BY prow, pcol ORDER BY t) AS n FROM fit),
atmo AS (SELECT prow, pcol, -avg(rel) AS atmo FROM d WHERE n > 1 GROUP BY 1, 2)"""


@query(f"WITH {SERIES_E}, {ATMO} SELECT prow, pcol, round(atmo, 6) + 0.0 AS atmo FROM atmo")
def day1_atmosphere(spark, sf):
    return six(model.first_day_atmosphere(model.line_values(series_e(spark, sf))), "atmo")


WEIGHTED = ATMO + """, w AS (SELECT t, 1 / (quantile_cont(model - value, 0.98) - quantile_cont(model - value, 0.02)) AS w FROM fit GROUP BY 1),
k AS (SELECT prow, pcol, sum(w*w) AS s, sum(w*w*t) AS st, sum(w*w*value) AS sy, sum(w*w*t*t) AS stt, sum(w*w*t*value) AS sty FROM series_e JOIN w USING (t) GROUP BY 1, 2),
wl AS (SELECT prow, pcol, (s*sty - st*sy) / (s*stt - st*st) AS m, sqrt(s / (s*stt - st*st)) AS sigma, (sy - (s*sty - st*sy) / (s*stt - st*st) * st) / s AS b FROM k)"""


@query(f"WITH {SERIES_E}, {WEIGHTED} SELECT t, round(w, 6) + 0.0 AS weight FROM w")
def residual_weights(spark, sf):
    return six(model.residual_weights(model.line_values(series_e(spark, sf))), "weight")


@query(f"WITH {SERIES_E}, {WEIGHTED} SELECT prow, pcol, round(m * 365.25, 5) + 0.0 AS velocity, round(sigma * 365.25, 5) + 0.0 AS sigma FROM wl")
def linear_velocity_sigma(spark, sf):
    s = series_e(spark, sf)
    line = model.weighted_line(s, model.residual_weights(model.line_values(s)))
    return line.select(*PX, (F.round(F.col("slope") * 365.25, 5) + 0.0).alias("velocity"), (F.round(F.col("sigma") * 365.25, 5) + 0.0).alias("sigma"))


@query(f"WITH {SERIES_E}, {WEIGHTED} SELECT s.prow, s.pcol, s.t, round(m * s.t + b - atmo, 5) + 0.0 AS value FROM series_e s JOIN wl USING (prow, pcol) JOIN atmo USING (prow, pcol)")
def model_without_atmosphere(spark, sf):
    from phasegrid.plans.workflow import model_history

    h = series_e(spark, sf).select(*PX, "date", F.col("value").alias("defo"))
    return model_history(h)["model"].select(*PX, "t", (F.round("value", 5) + 0.0).alias("value"))


@query()
def lowess_smooth(spark, sf):
    """Robust local lines (iterative)."""
    return model.lowess(series_e(spark, sf), min_days=12.0)


@query(f"""WITH {SERIES_E}, g AS (SELECT a.prow, a.pcol, a.t, b.value AS y, b.t - a.t AS x, power(1 - power(abs(b.t - a.t) / 10.0, 3), 3) AS w FROM series_e a JOIN series_e b ON b.prow = a.prow AND b.pcol = a.pcol AND abs(b.t - a.t) < 10),
s AS (SELECT prow, pcol, t, sum(w) AS s0, sum(w*x) AS s1, sum(w*x*x) AS s2, sum(w*y) AS b0, sum(w*x*y) AS b1 FROM g GROUP BY 1, 2, 3)
SELECT prow, pcol, t, round((s2*b0 - s1*b1) / (s0*s2 - s1*s1), 6) + 0.0 AS smooth FROM s""")
def lowess_fixed_window(spark, sf):
    return six(model.fixed_window_smooth(series_e(spark, sf), 10), "smooth")


# --- differences and selections

@query(f"WITH {SERIES_E} SELECT prow, pcol, date, step, round(difference, 6) + 0.0 AS difference FROM (SELECT prow, pcol, date, 1 AS step, value - lag(value, 1) OVER (PARTITION BY prow, pcol ORDER BY date) AS difference FROM series_e UNION ALL SELECT prow, pcol, date, 2, value - lag(value, 2) OVER (PARTITION BY prow, pcol ORDER BY date) FROM series_e) WHERE difference IS NOT NULL")
def skip_interval_differences(spark, sf):
    return six(tracks.lag_difference(series_e(spark, sf), list(PX), "date", "value", [1, 2]), "difference")


@query(f"WITH {SERIES_E} SELECT prow, pcol, t, round(value - first_value(value) OVER (PARTITION BY prow, pcol ORDER BY t), 6) + 0.0 AS value FROM series_e")
def difference_to_first(spark, sf):
    return six(tracks.since_first(series_e(spark, sf), list(PX), "t", "value"), "value").select(*PX, "t", "value")


@query(f"WITH {SERIES_E} SELECT prow, pcol, round(avg(value), 6) + 0.0 AS mean FROM (SELECT *, row_number() OVER (PARTITION BY prow, pcol ORDER BY t DESC) AS n FROM series_e) WHERE n <= 3 GROUP BY 1, 2")
def mean_of_last_three(spark, sf):
    s = series_e(spark, sf).select(F.struct(*PX).alias("p"), F.col("t").alias("x"), F.col("value").alias("y"))
    return six(robust.last_mean(s, "p"), "mean").select("p.prow", "p.pcol", "mean")


@query(f"WITH {CUBE_L} SELECT prow, pcol, round(nullif(CASE WHEN masked THEN 0 ELSE value END, 0), 6) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY prow, pcol ORDER BY layer DESC) AS n FROM cube_l) WHERE n = 1")
def last_layer_masked(spark, sf):
    last = cube_l(spark, sf).groupBy(*PX).agg(F.max_by(F.struct("value", "masked"), "layer").alias("s"))
    return six(last.select(*PX, F.nullif(F.when(F.col("s.masked"), 0.0).otherwise(F.col("s.value")), F.lit(0.0)).alias("value")), "value")


@query(f"WITH {CUBE_L}, q AS (SELECT prow, pcol, CAST(sum(CAST(masked AS INTEGER)) AS BIGINT) AS missing, avg(cor) AS cor_mean FROM cube_l GROUP BY 1, 2) SELECT layer, prow, pcol, round(CASE WHEN missing > (SELECT avg(missing) FROM q) OR cor_mean < 0.49 THEN 0 ELSE value END, 6) + 0.0 AS value FROM cube_l JOIN q USING (prow, pcol)")
def los_mask_apply(spark, sf):
    c = cube_l(spark, sf)
    q = c.groupBy(*PX).agg(F.sum(F.col("masked").cast("int")).alias("missing"), F.avg("cor").alias("cor_mean"))
    limit = q.agg(F.avg("missing")).first()[0]
    return six(tracks.los_mask(c, q, "value", max_missing=limit, min_cor=0.49), "value").select("layer", *PX, "value")


@query(f"WITH {CUBE_L} SELECT layer, prow, pcol, round(CASE WHEN masked THEN 0 ELSE value + 1.25 END, 6) + 0.0 AS value, round(value * layer / 3650, 6) + 0.0 AS rescaled FROM cube_l")
def correction_keeps_zero(spark, sf):
    c = cube_l(spark, sf).withColumn("rescaled", F.col("value") * F.col("layer") / 3650)
    v = add_keeping_zero(F.when(F.col("masked"), 0.0).otherwise(F.col("value")), F.lit(1.25))
    return six(c.withColumn("value", v), "value", "rescaled").select("layer", *PX, "value", "rescaled")


# --- stations

STATION = """station AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) * CAST(0.000123456789 AS DOUBLE) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM station), (SELECT max(date) FROM station), INTERVAL 1 DAY)) AS DATE) AS date),
filled AS (SELECT date, last_value(v IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM cal LEFT JOIN station USING (date)),
rolled AS (SELECT date, avg(v) OVER (ORDER BY date ROWS BETWEEN 360 PRECEDING AND 359 FOLLOWING) AS g FROM filled)"""


def _station(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return o.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg((F.avg("o_totalprice") * F.lit(0.000123456789)).alias("value")).withColumn("name", F.lit("S"))


@query(f"WITH {STATION} SELECT date, round(v, 6) + 0.0 AS filled, round(g, 6) + 0.0 AS rolled FROM filled JOIN rolled USING (date)")
def station_rolling_mean(spark, sf):
    d = tracks.daily(_station(spark, sf), "name", "value")
    r = tracks.centred_mean(d, "name", "value", 720).select("date", F.col("value").alias("rolled"))
    return six(d.select("date", F.col("value").alias("filled")).join(r, "date"), "filled", "rolled")


DATED_L = CUBE_L + ", h AS (SELECT CAST(DATE '1995-01-01' + INTERVAL 1 MONTH * layer AS DATE) AS date, prow, pcol, CASE WHEN masked THEN 0 ELSE value END AS value FROM cube_l)"


def _dated(spark, sf):
    date = F.add_months(F.lit("1995-01-01").cast("date"), F.col("layer"))
    return cube_l(spark, sf).select(date.alias("date"), *PX, F.when(F.col("masked"), 0.0).otherwise(F.col("value")).alias("value"))


@query(f"""WITH {STATION}, {DATED_L}, off AS (SELECT date, g - value AS c FROM h JOIN rolled USING (date) WHERE prow = 3 AND pcol = 5),
bad AS (SELECT coalesce(bool_or(c IS NULL), FALSE) AS gone FROM off)
SELECT date, prow, pcol, round(CASE WHEN value = 0 THEN 0 WHEN gone THEN value ELSE value + c END, 6) + 0.0 AS value FROM h JOIN off USING (date), bad""")
def gps_reference_correction(spark, sf):
    out = tracks.reference_to_station(_dated(spark, sf), _station(spark, sf), (F.col("prow") == 3) & (F.col("pcol") == 5))
    return six(out, "value").select("date", *PX, "value")


@query(f"""WITH {DATED_L}, y AS (SELECT make_date(CAST(k AS INTEGER), 12, 31) AS date FROM range(1995, 2002) r(k)), p AS (SELECT DISTINCT prow, pcol FROM h),
b AS (SELECT p.prow, p.pcol, y.date, (SELECT max(h.date) FROM h WHERE h.prow = p.prow AND h.pcol = p.pcol AND h.date <= y.date) AS d0, (SELECT min(h.date) FROM h WHERE h.prow = p.prow AND h.pcol = p.pcol AND h.date >= y.date) AS d1 FROM p, y)
SELECT b.prow, b.pcol, b.date, round(CASE WHEN d0 = d1 THEN u.value ELSE u.value + (v.value - u.value) * (b.date - d0) / (d1 - d0) END, 6) + 0.0 AS value
FROM b JOIN h u ON u.prow = b.prow AND u.pcol = b.pcol AND u.date = d0 JOIN h v ON v.prow = b.prow AND v.pcol = b.pcol AND v.date = d1""")
def annual_interpolation(spark, sf):
    years = spark.range(1995, 2002).select(F.make_date("id", F.lit(12), F.lit(31)).alias("date"))
    return six(tracks.resample(_dated(spark, sf), list(PX), "value", years), "value").select(*PX, "date", "value")


# --- tracks

UNIT = {"asc": ("0.38 + 0.01 * {c}", "0.90 - 0.005 * {r}"), "desc": ("-0.41 + 0.008 * {c}", "0.88 - 0.004 * {r}")}


def _side(df, value, which):
    e, u = UNIT[which]
    return df.select("layer", *PX, F.col(value).alias("los"), F.expr(e.format(c="pcol")).cast("double").alias("e"), F.expr(u.format(r="prow")).cast("double").alias("u"))


@query(f"""WITH {CUBE_L}, s AS (SELECT layer, prow, pcol, value AS a, quantity AS d, CAST(0.38 + 0.01 * pcol AS DOUBLE) AS ea, CAST(0.90 - 0.005 * prow AS DOUBLE) AS ua, CAST(-0.41 + 0.008 * pcol AS DOUBLE) AS ed, CAST(0.88 - 0.004 * prow AS DOUBLE) AS ud FROM cube_l)
SELECT layer, prow, pcol, round((a * ud - d * ua) / (ea * ud - ed * ua), 6) + 0.0 AS east, round((ea * d - ed * a) / (ea * ud - ed * ua), 6) + 0.0 AS up FROM s""")
def east_up_decomposition(spark, sf):
    c = cube_l(spark, sf)
    return six(tracks.east_up(_side(c, "value", "asc"), _side(c, "quantity", "desc"), ["layer", *PX]), "east", "up")


@query(f"""WITH {CUBE_L}, w AS (SELECT layer, prow, pcol, value FROM cube_l WHERE pcol <= 5), e AS (SELECT layer, prow, pcol, quantity AS value FROM cube_l WHERE pcol >= 3),
o AS (SELECT w.layer, min(pcol) AS l, max(pcol) AS h FROM w JOIN e USING (layer, prow, pcol) GROUP BY 1)
SELECT layer, prow, pcol, round(CASE WHEN w.value IS NULL THEN e.value WHEN e.value IS NULL THEN w.value ELSE (1 - t) * w.value + t * e.value END, 6) + 0.0 AS value
FROM (SELECT layer, prow, pcol, w.value AS wv, e.value AS ev FROM w FULL JOIN e USING (layer, prow, pcol)) x LEFT JOIN w USING (layer, prow, pcol) LEFT JOIN e USING (layer, prow, pcol) LEFT JOIN (SELECT *, 0 AS z FROM o) o USING (layer), LATERAL (SELECT CASE WHEN h > l THEN (pcol - l)::DOUBLE / (h - l) ELSE 0.5 END AS t) q""")
def merge_blend(spark, sf):
    c = cube_l(spark, sf)
    west = c.filter("pcol <= 5").select("layer", *PX, "value")
    east = c.filter("pcol >= 3").select("layer", *PX, F.col("quantity").alias("value"))
    return six(tracks.merge_blended(west, east, ["layer"]), "value")


@query(f"WITH {CUBE_L}, t AS (SELECT layer, prow, pcol, CASE WHEN masked THEN 0 ELSE value END AS v FROM cube_l WHERE prow < 6), b AS (SELECT layer, prow, pcol, quantity AS v FROM cube_l WHERE prow > 1) SELECT layer, prow, pcol, round(coalesce(nullif(t.v, 0), b.v, 0), 6) + 0.0 AS value FROM t FULL JOIN b USING (layer, prow, pcol)")
def overlay_strips(spark, sf):
    c = cube_l(spark, sf)
    top = c.filter("prow < 6").select("layer", *PX, F.when(F.col("masked"), 0.0).otherwise(F.col("value")).alias("value"))
    return six(tracks.overlay(top, c.filter("prow > 1").select("layer", *PX, F.col("quantity").alias("value")), ["layer", *PX], "value"), "value")


@query(f"WITH {CUBE_L} SELECT layer, prow, pcol, round(value - quantity, 6) + 0.0 AS difference FROM cube_l WHERE NOT masked AND prow BETWEEN 2 AND 5 AND value <> 0 AND quantity <> 0")
def overlap_difference(spark, sf):
    c = cube_l(spark, sf)
    a = c.filter("prow < 6").select("layer", *PX, F.when(F.col("masked"), 0.0).otherwise(F.col("value")).alias("value"))
    return six(tracks.overlap_difference(a, c.filter("prow > 1").select("layer", *PX, F.col("quantity").alias("value")), ["layer", *PX], "value"), "difference")


@query(f"WITH {IMAGES}, f AS (SELECT date // 3 AS day, date % 3 AS part, prow, pcol, CASE WHEN value > 0 THEN value ELSE 0 END AS v FROM images) SELECT day, prow, pcol, round(coalesce(arg_min(v, part) FILTER (WHERE v <> 0), 0), 6) + 0.0 AS value FROM f GROUP BY 1, 2, 3")
def stitch_same_date(spark, sf):
    i = images(spark, sf).select(F.expr("date div 3").alias("day"), (F.col("date") % 3).alias("part"), *PX, F.when(F.col("value") > 0, F.col("value")).otherwise(0.0).alias("value"))
    return six(tracks.stitch(i, ["day", *PX], "part", "value"), "value")


@query(f"WITH {CUBE_L} SELECT layer, round(sqrt(avg(power(value * 0.6 + quantity * 0.2 - 20, 2))), 6) + 0.0 AS rms, round(max(abs(value * 0.6 + quantity * 0.2 - 20)), 6) + 0.0 AS max_abs FROM cube_l GROUP BY 1")
def projected_rms(spark, sf):
    """Root mean square and largest of a line-of-sight residual."""
    los = tracks.project(F.col("value"), F.lit(0.0), F.col("quantity"), F.lit(0.6), F.lit(0.0), F.lit(0.2)) - 20
    return six(robust.rms_and_max(cube_l(spark, sf).withColumn("los", los), "layer", F.col("los")), "rms", "max_abs")
