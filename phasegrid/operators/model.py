"""Models over time: polynomials, first-day atmosphere, reweighting, velocities, local regression.

Series come as (prow, pcol, t days, value). Polynomials of low degree are power sums and small
eliminations in SQL; local regression runs on packed series, a batch of pixels at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.operators.quality import percentiles

PIXEL = ("prow", "pcol")
#: Days in a year of rates.
YEAR = 365.25


def line_fit(series: DataFrame, value: str = "value") -> DataFrame:
    return series.groupBy(*PIXEL).agg(F.regr_slope(value, "t").alias("slope"), F.regr_intercept(value, "t").alias("intercept"))


def parabola_fit(series: DataFrame, value: str = "value") -> DataFrame:
    """c0 + c1 t + c2 t² a pixel, from power sums around nothing (t should start near 0)."""
    t, y = F.col("t").cast("double"), F.col(value)
    s = series.groupBy(*PIXEL).agg(*[F.sum(F.pow(t, k)).alias(f"s{k}") for k in range(5)], *[F.sum(F.pow(t, k) * y).alias(f"b{k}") for k in range(3)])
    a, b, c, d, e = (F.col(f"s{k}") for k in range(5))
    p, q, r = (F.col(f"b{k}") for k in range(3))
    det = a * (c * e - d * d) - b * (b * e - c * d) + c * (b * d - c * c)
    c0 = p * (c * e - d * d) - b * (q * e - r * d) + c * (q * d - r * c)
    c1 = a * (q * e - r * d) - p * (b * e - c * d) + c * (b * r - c * q)
    c2 = a * (c * r - d * q) - b * (b * r - c * q) + p * (b * d - c * c)
    return s.select(*PIXEL, *[F.try_divide(x, det).alias(f"c{i}") for i, x in enumerate((c0, c1, c2))])


def line_values(series: DataFrame, value: str = "value") -> DataFrame:
    """series plus model: each pixel's line."""
    fit = line_fit(series, value)
    return series.join(fit, list(PIXEL)).withColumn("model", F.col("slope") * F.col("t") + F.col("intercept")).drop("slope", "intercept")


def first_day_atmosphere(fitted: DataFrame, value: str = "value") -> DataFrame:
    """-mean over later dates of ((model - value) at the date, less the same at the first date)."""
    d = F.col("model") - F.col(value)
    w = Window.partitionBy(*PIXEL).orderBy("t")
    rel = fitted.withColumn("_d", d - F.first_value(d).over(w)).withColumn("_n", F.row_number().over(w))
    return rel.filter("_n > 1").groupBy(*PIXEL).agg((-F.avg("_d")).alias("atmo"))


def residual_weights(fitted: DataFrame, value: str = "value", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(t, weight): one over the spread of the residuals of each date between two percentiles."""
    p = percentiles(fitted.select("t", (F.col("model") - F.col(value)).alias("r")), ["t"], "r", [low, high])
    return p.select("t", (1 / (F.col("p1") - F.col("p0"))).alias("weight"))


def weighted_line(series: DataFrame, weights: DataFrame, value: str = "value") -> DataFrame:
    """slope, intercept and the slope's unscaled deviation a pixel; weights multiply residuals."""
    met = series.join(F.broadcast(weights), "t")
    w, t, y = F.col("weight") * F.col("weight"), F.col("t"), F.col(value)
    s = met.groupBy(*PIXEL).agg(F.sum(w).alias("w"), F.sum(w * t).alias("wt"), F.sum(w * y).alias("wy"), F.sum(w * t * t).alias("wtt"), F.sum(w * t * y).alias("wty"))
    det = F.col("w") * F.col("wtt") - F.col("wt") * F.col("wt")
    slope = (F.col("w") * F.col("wty") - F.col("wt") * F.col("wy")) / det
    return s.select(*PIXEL, slope.alias("slope"), ((F.col("wy") - slope * F.col("wt")) / F.col("w")).alias("intercept"), F.sqrt(F.col("w") / det).alias("sigma"))


def polynomial_by_hat(series: DataFrame, days: list[float], degree: int, weights: list[float] | None = None, value: str = "value") -> DataFrame:
    """Fitted values of any degree: all pixels share their dates (each must have all of them), so the fit is one small matrix (dates x dates) joined by date."""
    t = np.array(days, float)
    v = np.vander((t - t[0]) / max(1.0, t[-1] - t[0]), degree + 1, increasing=True)
    w = np.ones(len(t)) if weights is None else np.array(weights)
    hat = v @ (np.linalg.pinv(v * w[:, None]) * w)
    rows = [(float(t[j]), float(t[i]), float(hat[i, j])) for i in range(len(t)) for j in range(len(t))]
    m = series.sparkSession.createDataFrame(rows, "t double, to double, w double")
    return series.withColumn("t", F.col("t").cast("double")).join(F.broadcast(m), "t").groupBy(*PIXEL, F.col("to").alias("t")).agg(F.sum(F.col("w") * F.col(value)).alias("model"))


def local_line_weights(days: np.ndarray, at: float, half: float) -> np.ndarray:
    d = np.abs(days - at) / half
    return np.where(d < 1, (1 - d**3) ** 3, 0.0)


def smooth_series(t: np.ndarray, y: np.ndarray, min_days: float, rounds: int) -> np.ndarray:
    """Local lines with tricube weights, then `rounds` times with bisquare weights of the residuals; y is pixels x dates.

    The neighbourhood of a date reaches half of min_days to either side, or so far that it holds min_days in all.
    """
    reach = np.maximum(min_days / 2, min_days - np.minimum(t - t[0], t[-1] - t))
    reach = np.maximum(reach, 1e-9) * (1 + 1e-9)
    robust, out = np.ones_like(y), y
    for k in range(rounds + 1):
        out = np.empty_like(y)
        for i, at in enumerate(t):
            w = local_line_weights(t, at, reach[i]) * robust
            x = t - at
            s0, s1, s2 = w.sum(1), (w * x).sum(1), (w * x * x).sum(1)
            b0, b1 = (w * y).sum(1), (w * x * y).sum(1)
            det = s0 * s2 - s1 * s1
            flat = det <= 1e-12 * np.maximum(s0 * s2, 1e-300)
            out[:, i] = np.where(flat, b0 / np.maximum(s0, 1e-300), (s2 * b0 - s1 * b1) / np.where(flat, 1, det))
        if k < rounds:
            r = np.abs(y - out)
            s = np.maximum(6 * np.median(r, axis=1, keepdims=True), 1e-12)
            robust = np.where(r < s, (1 - (r / s) ** 2) ** 2, 0.0)
    return out


def lowess(series: DataFrame, min_days: float = 2 * YEAR, rounds: int = 2, value: str = "value") -> DataFrame:
    """(prow, pcol, t, smooth, atmo): robust local lines less the value at the first date, which is atmo."""
    packed = series.groupBy(*PIXEL).agg(F.array_sort(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), F.col(value).cast("double").alias("y")))).alias("s"))
    kinds = dict(series.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("s").flatten()
            off = np.concatenate([[0], np.cumsum(b.column("s").value_lengths().to_numpy())])
            t, y = flat.field(0).to_numpy(), flat.field(1).to_numpy(zero_copy_only=False)
            smooth, first = np.empty(len(t)), np.empty(len(t))
            by: dict[bytes, list[int]] = {}
            for i in range(b.num_rows):  # pixels with the same dates go together
                by.setdefault(t[off[i] : off[i + 1]].tobytes(), []).append(i)
            for key, rows in by.items():
                days = np.frombuffer(key)
                got = smooth_series(days, np.stack([y[off[i] : off[i + 1]] for i in rows]), min_days, rounds)
                for i, g in zip(rows, got):
                    smooth[off[i] : off[i + 1]] = g - g[0]
                    first[off[i] : off[i + 1]] = g[0]
            take = pa.array(np.repeat(np.arange(b.num_rows), np.diff(off)))
            yield pa.RecordBatch.from_arrays([b.column("prow").take(take), b.column("pcol").take(take), pa.array(t), pa.array(smooth), pa.array(first)], ["prow", "pcol", "t", "smooth", "atmo"])

    return packed.mapInArrow(work, f"prow {kinds['prow']}, pcol {kinds['pcol']}, t double, smooth double, atmo double")


def fixed_window_smooth(series: DataFrame, half: int, value: str = "value") -> DataFrame:
    """One round of tricube local lines over a fixed half width, in SQL: a range join by bins of the half width."""
    s = series.select(*PIXEL, F.col("t").cast("double").alias("t"), F.col(value).alias("y"))
    left = s.select(*PIXEL, F.col("t").alias("at"), F.explode(F.array(*[F.floor(F.col("t") / half) + d for d in (-1, 0, 1)])).alias("_bin"))
    met = left.join(s.withColumn("_bin", F.floor(F.col("t") / half)), [*PIXEL, "_bin"]).filter(F.abs(F.col("t") - F.col("at")) < half)
    x = F.col("t") - F.col("at")
    w = F.pow(1 - F.pow(F.abs(x) / half, 3), 3)
    g = met.groupBy(*PIXEL, F.col("at").alias("t")).agg(F.sum(w).alias("s0"), F.sum(w * x).alias("s1"), F.sum(w * x * x).alias("s2"), F.sum(w * F.col("y")).alias("b0"), F.sum(w * x * F.col("y")).alias("b1"))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    return g.select(*PIXEL, "t", F.when(F.abs(det) < 1e-9, F.col("b0") / F.col("s0")).otherwise((F.col("s2") * F.col("b0") - F.col("s1") * F.col("b1")) / det).alias("smooth"))
