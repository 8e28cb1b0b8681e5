"""Inversion of pairwise differences into histories.

All pixels share one design, so its pseudo-inverse is made once on the driver (dates x pairs numbers)
and joined to the phases by pair: the whole inversion is one equal join and one grouped sum, or, for
packed pixels, one matrix product an Arrow batch. Weights by correlation differ by pixel and go to a
batched kernel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ("prow", "pcol")
#: Entries up to which a matrix is broadcast as rows (about 32 bytes each); a larger one is applied to packed pixels.
BROADCAST_ENTRIES = 1_000_000


def design(pairs: list[tuple], dates: list, velocity: bool = False) -> np.ndarray:
    """A (pairs x later dates): -1, +1; or B (pairs x intervals): days of the intervals inside a pair."""
    place = {d: i for i, d in enumerate(dates)}
    days = np.diff([d.toordinal() if hasattr(d, "toordinal") else d for d in dates])
    out = np.zeros((len(pairs), len(dates) - 1))
    for row, (early, late) in zip(out, pairs):
        i, j = place[early], place[late]
        if velocity:
            row[i:j] = days[i:j]
        else:
            row[j - 1] = 1
            if i:
                row[i - 1] = -1
    return out


def difference(n: int, order: int = 1) -> np.ndarray:
    d = np.eye(n) - np.eye(n, k=1)
    return d[:-1] if order == 1 else d[:-1].T @ d[:-1]


def pseudo_inverse(g: np.ndarray, weights: np.ndarray | None = None, alpha: float = 0.0, smooth: bool = False) -> np.ndarray:
    """Unknowns x pairs. weights scale rows; alpha > 0 adds alpha times the identity (or first differences) below."""
    m = len(g)
    w = np.ones(m) if weights is None else np.asarray(weights)
    full = g * w[:, None]
    if alpha:
        full = np.vstack([full, alpha * (difference(g.shape[1]) if smooth else np.eye(g.shape[1]))])
    return np.linalg.pinv(full)[:, :m] * w


def collected(pairs: DataFrame) -> tuple[list[int], list[tuple], list]:
    """The network on the driver (one row a pair): ids, pairs, dates."""
    rows = pairs.select("ifg_idx", "early", "late").orderBy("ifg_idx").collect()
    return [r.ifg_idx for r in rows], [(r.early, r.late) for r in rows], sorted({d for r in rows for d in (r.early, r.late)})


def matrix_frame(spark, m: np.ndarray, ids: list[int], unknowns: list, first=None) -> DataFrame:
    """Long (k, unknown, ifg_idx, w) of a matrix, without zeros; first: a date that is zero for every pixel, as k = -1. With
    it the zeros stay, so that a pixel with few pairs gets every unknown."""
    rows = [(i, unknowns[i], ids[j], float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1]) if first is not None or abs(m[i, j]) > 1e-14]
    if first is not None:
        rows += [(-1, first, j, 0.0) for j in ids]
    return spark.createDataFrame(rows, "k int, unknown date, ifg_idx int, w double" if unknowns and hasattr(unknowns[0], "toordinal") else "k int, unknown int, ifg_idx int, w double")


def apply_matrix(stack: DataFrame, matrix: DataFrame, value: str = "phase") -> DataFrame:
    """(prow, pcol, k, unknown, x): the matrix times each pixel's phases; absent phases count as 0."""
    x = F.coalesce(F.when(~F.isnan(value), F.col(value)), F.lit(0.0))
    return stack.join(F.broadcast(matrix), "ifg_idx").groupBy(*PIXEL, "k", "unknown").agg(F.sum(F.col("w") * x).alias("x"))


def with_zero_date(history: DataFrame, first, scale: float = 1.0) -> DataFrame:
    """(prow, pcol, date, defo): the solved dates times scale, and zero at the first."""
    kind = dict(history.dtypes)["unknown"]
    zero = history.select(*PIXEL).distinct().select(*PIXEL, F.lit(first).cast(kind).alias("date"), F.lit(0.0).alias("defo"))
    return history.select(*PIXEL, F.col("unknown").alias("date"), (F.col("x") * scale).alias("defo")).unionByName(zero)


def invert(stack: DataFrame, pairs: DataFrame, scale: float = 1.0, velocity: bool = False, weighted: bool = False, alpha: float = 0.0, smooth: bool = False, value: str = "phase") -> DataFrame:
    """Displacement history (prow, pcol, date, defo) of stack (ifg_idx, prow, pcol, phase); weighted: by 1 / √dt; velocity: solve for interval velocities and integrate.

    A pair listed twice under one index, or one that doesn't run forward, is an error. Phases of pairs that aren't listed are left out."""
    ids, ends, dates = collected(pairs)
    if not ids:
        return stack.sparkSession.createDataFrame([], "prow int, pcol int, date date, defo double")
    if len(set(ids)) < len(ids):
        raise ValueError("an index names several pairs")
    if any(a >= b for a, b in ends):
        raise ValueError("a pair must run from an earlier to a later date")
    g = design(ends, dates, velocity)
    w = None
    if weighted:
        w = 1 / np.sqrt([float((b - a).days if hasattr(b - a, "days") else b - a) for a, b in ends])
        w = w / w.max()
    p = pseudo_inverse(g, w, alpha, smooth)
    if p.size <= BROADCAST_ENTRIES:
        x = apply_matrix(stack, matrix_frame(stack.sparkSession, p, ids, dates[1:], dates[0]), value)
    else:
        x = unpacked(invert_packed(packed(complete(stack, ids, value), value), p), dates)
    if velocity:
        x = integrate(x, [float((b - a).days if hasattr(b - a, "days") else b - a) for a, b in zip(dates, dates[1:])])
    return x.select(*PIXEL, F.col("unknown").alias("date"), (F.col("x") * scale).alias("defo"))


def integrate(velocities: DataFrame, days: list[float]) -> DataFrame:
    """Running sums of x * days over k; k = -1 is the zero at the first date."""
    step = F.when(F.col("k") >= 0, F.element_at(F.array(*[F.lit(d) for d in days]), F.greatest(F.col("k") + 1, F.lit(1)))).otherwise(0.0)
    w = Window.partitionBy(*PIXEL).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return velocities.withColumn("x", F.sum(F.col("x") * step).over(w))


def constant_velocity(stack: DataFrame, pairs: DataFrame, value: str = "phase") -> DataFrame:
    """One velocity a pixel: Σ dt φ / Σ dt²."""
    met = stack.join(F.broadcast(pairs.select("ifg_idx", F.col("dt_days").cast("double").alias("_dt"))), "ifg_idx")
    return met.groupBy(*PIXEL).agg((F.sum(F.col("_dt") * F.col(value)) / F.sum(F.col("_dt") * F.col("_dt"))).alias("velocity"))


def stack_velocity(stack: DataFrame, pairs: DataFrame, value: str = "phase", scale: float = 1.0) -> DataFrame:
    """Stack average: Σ φ / Σ dt."""
    met = stack.join(F.broadcast(pairs.select("ifg_idx", F.col("dt_days").cast("double").alias("_dt"))), "ifg_idx")
    return met.groupBy(*PIXEL).agg((scale * F.sum(value) / F.sum("_dt")).alias("velocity"))


def temporal_coherence(stack: DataFrame, pairs: DataFrame, history: DataFrame, scale: float = 1.0, value: str = "phase") -> DataFrame:
    """|Σ exp(i residual)| / M a pixel, 0 where the phases sum to 0. A pixel's history (one number a date) comes as a map, so the stack is joined by pixel once."""
    h = history.groupBy(*PIXEL).agg(F.map_from_entries(F.collect_list(F.struct("date", F.col("defo") / scale))).alias("_h"))
    met = stack.join(F.broadcast(pairs.select("ifg_idx", "early", "late")), "ifg_idx").join(h, list(PIXEL))
    r = F.col(value) - (F.col("_h")[F.col("late")] - F.col("_h")[F.col("early")])
    c = F.sqrt(F.pow(F.sum(F.cos(r)), 2) + F.pow(F.sum(F.sin(r)), 2)) / F.count("*")
    return met.groupBy(*PIXEL).agg(F.when(F.sum(value) == 0, 0.0).otherwise(c).alias("temp_coh"))


def packed(stack: DataFrame, value: str = "phase") -> DataFrame:
    """(prow, pcol, phase array by ifg_idx)."""
    return stack.groupBy(*PIXEL).agg(F.transform(F.array_sort(F.collect_list(F.struct("ifg_idx", value))), lambda s: s[value]).alias(value))


def complete(stack: DataFrame, ids: list[int], value: str = "phase") -> DataFrame:
    """Every pixel with every pair; pairs that a pixel lacks hold null."""
    every = stack.select(*PIXEL).distinct().withColumn("ifg_idx", F.explode(F.lit(ids)))
    return every.join(stack.select("ifg_idx", *PIXEL, value), ["ifg_idx", *PIXEL], "left")


def unpacked(solved: DataFrame, unknowns: list) -> DataFrame:
    """(prow, pcol, k, unknown, x) of packed solutions; the first of the unknowns is zero and gets k = -1."""
    names = F.array(*[F.lit(u) for u in unknowns])
    rows = solved.select(*PIXEL, F.posexplode(F.concat(F.array(F.lit(0.0)), "x")).alias("k", "x"))
    return rows.select(*PIXEL, (F.col("k") - 1).alias("k"), F.element_at(names, F.col("k") + 1).alias("unknown"), "x")


def invert_packed(pixels: DataFrame, p: np.ndarray, value: str = "phase") -> DataFrame:
    """pixels (prow, pcol, phase array) plus x array: one product p · phases for each Arrow batch."""
    told = pixels.sparkSession.sparkContext.broadcast(p)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = told.value
        for b in batches:
            flat = b.column("phase").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, p.shape[1])
            x = np.nan_to_num(flat) @ p.T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, p.shape[0], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("prow"), b.column("pcol"), lists], ["prow", "pcol", "x"])

    kinds = dict(pixels.dtypes)
    return pixels.select(*PIXEL, F.col(value).alias("phase")).mapInArrow(work, f"prow {kinds['prow']}, pcol {kinds['pcol']}, x array<double>")


def _per_pixel(pixels: DataFrame, g: np.ndarray, solve, extra: str = "") -> DataFrame:
    told = pixels.sparkSession.sparkContext.broadcast(g)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = told.value
        for b in batches:
            arrays = [b.column(i).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, len(g)) for i in range(2, b.num_columns)]
            x = solve(g, *(np.nan_to_num(a) for a in arrays))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, g.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("prow"), b.column("pcol"), lists], ["prow", "pcol", "x"])

    kinds = dict(pixels.dtypes)
    return pixels.mapInArrow(work, f"prow {kinds['prow']}, pcol {kinds['pcol']}, x array<double>")


def invert_by_correlation(pixels: DataFrame, g: np.ndarray) -> DataFrame:
    """pixels (prow, pcol, phase array, cor array): rows of design and phases scaled by the pixel's correlations, solved through the normal equations."""

    def solve(g: np.ndarray, phase: np.ndarray, cor: np.ndarray) -> np.ndarray:
        a = cor[:, :, None] * g
        return np.einsum("pij,pj->pi", np.linalg.pinv(np.einsum("pmi,pmj->pij", a, a), hermitian=True), np.einsum("pmi,pm->pi", a, cor * phase))

    return _per_pixel(pixels.select(*PIXEL, "phase", "cor"), g, solve)


def l1_solve(g: np.ndarray, phase: np.ndarray, tolerance: float = 1e-6, rounds: int = 20_000) -> np.ndarray:
    """For each row of phase the x of least Σ|g x - phase|, to a relative duality gap of `tolerance`.

    ADMM on rows scaled by their mean absolute least-squares residual, so that units don't matter. Its scaled multipliers lie
    in [-1, 1]; made orthogonal to the columns of g they are a dual point, whose value bounds the optimum from below. Rows
    whose gap is small enough are done; a row that isn't after all rounds raises an error.
    """
    pinv = np.linalg.pinv(g)
    least = phase @ pinv.T
    size = np.abs(least @ g.T - phase).mean(axis=1)
    out, open_ = least, np.flatnonzero(size > 1e-13 * np.abs(phase).max(axis=1, initial=0.0))
    b = phase[open_] / size[open_, None]
    best, lower = np.full(len(open_), np.inf), np.full(len(open_), -np.inf)
    z, u = np.zeros_like(b), np.zeros_like(b)
    for k in range(1, rounds + 1):
        x = (b + z - u) @ pinv.T
        r = x @ g.T - b
        z = np.sign(r + u) * np.maximum(np.abs(r + u) - 1, 0)
        u = u + r - z
        if k % 20 and k != rounds:
            continue
        value = np.abs(r).sum(axis=1)
        new = value < best
        out[open_[new]] = x[new] * size[open_[new], None]
        best = np.minimum(best, value)
        y = u - (u @ pinv.T) @ g.T
        y /= np.maximum(1.0, np.abs(y).max(axis=1))[:, None]
        lower = np.maximum(lower, -(b * y).sum(axis=1))
        left = best - lower > tolerance * best
        if not left.any():
            return out
        open_, b, z, u, best, lower = (v[left] for v in (open_, b, z, u, best, lower))
    if len(open_):
        raise ArithmeticError(f"{len(open_)} of {len(phase)} pixels miss a gap of {tolerance} after {rounds} rounds")
    return out


def invert_l1(pixels: DataFrame, g: np.ndarray, rounds: int = 20_000, tolerance: float = 1e-6) -> DataFrame:
    """pixels (prow, pcol, phase array): least absolute residuals; a single unknown is an exact weighted median."""

    def solve(g: np.ndarray, phase: np.ndarray) -> np.ndarray:
        if g.shape[1] == 1:
            return np.array([[weighted_median(p / g[:, 0], np.abs(g[:, 0]))] for p in phase])
        return l1_solve(g, phase, tolerance, rounds)

    return _per_pixel(pixels.select(*PIXEL, "phase"), g, solve)


def weighted_median(x: np.ndarray, w: np.ndarray) -> float:
    """The least x with half of the weight at or below it; the mean with the next if it is exactly half."""
    order = np.argsort(x, kind="stable")
    total = np.cumsum(w[order])
    i = int(np.searchsorted(total, total[-1] / 2 - 1e-12))
    if abs(total[i] - total[-1] / 2) < 1e-9 and i + 1 < len(x):
        return float((x[order][i] + x[order][i + 1]) / 2)
    return float(x[order][i])


def velocity_and_jump(stack: DataFrame, pairs: DataFrame, event: str, value: str = "phase") -> DataFrame:
    """Per pixel the velocity and step of φ = v dt + s j, j being 1 for pairs after the event."""
    from phasegrid.operators.network import crosses

    net = pairs.select("ifg_idx", F.col("dt_days").cast("double").alias("_t"), crosses(event).cast("double").alias("_j"))
    met = stack.join(F.broadcast(net), "ifg_idx")
    t, j, y = F.col("_t"), F.col("_j"), F.col(value)
    s = met.groupBy(*PIXEL).agg(F.sum(t * t).alias("tt"), F.sum(t * j).alias("tj"), F.sum(j * j).alias("jj"), F.sum(t * y).alias("ty"), F.sum(j * y).alias("jy"))
    det = F.col("tt") * F.col("jj") - F.col("tj") * F.col("tj")
    v = F.when(det == 0, F.try_divide(F.col("ty"), F.col("tt"))).otherwise(F.try_divide(F.col("ty") * F.col("jj") - F.col("jy") * F.col("tj"), det))
    step = F.when(det == 0, 0.0).otherwise(F.try_divide(F.col("tt") * F.col("jy") - F.col("tj") * F.col("ty"), det))
    return s.select(*PIXEL, v.alias("velocity"), step.alias("step"))
