"""From prepared layers to histories, models and merged tracks, each as one lazy plan."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.functions.phase import PHASE_TO_CM
from phasegrid.operators import invert, model, network, pixels, quality, tracks

STEPS = 10


def parse_steps(text: str, most: int = STEPS) -> list[int]:
    """'4,5,7', '3-6', '1,9-10' as sorted step numbers; out of bounds is an error."""
    out: set[int] = set()
    for part in text.split(","):
        a, _, b = part.strip().partition("-")
        out.update(range(int(a), int(b or a) + 1))
    if not out or min(out) < 1 or max(out) > most:
        raise ValueError(f"steps are 1 to {most}: {text}")
    return sorted(out)


def parse_extra(args: list[str]) -> dict[str, bool | float | str]:
    """'--num-sigma 3' as {'num_sigma': 3.0}; a flag without a value is true."""
    out: dict[str, bool | float | str] = {}
    key = None
    for a in args:
        if a.startswith("--"):
            key = a[2:].replace("-", "_")
            out[key] = True
        elif key:
            out[key] = float(a) if re.fullmatch(r"-?\d+(\.\d*)?([eE]-?\d+)?", a) else {"true": True, "false": False}.get(a.lower(), a)
            key = None
    return out


def block_shape(depth: int, rows: int, cols: int, chunk: tuple[int, int], item: int = 4, most: float = 10e6) -> tuple[int, int]:
    """Rows and columns of a full-depth block within `most` bytes: rows grow by chunks first, then columns."""
    r, c = min(chunk[0], rows), min(chunk[1], cols)
    while r < rows and depth * min(r + chunk[0], rows) * c * item <= most:
        r = min(r + chunk[0], rows)
    while c < cols and depth * r * min(c + chunk[1], cols) * item <= most:
        c = min(c + chunk[1], cols)
    return r, c


@dataclass(frozen=True)
class Reference:
    row: int
    col: int
    lat: float
    lon: float
    station: str = ""


def find_reference(grid: DataFrame, station: str | None = None, lat: float | None = None, lon: float | None = None, row: int | None = None, col: int | None = None, stations: DataFrame | None = None) -> Reference:
    """The reference pixel of a grid (prow, pcol, lat, lon), regular or radar geometry: a station's place goes before lat and
    lon, these before row and col. The nearest pixel is taken, of equally near ones the first; nothing usable is an error."""
    if station is not None:
        place = stations.filter(F.col("name") == station).select("lat", "lon").first() if stations is not None else None
        if place is None:
            raise ValueError(f"no station {station}")
        lat, lon = place
    if lat is not None and lon is not None:
        d = F.pow(F.col("lat") - lat, 2) + F.pow(F.col("lon") - lon, 2)
        found = grid.agg(F.min(F.struct(d.alias("d"), "prow", "pcol", "lat", "lon")).alias("b")).first().b  # combined on the map side
        if found is None:
            raise ValueError("the grid is empty")
        return Reference(found.prow, found.pcol, lat, lon, station or "")
    if row is not None and col is not None:
        found = grid.filter((F.col("prow") == row) & (F.col("pcol") == col)).select("lat", "lon").first()
        if found is None:
            raise ValueError(f"no pixel ({row}, {col})")
        return Reference(row, col, found.lat, found.lon)
    raise ValueError("need a station, or lat and lon, or row and col")


def redo_reference(stack: DataFrame, reference: Reference, order: int | None = None, window: int = 5, layer: str = "ifg_idx", value: str = "phase") -> tuple[DataFrame, dict]:
    """The stack deramped (if an order is given) and shifted to another reference window, and the attributes that tell so."""
    out = pixels.deramp(stack, layer, value, order) if order else stack
    told = {"reference": [reference.row, reference.col], "reference_latlon": [reference.lat, reference.lon], "reference_window": window, "reference_station": reference.station}
    return pixels.reference_shift(out, layer, value, reference.row, reference.col, window), told


def reference_by_elevation(stack: DataFrame, dem: DataFrame, looks: int = 1, where=None, layer: str = "ifg_idx", value: str = "phase") -> tuple[DataFrame, dict]:
    """The stack without each layer's line over elevation, and the attributes: no pixel is the reference."""
    return pixels.elevation_trend(stack, dem, layer, value, looks, where), {"reference": [-1, -1], "reference_latlon": [0.0, 0.0], "reference_window": 0, "reference_station": ""}


@dataclass
class Prepare:
    order: int = 1
    reference: tuple[int, int] | None = None
    window: int = 5
    cor_share: float = 0.6


def prepare_stack(phase: DataFrame, cor: DataFrame | None, masks: DataFrame | None, settings: Prepare) -> DataFrame:
    """Layers (ifg_idx, prow, pcol, phase) masked, deramped on good pixels, and shifted to the reference window."""
    out = phase
    if masks is not None:
        out = out.join(masks.select("ifg_idx", "prow", "pcol", "masked"), ["ifg_idx", "prow", "pcol"], "left").withColumn("phase", F.when(~F.coalesce("masked", F.lit(False)), F.col("phase"))).drop("masked")
    where = None
    if cor is not None:
        limit = pixels.auto_threshold(cor, "cor", settings.cor_share)
        out = out.join(cor.select("ifg_idx", "prow", "pcol", "cor"), ["ifg_idx", "prow", "pcol"], "left").join(F.broadcast(limit))
        where = F.col("cor") >= F.col("threshold")
    out = pixels.deramp(out, "ifg_idx", "phase", settings.order, where).drop("cor", "threshold")
    if settings.reference is not None:
        out = pixels.reference_shift(out, "ifg_idx", "phase", *settings.reference, settings.window)
    return out


@dataclass
class Inversion:
    low: str | None = None
    high: str | None = None
    max_days: int | None = None
    max_steps: int | None = None
    annual: bool = False
    velocity: bool = False
    weighted: bool = False
    alpha: float = 0.0
    cor_threshold: float = 0.0
    scale: float = PHASE_TO_CM


def run_inversion(stack: DataFrame, pairs: DataFrame, ignored: DataFrame | None = None, cor: DataFrame | None = None, settings: Inversion = Inversion()) -> dict[str, DataFrame]:
    """history, pixel quality, dates and pairs. The pair list is filtered first, so the stack is read for the pairs that stay only."""
    dates, kept = network.filter_network(pairs, settings.low, settings.high, ignored, settings.max_days, settings.max_steps, annual=settings.annual)
    used = stack.join(F.broadcast(kept.select("ifg_idx")), "ifg_idx", "left_semi")
    out: dict[str, DataFrame] = {"dates": dates, "pairs": kept}
    if cor is not None:
        c = cor.join(F.broadcast(kept.select("ifg_idx")), "ifg_idx", "left_semi")
        if settings.cor_threshold:
            used = pixels.below_threshold_to_zero(used.join(c, ["ifg_idx", "prow", "pcol"]), "cor", "phase", settings.cor_threshold).drop("cor")
        out["correlation"] = quality.correlation_summary(c, settings.cor_threshold or None)
    out["history"] = invert.invert(used, kept, settings.scale, settings.velocity, settings.weighted, settings.alpha)
    out["coherence"] = invert.temporal_coherence(used, kept, out["history"], settings.scale)
    return out


def model_history(history: DataFrame, weighted: bool = True) -> dict[str, DataFrame]:
    """Line, first-day atmosphere, weighted velocity a year, and the atmosphere-free model of (prow, pcol, date, defo)."""
    first = history.agg(F.min("date").alias("_0"))
    series = history.join(F.broadcast(first)).select("prow", "pcol", F.datediff("date", "_0").cast("double").alias("t"), F.col("defo").alias("value"))
    fitted = model.line_values(series)
    atmo = model.first_day_atmosphere(fitted)
    weights = model.residual_weights(fitted) if weighted else series.select("t").distinct().withColumn("weight", F.lit(1.0))
    line = model.weighted_line(series, weights)
    clean = series.join(line, ["prow", "pcol"]).join(atmo, ["prow", "pcol"])
    value = F.col("slope") * F.col("t") + F.col("intercept") - F.col("atmo")
    return {"atmosphere": atmo, "velocity": line.select("prow", "pcol", (F.col("slope") * model.YEAR).alias("velocity"), (F.col("sigma") * model.YEAR).alias("sigma")), "model": clean.select("prow", "pcol", "t", value.alias("value"))}


@dataclass
class TrackJob:
    """A track's options: common ones of [los] overlaid by its own."""

    name: str
    options: dict = field(default_factory=dict)


def read_jobs(path: str) -> tuple[dict, list[TrackJob]]:
    """A TOML file of jobs: the whole, and each path's [los] options over the common ones."""
    with open(path, "rb") as f:
        config = tomllib.load(f)
    common = config.get("los", {})
    return config, [TrackJob(k, {**common, **v.get("los", {})}) for k, v in config.get("paths", {}).items()]


def east_up_tracks(asc: list[DataFrame], desc: list[DataFrame], steps: list[int]) -> dict[str, DataFrame]:
    """Decomposes each ascending and descending pair, merges two results west to east, and differences over dates."""
    parts = [tracks.east_up(a, d, ["date", "prow", "pcol"]) for a, d in zip(asc, desc)]
    if len(parts) > 2:
        raise ValueError("two areas at most are merged")
    merged = parts[0]
    if len(parts) == 2:
        e, u = (tracks.merge_blended(parts[0].withColumnRenamed(c, "value"), parts[1].withColumnRenamed(c, "value"), ["date"]).withColumnRenamed("value", c) for c in ("east", "up"))
        merged = e.join(u, ["date", "prow", "pcol"])
    return {"east_up": merged, "differences": tracks.lag_difference(merged, ["prow", "pcol"], "date", "up", steps)}
