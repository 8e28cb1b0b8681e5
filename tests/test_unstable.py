"""Rows whose last bits differ each time that they are made, as sums of doubles do on several executors."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phasegrid.operators import model, quality
from phasegrid.plans.workflow import model_history

PIXELS, DATES = 20, 40


@pytest.fixture(autouse=True)
def each_time_anew(spark):
    """Shuffles aren't shared between passes, as when they are joins with small tables."""
    spark.conf.set("spark.sql.exchange.reuse", False)
    yield
    spark.conf.unset("spark.sql.exchange.reuse")


@pytest.fixture(scope="module")
def value():
    r = np.random.default_rng(5)
    return np.arange(PIXELS)[:, None] + np.arange(DATES) / 7 + r.normal(size=(PIXELS, DATES))


@pytest.fixture(scope="module")
def series(spark, value):
    rows = [(p, 0, float(3 * t), float(value[p, t])) for p in range(PIXELS) for t in range(DATES)]

    def shaken(batches):
        r = np.random.default_rng()
        for b in batches:
            v = b.column("value").to_numpy() * (1 + 1e-14 * r.integers(-9, 10, b.num_rows))
            yield b.set_column(b.schema.get_field_index("value"), "value", pa.array(v))

    df = spark.createDataFrame(rows, "prow int, pcol int, t double, value double")
    return df.mapInArrow(shaken, df.schema)


@pytest.fixture(scope="module")
def solved(value):
    """Weights of the dates, weighted slope, intercept and deviation of the pixels."""
    t = 3.0 * np.arange(DATES)
    line = np.polynomial.polynomial.polyfit(t, value.T, 1)
    low, high = np.quantile(line[0][:, None] + line[1][:, None] * t - value, [0.02, 0.98], axis=0)
    w = 1 / (high - low)
    a = np.stack([t, np.ones(DATES)], 1) * w[:, None]
    slope, intercept = np.linalg.lstsq(a, (value * w).T)[0]
    return w, slope, intercept, np.sqrt(np.linalg.inv(a.T @ a)[0, 0]), line


def test_percentiles(series, value):
    got = {r.t: (r.p0, r.p1) for r in quality.percentiles(series, ["t"], "value", [0.0, 0.98]).collect()}
    want = np.quantile(value, [0.0, 0.98], axis=0)
    assert {3.0 * k: pytest.approx(tuple(want[:, k])) for k in range(DATES)} == got


def test_linear_velocity_and_sigma(series, solved):
    line = model.weighted_line(series, model.residual_weights(model.line_values(series)))
    got = {r.prow: (r.slope, r.intercept, r.sigma) for r in line.collect()}
    _, slope, intercept, sigma, _ = solved
    assert {p: pytest.approx((slope[p], intercept[p], sigma)) for p in range(PIXELS)} == got


def test_model_without_atmosphere(series, value, solved):
    first = dt.date(2024, 1, 1)
    day = F.date_add(F.lit(first), F.col("t").cast("int")).alias("date")
    got = {(r.prow, r.t): r.value for r in model_history(series.select("prow", "pcol", day, F.col("value").alias("defo")))["model"].collect()}
    _, slope, intercept, _, line = solved
    t = 3.0 * np.arange(DATES)
    gap = line[0][:, None] + line[1][:, None] * t - value
    atmo = -(gap[:, 1:] - gap[:, :1]).mean(1)
    want = intercept[:, None] + slope[:, None] * t - atmo[:, None]
    assert {(p, t[k]): pytest.approx(want[p, k]) for p in range(PIXELS) for k in range(DATES)} == got


def test_residual_weights(series, solved):
    got = {r.t: r.weight for r in model.residual_weights(model.line_values(series)).collect()}
    assert {3.0 * k: pytest.approx(solved[0][k]) for k in range(DATES)} == got


def test_rows_lie_in_the_shared_folder_where_there_is_one(spark, series, value, monkeypatch, tmp_path):
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda _: str(tmp_path))
    seen = []
    monkeypatch.setattr(type(series), "checkpoint", lambda df: seen.append(1) or df.localCheckpoint())
    got = {r.t: r.p0 for r in quality.percentiles(series, ["t"], "value", [0.5]).collect()}
    assert seen and {3.0 * k: pytest.approx(float(np.median(value[:, k]))) for k in range(DATES)} == got
