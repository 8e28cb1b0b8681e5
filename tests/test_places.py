"""Nearest pixels: however far, whichever way they are searched."""

import datetime as dt

import numpy as np
import pytest

from phasegrid.operators import geo


@pytest.mark.parametrize("block", [256, 65_536])
def test_nearest_is_that_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(geo, "BLOCK", block)
    monkeypatch.setattr(geo, "DRAWN", 16)
    monkeypatch.setattr(geo, "CHUNK", 40)
    r = np.random.default_rng(3)
    # a lattice with ties, many pixels at one place, and points on it, beside it and far away
    grid = [(int(k), int(c), float(y) / 8, float(x) / 8) for k, (c, y, x) in enumerate(zip(r.integers(0, 3, 1500), r.integers(0, 40, 1500), r.integers(0, 40, 1500)))]
    grid += [(k, 7, 2.0, 2.0) for k in range(900, 2000)]
    points = [(k, float(y) / 16, float(x) / 16) for k, (y, x) in enumerate(r.integers(-20, 110, (300, 2)))] + [(900, 500.0, -9000.0), (901, -1e6, 3.0)]
    got = geo.nearest(spark.createDataFrame([*points, (902, None, 1.0)], "name long, lat double, lon double"), spark.createDataFrame(grid, "prow long, pcol long, lat double, lon double"))
    want = {n: min(((y - a) * (y - a) + (x - b) * (x - b), p, c) for p, c, a, b in grid) for n, y, x in points}
    assert {r.name: (r.prow, r.pcol, pytest.approx(r.distance)) for r in got.collect()} == {n: (p, c, d**0.5) for n, (d, p, c) in want.items()}


def test_no_pixels_no_rows(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "name long, lat double, lon double")
    assert geo.nearest(points, spark.createDataFrame([], "prow long, pcol long, lat double, lon double")).collect() == []


def test_orders_that_share_a_name_stay_single(spark, tmp_path):
    from phasegrid.queries import QUERIES

    # keys 60,000 apart have one satellite and orbit; 301 is on another path
    day, other = dt.datetime(1996, 1, 2), dt.datetime(1996, 1, 3)
    keys = [(300, day), (60_300, day), (120_300, day), (180_300, other), (79, day), (60_079, day), (650, day), (301, day)]
    spark.createDataFrame(keys, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    want = sorted((k, "S1B" if k % 2 else "S1A", "IW", "SLC", d.date(), 78) for k, d in keys[:-1])
    assert sorted(tuple(r) for r in QUERIES["products_of_path"](spark, str(tmp_path)).collect()) == want
