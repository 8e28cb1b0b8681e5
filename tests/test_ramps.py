"""Layers with too few pixels for a ramp."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from phasegrid.operators import pixels
from phasegrid.queries import QUERIES, SQL

#: Pixels (row, column) to fit: none, one, two, four of a line (its sums leave rounding), a plane.
FITTED = {0: [], 1: [(3, 5)], 2: [(1, 2), (6, 4)], 3: [(0, 1), (1, 2), (4, 5), (6, 7)], 4: [(0, 0), (1, 2), (2, 4), (3, 6)], 5: [(1, 1), (1, 6), (5, 3)]}


def test_deramp_plane_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = []
    for layer, fitted in FITTED.items():
        for r in range(8):
            for c in range(8):
                flag = "N" if (r, c) in fitted else "R"
                rows += [(8 + c, 8 + r, 1, 100.0 + (r * 37 + c * 11 + layer * 5) % 23, 0.1, 1.0, flag, dt.datetime(1995, 1 + layer, 3))]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double, l_quantity double, l_returnflag string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = {r[:3]: r[3] for r in db.execute(SQL["deramp_plane"]).fetchall()}
    got = {(r.layer, r.prow, r.pcol): r.value for r in QUERIES["deramp_plane"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, nan_ok=True, abs=1e-5)
    assert {k[0] for k, v in got.items() if math.isnan(v)} == {1, 2, 3, 4} and {k[0] for k in got} == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("order", [1, 2])
def test_points_of_a_line_have_no_ramp(spark, order):
    rows = [(k, 3 * i + k, 7 * i + 2 * k, 0.1 * i) for k in range(40) for i in range(1, 12)]
    s = spark.createDataFrame(rows, "layer int, prow int, pcol int, value double")
    assert all(r.c0 is r.c1 is r.c2 is None for r in pixels.ramp_fit(s, "layer", "value", order).collect())
    assert pixels.deramp(s, "layer", "value", order).filter("value is null").count() == len(rows)
    assert pixels.deramp(s, "layer", "value", order, F.col("layer") > 5, "inner").select("layer").distinct().count() == 34
