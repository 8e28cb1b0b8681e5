"""The reference pixel: what goes before what, and errors."""

import pytest

from phasegrid.plans.workflow import Reference, find_reference, redo_reference, reference_by_elevation


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([(r, c, 10.0 - r + 0.1 * c, 20.0 + c) for r in range(4) for c in range(3)], "prow int, pcol int, lat double, lon double")


@pytest.fixture(scope="module")
def stations(spark):
    return spark.createDataFrame([("AB01", 8.05, 21.1), ("ZZ99", 10.0, 20.0)], "name string, lat double, lon double")


def test_precedence(grid, stations):
    assert find_reference(grid, "AB01", 10.0, 20.0, 3, 2, stations) == Reference(2, 1, 8.05, 21.1, "AB01")
    assert find_reference(grid, None, 9.05, 21.9, 3, 0) == Reference(1, 2, 9.05, 21.9)
    assert find_reference(grid, row=0, col=0) == Reference(0, 0, 10.0, 20.0)
    assert find_reference(grid, lat=9.0, row=3, col=2) == Reference(3, 2, 7.2, 22.0)


def test_what_cannot_be_resolved(grid, stations):
    for wrong in ({}, {"lat": 1.0}, {"row": 1}, {"row": 9, "col": 9}, {"station": "NONE", "stations": stations}, {"station": "AB01"}, {"station": "NONE", "stations": stations, "row": 1, "col": 1}):
        with pytest.raises(ValueError):
            find_reference(grid, **wrong)
    with pytest.raises(ValueError):
        find_reference(grid.limit(0), lat=1.0, lon=1.0)


def test_drivers(spark):
    stack = spark.createDataFrame([(k, r, c, 2.0 * k + r + 3.0 * c) for k in range(2) for r in range(4) for c in range(4)], "ifg_idx int, prow int, pcol int, phase double")
    out, told = redo_reference(stack, Reference(1, 2, 0.0, 0.0, "AB01"), window=1)
    assert {(r.prow, r.pcol): r.phase for r in out.collect() if r.ifg_idx == 1} == {(r, c): r - 1.0 + 3.0 * (c - 2) for r in range(4) for c in range(4)}
    assert told["reference"] == [1, 2] and told["reference_station"] == "AB01"
    flat, _ = redo_reference(stack, Reference(1, 2, 0.0, 0.0), order=1, window=1)
    assert all(abs(r.phase) < 1e-9 for r in flat.collect())
    dem = spark.createDataFrame([(r, c, 10.0 * r + 30.0 * c) for r in range(4) for c in range(4)], "prow int, pcol int, elev double")
    level, told = reference_by_elevation(stack, dem)
    assert all(abs(r.phase) < 1e-9 for r in level.collect()) and told["reference"] == [-1, -1]
