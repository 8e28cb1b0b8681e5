"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from phasegrid.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: At this size some pixels have no value on some dates, so the closed forms of complete networks don't hold; larger tables are complete.
INCOMPLETE = {"sbas_inversion", "sbas_packed", "sbas_by_velocity", "sbas_with_coherence", "temporal_coherence", "sbas_weighted_normal", "sbas_narrow_normal", "sbas_tikhonov", "sbas_bandwidth_sweep", "cor_weighted_normal", "integrate_velocities", "cor_weighted_velocity", "l1_velocity", "l1_history", "polynomial_hat_matrix"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    return v if isinstance(v, int) else str(v)


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - INCOMPLETE))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    got = db.execute(SQL[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: tuple((str(type(x)), x) for x in r)
    want = sorted((tuple(plain(v) for v in r) for r in got.fetchall()), key=key)
    have = sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=key)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert all(x == y or isinstance(x, float) and isinstance(y, (float, int)) and abs(x - y) < 2e-4 * max(1, abs(y)) for x, y in zip(a, b)), (a, b)
