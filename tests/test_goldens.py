"""Known values: design matrices, inversion, ramps, tiles, names."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.functions import names
from phasegrid.functions import phase as ph
from phasegrid.operators import form, geo, invert, model, network, pixels, robust

DAYS = [dt.date(2018, 4, 20), dt.date(2018, 4, 22), dt.date(2018, 4, 28), dt.date(2018, 5, 2)]
PAIRS = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]
A = [[1, 0, 0], [0, 1, 0], [-1, 1, 0], [-1, 0, 1], [0, -1, 1]]
B = [[2, 0, 0], [2, 6, 0], [0, 6, 0], [0, 6, 4], [0, 0, 4]]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(k, DAYS[i], DAYS[j], (DAYS[j] - DAYS[i]).days) for k, (i, j) in enumerate(PAIRS)], "ifg_idx int, early date, late date, dt_days int")


@pytest.fixture(scope="module")
def stack(spark):
    phases = [2, 14, 12, 14, 2]
    return spark.createDataFrame([(k, 0, c, float(x * (c + 1))) for c in (0, 1) for k, x in enumerate(phases)], "ifg_idx int, prow int, pcol int, phase double")


def dense(df, shape, i="ifg_idx", j="k"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r[i], r[j]] = r.v
    return out


def test_design_matrices(spark, pairs):
    ends = [(DAYS[i], DAYS[j]) for i, j in PAIRS]
    assert invert.design(ends, DAYS).tolist() == A and invert.design(ends, DAYS, True).tolist() == B
    assert dense(network.incidence(pairs), (5, 3)).tolist() == A
    assert dense(network.velocity_matrix(pairs), (5, 3)).tolist() == B
    assert [r.v for r in network.velocity_matrix(pairs, True).orderBy("ifg_idx").collect()] == [2, 8, 6, 10, 4]
    assert [r.dt for r in network.date_steps(network.dates_of(pairs)).orderBy("k").collect()] == [2, 6, 4]


def test_difference_matrices(spark):
    one = dense(network.difference_matrix(spark, 4, 1), (3, 4), "i", "j")
    two = dense(network.difference_matrix(spark, 4, 2), (4, 4), "i", "j")
    assert one.tolist() == [[1, -1, 0, 0], [0, 1, -1, 0], [0, 0, 1, -1]]
    assert two.tolist() == [[1, -1, 0, 0], [-1, 2, -1, 0], [0, -1, 2, -1], [0, 0, -1, 1]]
    assert np.array_equal(invert.difference(4), one) and np.array_equal(invert.difference(4, 2), two)


@pytest.mark.parametrize("velocity", [False, True])
def test_inversion(stack, pairs, velocity):
    h = invert.invert(stack, pairs, velocity=velocity).orderBy("pcol", "date").collect()
    assert np.allclose([r.defo for r in h if r.pcol == 0], [0, 2, 14, 16]) and np.allclose([r.defo for r in h if r.pcol == 1], [0, 4, 28, 32])
    limit, invert.BROADCAST_ENTRIES = invert.BROADCAST_ENTRIES, 0
    packed = invert.invert(stack.filter("not (ifg_idx = 4 and pcol = 1)"), pairs, velocity=velocity).orderBy("pcol", "date").collect()
    invert.BROADCAST_ENTRIES = limit
    lacking = invert.invert(stack.filter("not (ifg_idx = 4 and pcol = 1)"), pairs, velocity=velocity).orderBy("pcol", "date").collect()
    assert np.allclose([r.defo for r in packed], [r.defo for r in lacking])
    coh = invert.temporal_coherence(stack, pairs, invert.invert(stack, pairs)).collect()
    assert all(abs(r.temp_coh - 1) < 1e-9 for r in coh)


def test_velocities(stack, pairs):
    p = invert.pseudo_inverse(invert.design([(DAYS[i], DAYS[j]) for i, j in PAIRS], DAYS, True))
    x = invert.invert_packed(invert.packed(stack), p).orderBy("pcol").collect()
    assert np.allclose(x[0].x, [1, 2, 0.5]) and np.allclose(x[1].x, [2, 4, 1])


def test_forms_differ_when_the_network_is_split():
    days, ends = [0, 1, 2, 3], [(0, 1), (2, 3)]
    a = np.concatenate([[0], invert.pseudo_inverse(invert.design(ends, days)) @ [1.0, 2.0]])
    b = np.concatenate([[0], np.cumsum(invert.pseudo_inverse(invert.design(ends, days, True)) @ [1.0, 2.0])])
    assert np.allclose(a, [0, 1, -1, 1]) and np.allclose(b, [0, 1, 1, 3])


def test_l1_ignores_an_outlier(spark, pairs):
    phases = [2.0, 14.0, 12.0, 14.0, 2.0]
    g = invert.design([(DAYS[i], DAYS[j]) for i, j in PAIRS], DAYS)
    bad = list(phases)
    bad[2] += 50
    x = invert.invert_l1(spark.createDataFrame([(0, 0, bad)], "prow int, pcol int, phase array<double>"), g).first().x
    assert np.allclose(x, [2, 14, 16], atol=0.05)


def test_ramps(spark):
    z = [(0, r, c, float(1 + 2 * r + c)) for r in range(4) for c in range(4)]
    s = spark.createDataFrame(z, "layer int, prow int, pcol int, value double")
    assert np.allclose(pixels.ramp_fit(s, "layer", "value").first()[1:], (1, 1, 2))
    assert np.allclose(pixels.ramp_fit(s, "layer", "value", 2).first()[1:], (1, 1, 2, 0, 0, 0), atol=1e-6)
    for order in (1, 2):
        assert all(abs(r.value) < 1e-6 for r in pixels.deramp(s, "layer", "value", order).collect())


def test_looks_keep_means_and_opening(spark):
    s = spark.createDataFrame([(0, r, c, float(r * 7 + c * c)) for r in range(6) for c in range(6)], "layer int, prow int, pcol int, value double")
    down = pixels.multilook(s, ["layer"], "value", 2, 3)
    assert abs(down.agg(F.avg("value")).first()[0] - s.agg(F.avg("value")).first()[0]) < 1e-9
    assert pixels.multilook(s, ["layer"], "value", 4, 4).count() == 1
    m = s.withColumn("masked", ((F.col("prow") < 3) & (F.col("pcol") < 3)) | ((F.col("prow") == 5) & (F.col("pcol") == 5)))
    assert {(r.prow, r.pcol) for r in pixels.binary_opening(m, ["layer"]).collect()} == {(r, c) for r in range(3) for c in range(3)}


def test_wrapping(spark):
    x = spark.createDataFrame([(v,) for v in (-4.0, np.pi, 10.0, 0.0)], "p double").select(ph.rewrap(F.col("p")), ph.wrap(F.col("p")), ph.rewrap(ph.rewrap(F.col("p")))).collect()
    assert all(-np.pi <= r[0] < np.pi and abs(r[0] - r[2]) < 1e-12 for r in x)
    assert abs(x[1][0] + np.pi) < 1e-12 and abs(x[1][1] - np.pi) < 1e-12


def test_tiles_and_names(spark):
    lengths = [1.3, 1.4, 1.5, 1.6]
    t = spark.createDataFrame([(x,) for x in lengths], "l double").select(geo.tile_count(F.col("l"), 0.5, 0.1)).collect()
    assert [r[0] for r in t] == [3, 3, 3, 4]
    d = spark.createDataFrame([(float(x),) for x in np.linspace(1, 2, 11)], "l double").select(geo.tile_size(F.col("l"), 0.5, 0.1)).collect()
    assert np.allclose([r[0] for r in d], [0.55, 0.6, 0.46666667, 0.5, 0.53333333, 0.56666667, 0.475, 0.5, 0.525, 0.55, 0.48])
    n = spark.createDataFrame([("./N30.8W103.7",)], "n string").select(*names.tile_place(F.col("n"))).first()
    assert tuple(n) == (-103.7, 30.8)
    with pytest.raises(Exception, match="no date"):
        spark.createDataFrame([("none.geo",)], "n string").select(names.date_in(F.col("n"))).collect()


def test_missing_pair_is_an_error(spark, pairs):
    wanted = spark.createDataFrame([(DAYS[0], DAYS[3])], "early date, late date")
    with pytest.raises(Exception, match="no such pair"):
        network.pair_index(pairs, wanted).collect()


def test_closure_of_consistent_phases_is_zero(spark):
    from phasegrid.operators import quality

    h = [0.0, 1.5, -2.0, 7.0]
    net = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    p = spark.createDataFrame([(k, i, j) for k, (i, j) in enumerate(net)], "ifg_idx int, early int, late int")
    s = spark.createDataFrame([(k, 0, 0, h[j] - h[i]) for k, (i, j) in enumerate(net)], "ifg_idx int, prow int, pcol int, phase double")
    c = quality.closure(s, network.closure_triplets(p)).collect()
    assert len(c) == 4 and all(abs(r.closure) < 1e-12 for r in c)
    assert quality.closure(s.limit(0), network.closure_triplets(p.limit(0))).count() == 0


def test_robust_line(spark):
    rows = [("a", float(x), 2.0 * x + 1 + (40 if x == 7 else 0)) for x in range(20)]
    r = robust.theil_sen(spark.createDataFrame(rows, "key string, x double, y double"), "key").first()
    assert abs(r.slope - 2) < 1e-9 and abs(r.intercept - 1) < 1e-9
    m = robust.midas(spark.createDataFrame(rows, "key string, x double, y double"), "key", 5.0, 0.1).first()
    assert abs(m.slope - 2) < 1e-9


def test_lowess_keeps_lines(spark):
    t = np.arange(0, 300, 12.0)
    s = spark.createDataFrame([(0, 0, float(x), 0.5 * float(x) + 3 + (100 if i == 9 else 0)) for i, x in enumerate(t)], "prow int, pcol int, t double, value double")
    out = model.lowess(s, 100.0).orderBy("t").collect()
    assert np.allclose([r.smooth for r in out if r.t != 108.0], [0.5 * x for x in t if x != 108.0], atol=0.5)
    assert abs(out[0].atmo - 3) < 0.5


def test_coherence_of_equal_images_is_one(spark):
    rng = np.random.default_rng(0)
    im = [(d, r, c, float(a), float(b)) for r in range(4) for c in range(4) for a, b in [rng.standard_normal(2)] for d in (0, 1)]
    images = spark.createDataFrame(im, "date int, prow int, pcol int, re double, im double")
    met = form.pair_images(spark.createDataFrame([(0, 0, 1)], "ifg_idx int, early int, late int"), images)
    assert all(abs(r.cor - 1) < 1e-5 for r in form.coherence(form.interferogram(met, 2, 2)).collect())
    assert all(abs(r.cor - 1) < 1e-5 for r in form.window_coherence(met, 3).collect())
    with pytest.raises(ValueError):
        form.triangle(4)


@pytest.mark.parametrize("scale", [1e-6, 1e-3, 1.0, 50.0, 1e5])
def test_l1_is_optimal_in_any_unit(scale):
    """At the default settings the objective equals the least over all vertices (points through as many equations as unknowns)."""
    import itertools

    rng = np.random.default_rng(4)
    ends = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    g = np.array([[(b == k) * 1.0 - (a == k) * 1.0 for k in range(1, 5)] for a, b in ends])
    truth = rng.standard_normal((20, 4)) * 3
    phase = truth @ g.T + 0.1 * rng.standard_normal((20, 10))
    phase[:, 2] += 9 * rng.standard_normal(20)
    phase[0] = truth[0] @ g.T  # no residual at all
    phase[1] = 0
    x = invert.l1_solve(g, phase * scale)
    corners = [c for c in itertools.combinations(range(10), 4) if abs(np.linalg.det(g[list(c)])) > 0.5]
    for p, got in zip(phase * scale, x):
        least = min(np.abs(g @ np.linalg.solve(g[list(c)], p[list(c)]) - p).sum() for c in corners)
        assert np.abs(g @ got - p).sum() <= least * (1 + 2e-6) + 1e-9 * scale


def test_malformed_networks_are_errors(spark):
    stack = spark.createDataFrame([(0, 0, 0, 1.0)], "ifg_idx int, prow int, pcol int, phase double")
    schema = "ifg_idx int, early date, late date, dt_days int"
    d = [dt.date(2020, 1, k) for k in (1, 2, 3)]
    for rows in ([(0, d[1], d[0], -1)], [(0, d[0], d[0], 0)], [(0, d[0], d[1], 1), (0, d[1], d[2], 1)]):
        with pytest.raises(ValueError):
            invert.invert(stack, spark.createDataFrame(rows, schema))


@pytest.mark.parametrize("velocity, weighted", [(False, False), (True, False), (False, True)])
def test_ragged_stacks_against_single_solves(spark, velocity, weighted):
    """Pixels that lack pairs: each is solved alone, absent phases being 0."""
    rng = np.random.default_rng(7)
    d = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in (0, 12, 18, 40, 52)]
    ends = [(a, b) for i, a in enumerate(d) for b in d[i + 1 :]]
    pairs = spark.createDataFrame([(10 * k, a, b, (b - a).days) for k, (a, b) in enumerate(ends)], "ifg_idx int, early date, late date, dt_days int")
    phase = {(10 * k, r, c): float(rng.standard_normal()) for k in range(10) for r in range(3) for c in range(3) if rng.random() < 0.7}
    stack = spark.createDataFrame([(*k, v) for k, v in phase.items()] + [(0, 9, 9, None), (777, 0, 0, 5.0)], "ifg_idx int, prow int, pcol int, phase double")
    got = {(r.prow, r.pcol, r.date): r.defo for r in invert.invert(stack, pairs, 2.0, velocity, weighted).collect()}
    days = np.array([(x - d[0]).days for x in d], float)
    if velocity:
        g = np.array([[max(0.0, min(days[k + 1], (b - d[0]).days) - max(days[k], (a - d[0]).days)) for k in range(4)] for a, b in ends])
    else:
        g = np.array([[(b == x) * 1.0 - (a == x) * 1.0 for x in d[1:]] for a, b in ends])
    w = 1 / np.sqrt([(b - a).days for a, b in ends]) if weighted else np.ones(10)
    for r, c in {k[1:] for k in phase} | {(9, 9)}:
        p = np.array([phase.get((10 * k, r, c), 0.0) for k in range(10)])
        x = np.linalg.lstsq(g * w[:, None], p * w, rcond=None)[0]
        history = np.concatenate([[0.0], np.cumsum(x * np.diff(days)) if velocity else x])
        assert np.allclose([got[r, c, x] for x in d], 2 * history, atol=1e-9)


def test_percentiles_against_numpy(spark, monkeypatch):
    """Ties, one value, nulls, infinite spread between bins; with and without groups."""
    from phasegrid.operators import quality

    monkeypatch.setattr(quality, "BINS", 8)
    rng = np.random.default_rng(3)
    groups = {0: rng.standard_normal(500), 1: np.repeat([1.0, 2.0, 5.0], [40, 1, 9]), 2: np.array([3.5]), 3: np.array([1e9, 0, 1e-9, 2e-9, 3e-9]), 4: np.array([])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [(0, None), (1, float("nan")), (4, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    shares = [0.0, 0.02, 0.5, 0.98, 1.0]
    got = {r.k: [r[f"p{j}"] for j in range(5)] for r in quality.percentiles(df, ["k"], "v", shares).collect()}
    for k, x in groups.items():
        want = [float(np.quantile(x, p)) for p in shares] if len(x) else [None] * 5
        assert got[k] == want if not len(x) else np.allclose(got[k], want, rtol=1e-12, atol=1e-18)
    every = np.concatenate(list(groups.values()))
    assert np.allclose(quality.percentiles(df, [], "v", [0.6]).first().p0, np.quantile(every, 0.6))
    assert quality.percentiles(df.limit(0), [], "v", [0.6]).first().p0 is None
