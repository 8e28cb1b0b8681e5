"""Posteriors of hosts and paths against a direct computation."""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from phasegrid.llm import quality

DOCS = "doc_id long, text string, source string, lang string"


def corpus(seed=2):
    """Good texts of plain words, bad ones with symbols, and some in between; sites of very different sizes."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    share = {"good": 0.97, "bad": 0.03, "mixed": 0.5, None: 0.5}
    for k in range(900):
        host = ["good", "bad", "mixed", None][int(rng.choice(4, p=[0.4, 0.4, 0.15, 0.05]))]
        path = ["x", "y", None][int(rng.integers(3))] if host == "mixed" else "x"
        kind = rng.random() < share[host]
        w = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(40)]
        if not kind:
            w = [x + "#$%"[int(rng.integers(3))] if rng.random() < 0.4 else x for x in w]
        rows.append((k, " ".join(w), host, path))
        if k % 3 == 0:
            labels.append((k, int(kind)))
    half = [" ".join(x + "#" if i in (3, 17, 29) else x for i, x in enumerate("".join(rng.choice(list("abcdefg"), 5)) for _ in range(40))) for _ in range(12)]
    rows += [(1000 + 10 * k + j, t, host, "x") for k, t in enumerate(half) for j, host in enumerate(("good", "bad"))]
    rows += [(2000, None, "rare", "x"), (2001, "", "good", "z"), (2002, rows[0][1], rows[0][2], rows[0][3]), (2002, rows[0][1], rows[0][2], rows[0][3]), (None, rows[1][1], rows[1][2], rows[1][3]), (2003, "word " * 60_000, "good", "x")]
    return rows, labels


def brute(rows, labels):
    """Probability of every row, by loops over sites."""
    x = quality.features_of(pa.array([r[1] for r in rows], pa.string()))
    truth = dict(labels)
    fit = [i for i, r in enumerate(rows) if r[0] in truth]
    y = np.array([truth[rows[i][0]] for i in fit], float)
    center, scale, w = quality.fit_logistic(x[fit], y)
    z = w[0] + ((x - center) / scale) @ w[1:]
    p = 1 / (1 + np.exp(-z))
    paths, hosts = defaultdict(list), defaultdict(list)
    for r, v in zip(rows, p):
        paths[r[2], r[3]].append(v)
        hosts[r[2]].append(v)

    def strength(groups):
        means = [np.mean(g) for g in groups.values()]
        inside = np.mean([np.mean(g) * (1 - np.mean(g)) / len(g) for g in groups.values()])
        m = np.mean(means)
        return min(1e4, max(1.0, m * (1 - m) / max(np.var(means) - inside, 1e-9) - 1))

    k_host, k_path, rate, usual = strength(hosts), strength(paths), p.mean(), math.log(y.mean() / (1 - y.mean()))
    odds = []
    for r, v in zip(rows, z):
        h = (k_host * rate + sum(hosts[r[2]])) / (k_host + len(hosts[r[2]]))
        q = (k_path * h + sum(paths[r[2], r[3]])) / (k_path + len(paths[r[2], r[3]]))
        q = min(1 - 1e-6, max(1e-6, q))
        odds.append(v + math.log(q / (1 - q)) - usual)
    return z, np.array(odds)


@pytest.mark.parametrize("few", [50_000, 0])
def test_against_direct_computation(spark, monkeypatch, few):
    """All rows' probabilities, with the sites broadcast and with a salted join; sites decide where the text doesn't."""
    monkeypatch.setattr(quality, "FEW_SITES", few)
    rows, labels = corpus()
    got = quality.classify_quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    alone, odds = brute(rows, labels)
    key = lambda i, t: (str(i), str(t)[:200])
    want = sorted((key(r[0], r[1]), r[2] or "", 1 / (1 + math.exp(-o))) for r, o in zip(rows, odds))
    have = sorted((key(r.doc_id, r.text), r.source or "", r.quality_score) for r in got)
    assert [w[:2] for w in want] == [h[:2] for h in have]
    assert np.allclose([w[2] for w in want], [h[2] for h in have], atol=1e-9)
    assert all(r.quality_kept == (r.quality_score >= 0.5) for r in got)
    flipped = {r[0] for r, a, o in zip(rows, alone, odds) if (a >= 0) != (o >= 0)}
    assert flipped, "the sites change no decision"
    score = {r.doc_id: r.quality_score for r in got}
    assert all(score[1000 + 10 * k] > score[1001 + 10 * k] for k in range(12))


def test_sparse_sites_stay_near_their_parent(spark):
    """Two hosts of junk, one with 400 documents and one with one: the sparse one's prior is nearer the global rate."""
    rng = np.random.default_rng(1)
    text = lambda bad: " ".join("".join(rng.choice(list("abcdefg"), 5)) + ("#" if bad and rng.random() < 0.5 else "") for _ in range(30))
    rows = [(k, text(False), f"good{k % 5}", "x") for k in range(600)] + [(1000 + k, text(True), "dense", "x") for k in range(400)] + [(2000, text(True), "sparse", "x")]
    labels = [(r[0], int(r[0] < 1000)) for r in rows if r[0] % 2 == 0]
    model = quality.fit_quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int"))
    prior = {r[0][1:]: r[2] for r in model.sites.collect()}
    assert prior["dense"] < prior["sparse"] < 0 < prior["good0"] or prior["dense"] < prior["sparse"] < prior["good0"]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "x"), (None, None, None, None)], DOCS)
    for labels in ([], [(1, 1)], [(7, 0), (8, 1)]):
        got = quality.classify_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert [(r.quality_score, r.quality_kept) for r in got] == [(0.5, True)] * 2
    assert quality.classify_quality(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0
