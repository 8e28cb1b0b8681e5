"""Recall of the spherical caps near the threshold, vectors of any size, columns of any name."""

import numpy as np
import pytest

from phasegrid.llm.embed_dedup import code_for, embedding_dedup, list_decode


def pairs(dim, n, cosine, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((n, dim))
    y -= (y * x).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    return x, cosine * x + np.sqrt(1 - cosine**2) * y


@pytest.mark.parametrize("dim, rows", [(2, 5000), (5, 5000), (16, 100), (64, 100), (64, 8192), (64, 1 << 18), (200, 4096)])
def test_isolated_pairs_share_a_filter(dim, rows):
    """Pairs in random directions, between 0.93 and 0.95: those that no other vector helps to join."""
    code, missed, n = code_for(dim, rows, 0.93), 0, 1500
    for k, cosine in enumerate((0.9301, 0.94, 0.95)):
        x, y = pairs(dim, n, cosine, k)
        (r, f), (q, g) = list_decode(x, code), list_decode(y, code)
        width = code.codes * code.codewords**code.parts
        missed += n - len(np.unique(np.intersect1d(r * width + f, q * width + g) // width))
    print(dim, rows, "recall", 1 - missed / (3 * n))
    assert missed <= 0.003 * 3 * n


def test_isolated_pairs_are_linked(spark):
    x, y = pairs(64, 400, 0.932, 7)
    rows = [(2 * k + j, v.tolist(), k % 3) for k in range(400) for j, v in enumerate((x[k], y[k]))]
    got = {r.vec_id: r for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    linked = sum(got[2 * k + 1].component_id == 2 * k and got[2 * k].n_links == 1 for k in range(400))
    print("recall", linked / 400)
    assert linked >= 398


@pytest.mark.parametrize("scale", [1e200, 1e-200, 1e307, 1e-300])
def test_lengths_of_any_size(spark, scale):
    rows = [(k, [scale * v for v in (1.0, 0.01 * k, 0.5)], 1) for k in range(3)] + [(9, [-scale, 0.0, 0.0], 1), (10, [1.0, 0.0, 0.5], 1)]
    names = ["rep", "n", "dim", "filter", "h1", "h2", "node", "component"]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", *[f"vec_id as {c}" for c in names])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(df).collect()}
    assert got == {0: (3, 0, True), 1: (3, 0, False), 2: (3, 0, False), 9: (0, 9, True), 10: (3, 0, False)}
