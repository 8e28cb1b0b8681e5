"""The Pitman-Yor model against a sampler that seats one customer at a time."""

import math
import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest

from phasegrid.llm import hpyp, store
from phasegrid.llm.hpyp import Part, Settings, State


def partitions(n):
    """All set partitions of n things as lists of block sizes."""
    if not n:
        yield []
        return
    for p in partitions(n - 1):
        yield [*p, 1]
        for k in range(len(p)):
            yield [*p[:k], p[k] + 1, *p[k + 1 :]]


def test_stirling_numbers_count_weighted_partitions():
    d, table = 0.6, hpyp.stirling(0.6, 7)
    for n in range(1, 8):
        want = defaultdict(float)
        for p in partitions(n):
            want[len(p)] += math.prod(math.prod(k - d for k in range(1, size)) for size in p)
        assert np.allclose(np.exp(table[n, 1 : n + 1]), [want[t] for t in range(1, n + 1)])


class Brute:
    """Every customer is taken out and seated again, given all others; one table a dish in the parent."""

    def __init__(self, pairs, s, rng):
        self.s, self.rng, self.seats = s, rng, {k: [n] for k, n in pairs.items()}
        self.customers, self.tables, self.m = Counter(), Counter(), Counter()
        for (u, w), n in pairs.items():
            self.customers[u] += n
            self.tables[u] += 1
            self.m[w] += 1
        n1, n2 = (sum(n == k for n in pairs.values()) for k in (1, 2))
        self.d, self.d0 = hpyp._discount(n1, n2), 0.5

    def root(self, w):
        m, total = self.m[w], self.s.root_strength + sum(self.m.values())
        return (m - self.d0) / total if m else (self.s.root_strength + self.d0 * sum(x > 0 for x in self.m.values())) / total

    def sweep(self):
        for (u, w), sizes in self.seats.items():
            for _ in range(sum(sizes)):
                k = self.rng.choices(range(len(sizes)), sizes)[0]
                sizes[k] -= 1
                if not sizes[k]:
                    del sizes[k]
                    self.tables[u] -= 1
                    self.m[w] -= 1
                new = (self.s.strength + self.d * self.tables[u]) * self.root(w) if self.m[w] else 1.0
                k = self.rng.choices(range(len(sizes) + 1), [*(x - self.d for x in sizes), new])[0] if sizes else 0
                if k == len(sizes):
                    sizes.append(0)
                    self.tables[u] += 1
                    self.m[w] += 1
                sizes[k] += 1

    def chance(self, u, w):
        own = self.seats.get((u, w), [])
        return (sum(own) - self.d * len(own) + (self.s.strength + self.d * self.tables[u]) * self.root(w)) / (self.s.strength + self.customers[u])


def corpus(seed=3):
    rnd = random.Random(seed)
    follow = {w: [rnd.randrange(14) for _ in range(3)] for w in range(14)}
    texts = []
    for _ in range(60):
        w, out = rnd.randrange(14), []
        for _ in range(rnd.randrange(0, 30)):
            out.append(f"w{w}" if rnd.random() < 0.97 else f"Rare{rnd.randrange(60)}")
            w = rnd.choice(follow[w])
        texts.append(" ".join(out))
    return texts


def counted(texts, ids):
    pairs = Counter()
    for i, t in zip(ids, texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w = [*t.lower().split(), None]
            pairs.update(zip([0, *w[:-1]], w))
    return pairs


def test_tables_are_drawn_as_by_single_customers():
    s, pairs = Settings(strength=1.5, root_strength=3.0), counted(corpus(), range(60))
    brute = Brute(pairs, s, random.Random(1))
    mean = Counter()
    for k in range(330):
        brute.sweep()
        if k >= 30:
            mean.update({x: len(sizes) / 300 for x, sizes in brute.seats.items()})
    keys = list(pairs)
    words, contexts = (sorted({k[i] for k in keys}, key=str) for i in (1, 0))
    word, context = np.array([words.index(k[1]) for k in keys]), np.array([contexts.index(k[0]) for k in keys])
    c = np.array([pairs[k] for k in keys])
    t, rng, table = np.minimum(c, 1), np.random.default_rng(2), hpyp.stirling(brute.d, hpyp.EXACT)
    got = np.zeros(len(c))
    for k in range(330):
        state = State(float(t.sum()), len(words), brute.d, brute.d0)
        t = hpyp.resample(c, t, np.bincount(context, t)[context].astype(int), np.bincount(word, t)[word].astype(int), state, s, table, rng)
        assert ((t >= 1) & (t <= c)).all()
        got += (k >= 30) * t / 300
    want = np.array([mean[k] for k in keys])
    assert abs(got.sum() / want.sum() - 1) < 0.03
    assert (np.abs(got - want) < 0.2 + 0.15 * want).all()  # all dishes are drawn at once, and 300 draws are averaged


@pytest.mark.parametrize("d, rest, others, tables", [(0.5, 291, 71, 4000), (0.8, 20, 3, 900), (0.8, 3000, 60, 4000), (0.95, 5000, 800, 6000), (0.1, 900, 500, 3000), (0.6, 0, 0, 50)])
def test_dishes_of_many_customers(d, rest, others, tables):
    """The way for many customers gives about as many tables as the exact draw, which is known for 250."""
    n, c = 3000, 250
    state, s, rng = State(float(tables), 50, d, 0.4), Settings(), np.random.default_rng(1)
    one = np.ones(n, np.int64)
    exact = hpyp.resample(c * one, one, (rest + 1) * one, (others + 1) * one, state, s, hpyp.stirling(d, hpyp.EXACT), rng)
    fast = hpyp._many(np.full(n, float(c)), rest * 1.0 * one, others * 1.0 * one, s.root_strength + tables - 1, d, 0.4, s.strength, rng)
    assert abs(fast.mean() - exact.mean()) < 0.1 + 0.05 * exact.mean()
    assert exact.mean() > 0.95 * c or abs(fast.std() - exact.std()) < 0.1 + 0.15 * exact.std()  # next to c the draw isn't normal


def test_dishes_of_very_many_customers():
    """No number of tables is out of reach: the odds at the mode are even."""
    rng = np.random.default_rng(1)
    got = hpyp._many(np.array([1e5, 1e7, 1e9]), np.array([1e4, 1e6, 1e7]), np.array([1e3, 1e5, 1e6]), 1e7, 0.7, 0.5, 2.0, rng)
    assert (got >= 1).all() and got[2] > got[1] > 1000


def test_predictive_sums_to_one():
    rng = np.random.default_rng(0)
    c = rng.integers(0, 40, 300)
    context, word = np.repeat(np.arange(10), 30), np.tile(np.arange(30), 10)
    t = np.minimum(c, 1 + rng.integers(0, 3, 300))
    tables, customers = np.bincount(context, t).astype(int), np.bincount(context, c).astype(int)
    part, s = Part(word, context, c, np.zeros(30, np.int64), np.zeros(0), np.zeros(0)), Settings()
    m = np.bincount(word, t)
    state = State(float(t.sum()), int((m > 0).sum()), 0.6, 0.4)
    p = hpyp.chances(part, t, customers, tables, state, s)
    new = (s.root_strength + 0.4 * state.known) / (s.root_strength + state.tables)
    unknown = (s.strength + 0.6 * tables) * new / (s.strength + customers)
    assert np.allclose(np.bincount(context, np.where(m[word] > 0, p, 0)) + unknown, 1)


@pytest.mark.parametrize("part_bytes, slice_bytes", [(1 << 20, 1 << 20), (3000, 500)])
def test_scores_against_single_customers(spark, part_bytes, slice_bytes):
    """The query's scores, on one partition and on several with split words, against the plain sampler."""
    texts, s = corpus(), Settings(strength=1.5, root_strength=3.0, sweeps=5, averaged=3)
    got = hpyp.hpyp_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), s, part_bytes, slice_bytes).collect()
    brute, ids = Brute(counted(texts, range(60)), s, random.Random(1)), range(60)
    total, rounds = defaultdict(float), 0
    asked = {(u, w) for t in texts for u, w in zip([0, *t.lower().split()], [*t.lower().split(), None])}
    for k in range(60):
        brute.sweep()
        brute.d0 = hpyp._discount(sum(x == 1 for x in brute.m.values()), sum(x == 2 for x in brute.m.values()))
        if k >= 20:
            rounds += 1
            for u, w in asked:
                total[u, w] += brute.chance(u, w)
    assert len(got) == 60
    want = {i: sum(math.log10(total[p] / rounds) for p in zip([0, *texts[i].lower().split()], [*texts[i].lower().split(), None])) for i in ids}
    assert all(abs(r.score - want[r.doc_id]) < 0.1 + 0.06 * abs(want[r.doc_id]) for r in got)
    assert abs(sum(r.score for r in got) / sum(want.values()) - 1) < 0.02


def test_contexts_are_whole_words(spark):
    """Words that end alike are contexts of their own."""
    rows = [(k, "oneending x " * 15 if k % 2 else "twoending y " * 15) for k in range(40)]
    rows += [(900, "oneending x " * 30), (901, "oneending y " * 30)]
    got = {r.doc_id: r.score for r in hpyp.hpyp_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[900] > got[901] + 20


def test_shared_folder_is_not_guessed_on_a_cluster():
    conf = SimpleNamespace(get=lambda key, default: None)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            store.shared_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="a")))
