"""The near-duplicate stage: which rows stay."""

from collections import Counter

import pytest

from phasegrid.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed, n=60):
    return " ".join(f"w{seed}x{k}" for k in range(n))


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", None) for i, t in rows], DOCS)


def test_one_row_a_component_whatever_its_ids(spark):
    """Null and reused doc_ids: texts that are not near each other all stay."""
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (None, text(3)), (5, text(4)), (5, text(5)), (6, text(6)), (7, text(6)), (None, text(6))]
    docs = make(spark, rows)
    kept = Counter((r.doc_id, r.text) for r in simhash.one_of_each(docs, simhash.simhash_dedup(docs)).collect())
    assert kept == Counter([(None, text(1)), (None, text(2)), (None, text(3)), (5, text(4)), (5, text(5)), (6, text(6))])


@pytest.mark.parametrize("nearest", [1, 2])
def test_stage_against_brute_force_jaccard(spark, monkeypatch, nearest):
    """All pairs at 0.8 or more are linked, in shards of several trees too, and no others."""
    import random

    import corpus_pipeline
    from phasegrid.llm import near_copies

    monkeypatch.setattr(near_copies, "BLOCK", 8)
    monkeypatch.setattr(near_copies, "NEAREST", nearest)
    rnd = random.Random(4)
    word = lambda: f"t{rnd.randrange(4000)}"
    line = " ".join(word() for _ in range(14))
    rows = []
    for base in range(30):
        w = [word() for _ in range(rnd.choice([12, 40, 150, 300]))]
        w[:0] = line.split() if base % 2 else []
        for _ in range(8 if base % 5 == 0 else 3):
            v = list(w)
            for _ in range(rnd.randrange(1 + len(w) // 30)):
                v[rnd.randrange(len(v))] = word()
            rows.append((len(rows), " ".join(v)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " \n", "one two", "One  TWO", "one three", rows[0][1].upper()])]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    union = simhash.Union(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                union.join(i, j)
    want = sorted({union.top(i) for i in range(len(rows))})
    got = corpus_pipeline.near_duplicates(spark, make(spark, rows), "")
    assert sorted(r.doc_id for r in got.collect()) == want


def test_columns_pass_whatever_their_names(spark):
    import corpus_pipeline

    names = ["__mark", "mark", "row", "id", "own", "order", "group", "s", "fp", "node"]
    rows = [(k, text(k // 2)) for k in range(6)]
    docs = make(spark, rows).selectExpr("*", *[f"concat('{c}', doc_id) as `{c}`" for c in names])
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(tuple(r[c] for c in ("doc_id", *names)) for r in got.collect()) == [(k, *(f"{c}{k}" for c in names)) for k in (0, 2, 4)]
    empty = corpus_pipeline.near_duplicates(spark, docs.limit(0), "")
    assert empty.columns == docs.columns and empty.count() == 0


def test_a_very_long_text_and_its_copy(spark):
    import corpus_pipeline

    long = " ".join(f"w{k % 70_000}q{k % 13}" for k in range(150_000))
    got = corpus_pipeline.near_duplicates(spark, make(spark, [(3, long), (2, long + " more"), (1, long[: len(long) // 2])]), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 2]
