"""Ranges of ids: ordered, whole, and of bounded weight, strays or not."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phasegrid.llm import ranges


def sets():
    rnd = random.Random(1)
    yield "dense", list(range(2000))
    yield "one stray", [*range(2000), 1 << 60]
    yield "strays on both sides", [-(1 << 62), *range(10**12, 10**12 + 2000), (1 << 62)]
    yield "two far clusters", [*range(1000), *range(1 << 61, (1 << 61) + 1000)]
    yield "random and nulls", [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(1500)] + [None] * 30
    yield "one id", [7] * 500
    yield "nothing", []
    yield "nulls only", [None] * 5


@pytest.mark.parametrize("name, ids", list(sets()), ids=[n for n, _ in sets()])
def test_ranges(spark, monkeypatch, name, ids):
    monkeypatch.setattr(ranges, "BINS", 1 << 8)
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    ranged = ranges.id_ranges(df, "doc_id", F.lit(1), 50)
    got = [(r.doc_id, r.part) for r in ranged(df, "part").collect()]
    assert Counter(i for i, _ in got) == Counter(ids)
    order = sorted(got, key=lambda x: (x[0] is not None, x[0] or 0))
    assert [p for _, p in order] == sorted(p for _, p in got)
    sizes, copies = Counter(p for _, p in got), max(Counter(ids).values(), default=0)
    assert max(sizes.values(), default=0) <= 50 + max(copies, len(ids) // 128)
    assert not got or set(sizes) == set(range(ranged.count))
