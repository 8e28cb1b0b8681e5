"""Columns of any name pass through; order of rows doesn't matter."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from phasegrid.llm import mixing, quality, substring

DOCS = "doc_id long, text string, source string, lang string"
OWN = {
    "substring": ["row", "_key", "_mark", "_runs", "anchor", "hash", "start", "n", "least"],
    "mixing": ["row", "_null", "_src", "_shard", "_at", "_off", "_edge", "_enter", "_q", "_rot", "_nb", "_words", "_first", "_id", "_last", "quota", "weight", "rest", "_whole"],
    "quality": ["row", "_host", "_path", "_salt", "_prior", "x", "h", "y"],
}


def table(spark, rows=None):
    if rows is None:
        rows = [(k, " ".join(f"w{k % 3}x{i}" for i in range(60)), "ab"[k % 2], "en") for k in range(8)] + [(None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def operator(spark, name):
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int")
    return {"substring": substring.substring_dedup, "mixing": mixing.mix_sources, "quality": lambda d: quality.classify_quality(d, labels)}[name]


@pytest.mark.parametrize("name", OWN)
def test_clashing_columns_pass(spark, name):
    docs = table(spark).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in OWN[name]}).withColumn("a map", F.create_map(F.lit("k"), "doc_id"))
    got, plain = operator(spark, name)(docs), operator(spark, name)(table(spark))
    assert got.columns[: len(docs.columns)] == docs.columns
    assert Counter(tuple(r[c] for c in OWN[name]) for r in got.collect()) == Counter(tuple(f"{c}{'none' if i is None else i}" for c in OWN[name]) for i in [*range(8), None])
    assert Counter(map(str, got.select(plain.columns).collect())) == Counter(map(str, plain.collect()))


def test_clashing_columns_pass_through_the_mix(spark):
    docs = table(spark).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in OWN["mixing"]})
    got = mixing.taken_words(docs)
    assert got.columns == docs.columns
    assert all(r[c] == f"{c}{r.doc_id}" for r in got.collect() for c in OWN["mixing"])


@pytest.mark.parametrize("ids", [None, 5])
def test_the_mix_of_tied_rows_does_not_depend_on_their_order(spark, ids):
    """Rows of one doc_id (or none) and one size."""
    rows = [(ids, " ".join(f"w{k}x{i}" for i in range(10)), "ab"[k % 2], "en") for k in range(40)] + [(1, "one two three", "c", "en")]
    one = Counter(map(str, mixing.taken_words(table(spark, rows).coalesce(1), shards=4).collect()))
    two = Counter(map(str, mixing.taken_words(table(spark, rows[::-1]).repartition(5), shards=4).collect()))
    assert one == two and one


def test_one_source_in_many_shards(spark):
    """The same words are taken in all, however many shards there are."""
    rows = [(k, " ".join(f"w{i}" for i in range(k % 50)), "a" if k % 3 else "b", "en") for k in range(300)]
    for shards in (1, 7, 1000):
        got = mixing.mix_sources(table(spark, rows), shards=shards).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w")).collect()
        assert len(got) == 2 and all(abs(r.t - r.w) <= 16 for r in got)
