"""A training corpus from the documents table: judge, deduplicate, trim, mix, encode.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; run() writes every stage's rows to the shared folder and reads them back, so a lost
executor costs one stage's tasks at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm.bpe import bpe_round_trip
from phasegrid.llm.mixing import taken_words
from phasegrid.llm.near_copies import near_copies
from phasegrid.llm.quality import classify_quality
from phasegrid.llm.simhash import one_of_each
from phasegrid.llm.store import cut
from phasegrid.llm.substring import substring_dedup
from phasegrid.session import ship

VOCABULARY = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and wordless texts are judged like any other; without usable labels all
    stay, and of an empty table nothing comes. Rows that repeat are judged alike."""
    ship(spark)
    judged = classify_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.filter("quality_kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id. Near are pairs whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more: BK-trees over SimHash fingerprints propose them, and
    every link is checked on the sets. Null and wordless texts are one group; of rows with one doc_id (or none) and
    one text, one stays."""
    ship(spark)
    return one_of_each(docs, near_copies(docs, shingle=5))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that a smaller document holds too go; other documents keep their text as it is (null stays null).
    A null doc_id counts as the greatest; rows that share a doc_id remove nothing from each other."""
    ship(spark)
    trimmed = substring_dedup(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    out = trimmed.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each time a document is taken, whole or in part. Texts without words are never
    taken; the null source is one of its own; the same rows in any order give the same mix."""
    return taken_words(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, little-endian unsigned 32-bit integers), and the text decoded from them; null text has none and decodes to
    the empty one. Columns other than doc_id, source and lang end here."""
    ship(spark)
    out = bpe_round_trip(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", "source", "lang", (F.octet_length("ids_packed") / 4).cast("long").alias("n_tokens"), "ids_packed", F.col("decoded").alias("text"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: A fitted classifier and sampled seeds have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
