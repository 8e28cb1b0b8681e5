"""Connected components of a link table, by alternating large and small stars.

Every step is a grouped minimum (combined before the shuffle) and a join back to the links, which
adaptive execution splits where one node has very many links. Nothing but two numbers a round, to
see whether anything moved, comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.store import cut_at, drop_path


def _large(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: columns a, b (long), either order, repeats and self-links allowed. Returns (node, component),
    component being the smallest node reachable; nodes without links to others are not listed."""
    spark = links.sparkSession
    now, path = cut_at(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "links")
    mark = None
    while True:
        after, new_path = cut_at(_small(_large(now)), "links")
        drop_path(spark, path)
        now, path = after, new_path
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark or not seen[0]:
            break
        mark = seen
    low = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(low)
