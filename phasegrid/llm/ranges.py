"""Ordered ranges of an integer id that hold about equal weight."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Equal-width bins of the ids from which ranges are made.
BINS = 1 << 16
#: A bin with more than one part in so many of the weight is cut again, from its least to its greatest id.
SHARE = 1024


def id_ranges(rows: DataFrame, ident: str, weight: Column, most: int) -> Callable[[DataFrame, str], DataFrame]:
    """A function that adds to a table with `ident` the number of its range; its attribute `count` tells how many there are.

    Ranges ascend with the id, null first. Each holds about `most` of the weight, more only by a bin: a SHARE-th
    of all, or rows of one id. Where ids lie close together beside strays, the bins that hold too much are cut
    again, level by level. The same rows always give the same ranges. A level's table has at most BINS + 1
    rows, which the driver sees and broadcasts.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(ident).cast("long").alias("_id"), weight.alias("_weight"))
    low, high, total = rows.agg(F.min("_id"), F.max("_id"), F.sum("_weight")).first()
    width = float(-(-((high or 0) - (low or 0) + 1) // BINS))

    def first(df: DataFrame, column: str) -> DataFrame:
        return df.withColumn("_bin", F.coalesce(F.floor((F.col(column).cast("double") - F.lit(float(low or 0))) / width), F.lit(-1)))

    def deeper(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
        met = df.join(F.broadcast(table), ["_bin"], "left").withColumn("_bin", F.when(F.col("_width").isNotNull(), F.expr(f"_from + (`{column}` - _low) div _width")).otherwise(F.col("_bin")))
        return met.drop("_low", "_width", "_from")

    at, found, levels, leaves, numbers = first(rows, "_id"), None, [], [], BINS + 1
    while True:
        found = at.groupBy("_bin").agg(F.sum("_weight").alias("w"), F.min("_id").alias("low"), F.max("_id").alias("high")).collect()  # at most BINS + 1
        heavy = [r for r in found if r.w > most and r.w * SHARE > total and r.low is not None and r.low < r.high]
        cut = {r["_bin"] for r in heavy}
        leaves += [r for r in found if r["_bin"] not in cut]
        if not heavy:
            break
        pieces, table = BINS // len(heavy), []
        for r in heavy:
            table.append((r["_bin"], r.low, -(-(r.high - r.low + 1) // pieces), numbers))
            numbers += pieces
        levels.append(spark.createDataFrame(table, "_bin long, _low long, _width long, _from long"))
        at = deeper(at.join(F.broadcast(levels[-1].select("_bin")), "_bin", "left_semi"), "_id", levels[-1])
    leaves.sort(key=lambda r: (r.low is not None, r.low or 0))
    before, bins, ranges = 0, [], []
    for r in leaves:
        bins.append(r["_bin"])
        ranges.append(before // most)
        before += r.w or 0
    names = {x: k for k, x in enumerate(sorted(set(ranges)))}  # without gaps
    table = spark.createDataFrame(pa.table({"_bin": pa.array(bins, pa.int64()), "_range": pa.array([names[x] for x in ranges], pa.int64())}))

    def ranged(df: DataFrame, into: str) -> DataFrame:
        df = first(df, ident)
        for level in levels:
            df = deeper(df, ident, level)
        return df.join(F.broadcast(table), "_bin").drop("_bin").withColumnRenamed("_range", into)

    ranged.count = max(1, len(names))
    return ranged
