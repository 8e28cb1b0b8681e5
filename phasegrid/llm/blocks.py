"""Work units of bounded size for comparisons within groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired_blocks(rows: DataFrame, keys: list[str], ident: str, most: int, weight: str | None = None, heavy: int = 1) -> DataFrame:
    """Groups of rows by keys, cut into blocks of about `most` rows (and of a weight of about `heavy`), every block meeting every other.

    A unit is (keys, unit_a, unit_b); its rows come together in one partition, sorted, with side 0
    (block unit_a) or 1 (block unit_b, if another). Groups of one row are left out. A group of n rows
    makes (n / most)² / 2 units of at most about 2 * most rows: each pair meets in just one unit.
    """
    load = F.sum(weight) / heavy if weight else F.lit(0.0)
    size = rows.groupBy(*keys).agg(F.count("*").alias("_n"), load.alias("_w")).filter("_n > 1")
    dealt = rows.join(size, keys).withColumn("_blocks", F.ceil(F.greatest(F.col("_n") / most, F.least("_w", "_n"))).cast("int")).drop("_w").withColumn("_own", F.pmod(F.xxhash64(ident), "_blocks").cast("int"))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    units = met.withColumns({"unit_a": F.least("_own", "_other"), "unit_b": F.greatest("_own", "_other"), "side": F.when(F.col("_own") <= F.col("_other"), 0).otherwise(1)})
    by = [*keys, "unit_a", "unit_b"]
    return units.drop("_n", "_blocks", "_own", "_other").repartition(*by).sortWithinPartitions(*by, "side", ident)


def runs_by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches regrouped so that each holds all rows of one key; rows come sorted by key."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        return t.to_batches(max_chunksize=max(1, t.num_rows))[0]

    def key_at(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(k)[i].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        begin = np.concatenate([[0], np.flatnonzero(change) + 1])
        if held and key_at(held[0], 0) != key_at(batch, 0):
            yield whole()
            held = []
        for i, b in enumerate(begin[:-1]):
            part = batch.slice(b, begin[i + 1] - b)
            if held:
                held.append(part)
                yield whole()
                held = []
            else:
                yield part
        held.append(batch.slice(begin[-1]))
    if held:
        yield whole()
