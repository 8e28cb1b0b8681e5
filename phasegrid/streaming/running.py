"""Running stack means while layers arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phasegrid.operators.pixels import PIXEL, TINY


def arriving(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def running_mean(layers: DataFrame, value: str = "value") -> DataFrame:
    """Per pixel the mean of what has come so far; emit in update or complete mode."""
    x = F.when(~F.isnan(value), F.col(value))
    return layers.groupBy(*PIXEL).agg((F.coalesce(F.sum(x), F.lit(0.0)) / (F.count(x) + TINY)).alias("mean"), F.count(x).alias("n"))


def daily_rates(events: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Counts a day and type with a watermark: late rows within it are counted, older state is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def to_memory(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
