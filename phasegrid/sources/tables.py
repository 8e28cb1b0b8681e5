"""Stacks and products as tables under one root, with their run's parameters beside them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.sources.text import there


def save(df: DataFrame, root: str, name: str, exists: str = "error", by: list[str] | None = None) -> bool:
    """Writes a table (zstd); exists: error, ignore (returns False) or overwrite. With `by`, overwriting replaces only the partitions that df has."""
    path = f"{root}/{name}"
    if exists == "ignore" and there(df.sparkSession, path):
        return False
    w = df.write.mode({"error": "errorifexists", "ignore": "ignore"}.get(exists, "overwrite")).option("compression", "zstd")
    if by:
        w = w.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)
    return True


def save_csv(df: DataFrame, root: str, name: str, by: list[str]) -> None:
    """A small report (rows a station and date) as CSV with a header, sorted."""
    df.orderBy(*by).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/{name}")


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def record(spark: SparkSession, root: str, values: dict) -> None:
    """Run parameters as one JSON row."""
    spark.createDataFrame([(json.dumps(values, default=str, sort_keys=True),)], "parameters string").coalesce(1).write.mode("overwrite").text(f"{root}/parameters")


def carried_attributes(attributes: Column) -> Column:
    """Attributes that go on to a product: names that are not all upper case, without the coordinates."""
    return F.map_filter(attributes, lambda k, v: (k != F.upper(k)) & (k != "coordinates"))


def clicked_dates(rows: DataFrame) -> DataFrame:
    """Lines of an ignore list."""
    return rows.select(F.date_format("date", "yyyyMMdd").alias("value")).distinct().orderBy("value")


def geotransform_row(y_first: float, y_step: float, x_first: float, x_step: float) -> dict:
    return {"y_first": y_first, "y_step": y_step, "x_first": x_first, "x_step": x_step, "nodata": 0}


def described(df: DataFrame, unit: str, text: str = "", nodata: float = 0.0) -> DataFrame:
    """df with unit, nodata and description in its columns' metadata, keys and coordinates left out."""
    skip = {"prow", "pcol", "date", "lat", "lon", "ifg_idx"}
    return df.select(*[F.col(c).alias(c, metadata={"unit": unit, "nodata": nodata, "description": text}) if c not in skip else F.col(c) for c in df.columns])


def kml_point(name: Column, lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("<Placemark><name>"), name, F.lit("</name><Point><coordinates>"), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit("</coordinates></Point></Placemark>"))
