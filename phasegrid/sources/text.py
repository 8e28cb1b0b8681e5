"""Lists and headers in text: dates, pairs, baselines, raster headers, stations, products, polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.functions.names import pair_in, product_fields, relative_orbit

#: The keys of a raster header and their kinds.
HEADER = "width int, file_length int, x_first double, y_first double, x_step double, y_step double, x_unit string, y_unit string, z_offset double, z_scale double, projection string"


def there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty trimmed lines; none if there is no such file."""
    if not there(spark, path):
        return spark.createDataFrame([], "line string")
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")


def read_dates(spark: SparkSession, path: str) -> DataFrame:
    """Dates (yyyymmdd anywhere in the line); a missing list is empty."""
    return lines(spark, path).select(F.to_date(F.regexp_extract("line", r"(\d{8})", 1), "yyyyMMdd").alias("date"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of names like yyyymmdd_yyyymmdd.int, sorted: (name, early, late)."""
    early, late = pair_in(F.col("line"))
    return lines(spark, path).select(F.col("line").alias("name"), early.alias("early"), late.alias("late")).orderBy("early", "late")


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """Columns slc1, slc2, temporal, spatial, parted by spaces; names may hold more than the date."""
    part = F.split("line", r"\s+")
    day = [F.to_date(F.regexp_extract(part[k], r"(\d{8})", 1), "yyyyMMdd") for k in (0, 1)]
    return lines(spark, path).select(day[0].alias("slc1"), day[1].alias("slc2"), part[2].cast("double").alias("temporal"), part[3].cast("double").alias("spatial"))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """One typed row of key value lines."""
    part = F.split("line", r"\s+", 2)
    kv = F.map_from_entries(F.collect_list(F.struct(F.lower(part[0]).alias("k"), part[1].alias("v"))))
    m = lines(spark, path).agg(kv.alias("m"))
    fields = [f.split(" ") for f in HEADER.split(", ")]
    return m.select(*[F.col("m")[k].cast(t).alias(k) for k, t in fields])


def header_text(values: dict) -> str:
    return "".join(f"{k.upper():<14}{values[k]}\n" for k in (f.split(" ")[0] for f in HEADER.split(", ")) if values.get(k) is not None)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """name, lat, lon, alt without a header, as (name, lon, lat)."""
    return spark.read.schema("name string, lat double, lon double, alt double").csv(path).select("name", "lon", "lat")


def station_files(spark: SparkSession, folder: str, ending: str = ".tenv3") -> DataFrame:
    """Names of the stations that have a data file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(folder).select("path")
    return files.select(F.regexp_extract("path", r"([^/.]+)\.[^/]*$", 1).alias("name")).distinct()


def raster_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Files of a folder with the pair in their names: (path, early, late)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
    early, late = pair_in(F.col("path"))
    return files.select("path", early.alias("early"), late.alias("late")).filter("early is not null").orderBy("early", "late")


def parse_products(names: DataFrame, column: str = "name", path: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Satellite products by name: mission, mode, product, resolution, date, orbit, path, and the columns to keep; one row a row of
    names, equal names included, but names of other form are left out."""
    p = names.select(*keep, column, *product_fields(F.col(column))).filter("mission <> ''")
    p = p.withColumn("date", F.to_date("day", "yyyyMMdd")).withColumn("path", relative_orbit(F.col("mission"), F.col("orbit"))).drop("day")
    return p.filter(F.col("path") == path) if path is not None else p


def read_polygon(spark: SparkSession, path: str) -> DataFrame:
    """Outer ring of GeoJSON polygons: (ring array of structs x, y)."""
    raw = spark.read.option("wholetext", True).text(path)
    shape = F.from_json("value", "type string, coordinates array<array<array<double>>>, features array<struct<geometry: struct<type: string, coordinates: array<array<array<double>>>>>>")
    c = F.coalesce(shape["coordinates"], F.element_at(shape["features"], 1)["geometry"]["coordinates"])
    return raw.select(F.transform(c[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))
