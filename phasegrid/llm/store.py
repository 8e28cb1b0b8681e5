"""Tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where that is unset and one process does all work (master local), a folder of
    this machine; on a cluster there is no folder to guess, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="phasegrid-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = "file://" + folder
    return _own[app]


def new_path(spark: SparkSession, what: str) -> str:
    """A place of its own in the shared folder; sweep() deletes what is there."""
    path = f"{shared_root(spark)}/phasegrid/{what}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def sweep(spark: SparkSession) -> None:
    """Deletes all tables that this module has made in the session's application. Call it when no result is read any more."""
    app = spark.sparkContext.applicationId
    for s, path in [x for x in _made if x[0].sparkContext.applicationId == app]:
        drop_path(spark, path)
        _made.remove((s, path))


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder written by this module."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Writes df to the shared folder and reads it back: later jobs start from those files.

    The files survive lost executors. The schema is handed over, so an empty table stays readable.
    """
    return cut_at(df, what)[0]


def cut_at(df: DataFrame, what: str = "cut") -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(table: DataFrame) -> None:
    """Deletes a table made by cut(), which nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        drop_path(table.sparkSession, path)


def settled(df: DataFrame, what: str = "cut") -> DataFrame:
    """cut(), after which the shuffle files that made it go: a phase's disk is its own, not the sum over all phases."""
    out = cut(df, what)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def extended(schema: StructType, ddl: str) -> StructType:
    """The schema with the fields of a DDL string behind it."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def packed(docs: DataFrame, *apart: str) -> Column:
    """All columns but those apart as one struct, named row: an operator's own columns beside it can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in apart]).alias("row")


def unpacked(names: list[str], *apart: str) -> list[Column]:
    """The columns of packed() again, in their order."""
    return [F.col(f"`{c}`") if c in apart else F.col("row").getField(c).alias(c) for c in names]


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed, to order rows that agree in what matters."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
