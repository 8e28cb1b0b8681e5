"""Sessions, and the package on their executors."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(name: str = "phasegrid", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; what the cluster configures stays as it is."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Hands this package's modules to the executors' Python, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    folder = tempfile.mkdtemp(prefix="phasegrid-")  # the driver's file server reads it as long as the application lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "phasegrid.zip")
    with open(path, "wb") as f:
        f.write(raw.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def made_once(df: DataFrame) -> DataFrame:
    """The rows as they come out now, for plans that read them several times and need the same bits. They lie in spark.checkpoint.dir,
    which all executors share (spark.cleaner.referenceTracking.cleanCheckpoints deletes them with the DataFrame); where it is unset
    there is one copy on the executors, and to lose one of these is an error."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()
