"""Sinks: matrices and scalograms by label, metric reports."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_label(df: DataFrame, path: str, labels: int = 0) -> None:
    """Parquet below one directory per label, so that a reader of one class prunes the others.

    Where the number of ``labels`` is known to be small, a task keeps a file open for each, with small
    row groups, and rows aren't sorted (and spilled) by label first.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(name)
    conf.set(name, str(labels))
    try:
        out = df.write.mode("overwrite").partitionBy("label")
        (out.option("parquet.block.size", 16 << 20) if labels else out).parquet(path)
    finally:
        conf.set(name, before)


def image_name(label: Column, file: Column) -> Column:
    return F.concat(label.cast("string"), F.lit("/"), file, F.lit(".jpg"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share; below a temporary one in a local session without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="kelpline-")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


#: What a session has made already, by application, directory and name: its folder.
RECORDS: dict[tuple[str, str, str], str] = {}


def recorded(spark: SparkSession, source: str, name: str, make: Callable[[str], None]) -> str:
    """The folder that ``make`` fills from the tables in ``source``, once for a session."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in RECORDS:
        folder = scratch(spark, name)
        make(folder)
        RECORDS[key] = folder
    return RECORDS[key]


def write_curves(df: DataFrame, path: str) -> None:
    """``df`` (class, series_id, t, value) as CSV with a header, a directory for each class, many series to a file: t, value, series.

    Rows without class go to the directory that Spark has for null.
    """
    df.select("class", "t", "value", F.col("series_id").alias("series")).write.partitionBy("class").option("header", True).csv(path)
