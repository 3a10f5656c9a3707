"""Shared pieces: the whitespace rule, stage tables in the shared folder, Arrow row helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset, a local session (one in a
    test) gets a temporary folder; any other raises RuntimeError, as its executors wouldn't share it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="kelpline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the shared one; it is removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage, so that a later step never recomputes it, also after an executor is lost.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(rows: DataFrame, by: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with ``name``, their rank from 0 in the order of ``by``, which no two rows share.

    Rows are sorted by ranges over the cluster; what the ranges before hold is added to the place in
    a range. Only one count for each partition meets in one task.
    """
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    ordered = stage_table(ordered, "ordered").withColumn("_range", F.shiftright("_id", 33))
    counts = ordered.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(F.broadcast(counts), "_range").withColumn(name, place).drop("_id", "_range", "_before")


def with_rows(docs: DataFrame, name: str = "__row") -> DataFrame:
    """``docs`` written out with a long of its own for each row, by which rows with equal or null keys are told apart."""
    return stage_table(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """While it lasts, tables that are written send Python at most ``most`` rows at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank texts have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t-\\r]+"))


def n_words_of(text: Column) -> Column:
    """How many words ``words_of`` gives, as a long."""
    return F.size(words_of(text)).cast("long")


class Recent(dict):
    """Results of ``make`` by key, in two generations of at most ``most`` keys each.

    A full generation becomes the older one and the one before it goes, so memory is bounded and
    what is used often stays. Keys longer than ``longest`` aren't kept.
    """

    def __init__(self, make, most: int, longest: int) -> None:
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found
