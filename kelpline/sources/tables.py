"""Scans: light curves, wide feature tables and image folders as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Class directories and their labels.
CLASSES = {"T2CEP": 0, "RR": 1, "HYB": 2, "GDOR": 3, "EB": 4, "DSCT": 5}
CURVE = T.StructType([T.StructField("t", T.DoubleType()), T.StructField("value", T.DoubleType())])
CURVES = T.StructType([*CURVE.fields, T.StructField("series", T.LongType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as series: series_id, event_id, event_type, t (days since the series began), value."""
    events = table(spark, sf_dir, "events")
    began = events.groupBy(F.col("user_id").alias("_user")).agg(F.min("ts").alias("_began"))
    days = F.timestamp_diff("MICROSECOND", F.col("_began"), F.col("ts")) / F.lit(8.64e10)
    # A left join, so that Catalyst drops it where no time is asked for.
    return events.join(began, events["user_id"].eqNullSafe(began["_user"]), "left").select(F.col("user_id").alias("series_id"), "event_id", "event_type", days.alias("t"), "value")


def in_order() -> Window:
    """The rows of a series in order of time, ties by event."""
    return Window.partitionBy("series_id").orderBy("t", "event_id")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a wide feature table: id, label, features (array<double>)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))


def curve_files(spark: SparkSession, root: str, files: str = "*/*.csv") -> DataFrame:
    """CSV curves of all class directories in one scan: label, series_id (path below the root), t, value.

    ``files`` is the pattern below ``root``; its first directory is the class, alone or as
    ``name=class``. Columns go by position and the header line is skipped; a directory that isn't a
    class gets a null label. Rows have no order but their time.
    """
    rows = spark.read.schema(CURVE).option("header", True).option("enforceSchema", True).csv(f"{root}/{files}").select("*", F.col("_metadata.file_path").alias("path"))
    held = F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair))
    below = F.regexp_extract("path", "([^/]+" + "/[^/]+" * files.count("/") + ")$", 1)
    folder = F.regexp_replace(F.substring_index(below, "/", 1), "^[^=]*=", "")
    return rows.select(F.try_element_at(held, folder).alias("label"), below.alias("series_id"), "t", "value")


def curve_tables(spark: SparkSession, root: str) -> DataFrame:
    """CSV files of many curves each, as ``write_curves`` writes them: label, series_id, t, value. A null series or class is null again."""
    rows = spark.read.schema(CURVES).option("header", True).option("enforceSchema", True).csv(f"{root}/*/*.csv").select("*", F.col("_metadata.file_path").alias("path"))
    held = F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair))
    folder = F.regexp_extract("path", "([^/=]+)/[^/]+$", 1)
    return rows.select(F.try_element_at(held, folder).alias("label"), F.col("series").alias("series_id"), "t", "value")


def wide_csv(spark: SparkSession, path: str, width: int) -> DataFrame:
    """A CSV of a label and ``width`` features by position: label, features (array<double>)."""
    schema = T.StructType([T.StructField("label", T.IntegerType()), *(T.StructField(f"f{i}", T.DoubleType()) for i in range(width))])
    return spark.read.schema(schema).option("header", True).csv(path).select("label", F.array(*(f"f{i}" for i in range(width))).alias("features"))


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of an image folder with the label of their directory: class (its name), label (its place by name), path, content.

    Only directory names are gathered for the labels, one short row for each class.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    named = files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("class"), "path", "content")
    classes = named.select("class").distinct()
    labels = classes.withColumn("label", F.row_number().over(Window.orderBy("class")) - 1)
    return named.join(labels, "class")


def positional(df: DataFrame, *places: int) -> DataFrame:
    """Columns by position."""
    return df.select(*(df.columns[i] for i in places))
