"""Splits, shuffles and batches that are exact, seeded and need no single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.columns import draw

#: Leading hexadecimal digits that rows are bucketed by: 65,536 buckets.
DIGITS = 4


def hashed(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def ranked(df: DataFrame, key: str, seed: int = 0, out: str = "place") -> DataFrame:
    """``df`` with ``out``, the rank from 1 by MD5 of key and seed, ties by key.

    Rows are ranked inside buckets of equal leading digits; how many come before a bucket is a
    running sum over at most 65,536 counts, which are broadcast. Rows with equal keys get places
    next to each other.
    """
    h = df.withColumn("_h", hashed(key, seed)).withColumn("_bucket", F.substring("_h", 1, DIGITS))
    counts = h.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", key))
    return h.withColumn("_inside", inside).join(F.broadcast(offsets), "_bucket").withColumn(out, F.col("_before") + F.col("_inside")).drop("_h", "_bucket", "_inside", "_before")


def split_exact(df: DataFrame, key: str, n_train: Column, seed: int = 0) -> DataFrame:
    """``split``: train for the first ``n_train`` rows by hash, an expression of the row count ``n``."""
    n = df.agg(F.count(F.lit(1)).alias("n")).select(n_train.cast("long").alias("_train"))
    return ranked(df, key, seed).crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col("place") <= F.col("_train"), "train").otherwise("test")).drop("_train", "place")


def split_hash(df: DataFrame, key: str, percent: int = 80) -> DataFrame:
    """``split`` by the key's hash alone: row by row, about ``percent`` in train."""
    return df.withColumn("split", F.when(F.pmod(draw(F.col(key)), F.lit(100)) < percent, "train").otherwise("test"))


def batches(df: DataFrame, key: str, size: int, seed: int = 0, parts: int = 0) -> DataFrame:
    """``batch_id`` in shuffled order; the last batch keeps what is left. With ``parts`` its rows are dealt in turn to as many: ``part``."""
    found = ranked(df, key, seed).withColumn("batch_id", F.floor((F.col("place") - 1) / float(size)).cast("long"))
    return (found.withColumn("part", F.pmod(F.col("place") - 1 - F.col("batch_id") * size, F.lit(parts))) if parts else found).drop("place")
