"""Evaluation aggregates over predictions (label, pred, logits)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(scored: DataFrame) -> DataFrame:
    hit = (F.col("pred") == F.col("label")).cast("long")
    return scored.agg(F.sum(hit).alias("correct"), F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def confusion(scored: DataFrame) -> DataFrame:
    return scored.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def losses(batched: DataFrame) -> DataFrame:
    """Three averages of ``loss`` over ``batch_id``: of batch means by batches, of batch means by rows, and of rows."""
    means = batched.groupBy("batch_id").agg(F.avg("loss").alias("mean"), F.sum("loss").alias("total"), F.count(F.lit(1)).alias("n"))
    return means.agg(F.avg("mean").alias("per_batch"), (F.sum("mean") / F.sum("n")).alias("per_dataset_of_batch_means"), (F.sum("total") / F.sum("n")).alias("per_sample"))
