"""Streaming variants, an extension: series statistics per 30-minute window with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def window_stats(events: DataFrame, width: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Count, least, greatest and mean value per window and event type; works on streams and tables alike.

    On a stream, rows later than the watermark ``late`` are left out and state older than it goes.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    stats = timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))
    return stats.select(F.col("window.start").alias("began"), "event_type", "n", "low", "high", "mean")


def stream_to_files(spark: SparkSession, folder: str, out: str, checkpoint: str, width: str = "30 minutes") -> DataFrame:
    """Reads the Parquet files of ``folder`` as a stream until none is left, and appends to Parquet files in ``out``.

    A window is written once, when the watermark has passed it; then its state goes. Windows that
    are still open stay in the checkpoint's state for the next run.
    """
    schema = spark.read.parquet(folder).schema
    stats = window_stats(spark.readStream.schema(schema).parquet(folder), width)
    query = stats.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.parquet(out)
