"""Schedules and searches as tables: learning rates, drop rates, trial parameters, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.functions.columns import uniform

#: Blocks per stage, widths and largest drop rate of the model sizes.
MODELS = {
    "tiny": ((3, 3, 9, 3), (96, 192, 384, 768), 0.1),
    "small": ((3, 3, 27, 3), (96, 192, 384, 768), 0.4),
    "base": ((3, 3, 27, 3), (128, 256, 512, 1024), 0.5),
    "large": ((3, 3, 27, 3), (192, 384, 768, 1536), 0.5),
}


def learning_rates(spark: SparkSession, epochs: int = 50, base: float = 0.001, every: int = 20) -> DataFrame:
    """A tenth after each ``every`` epochs: epoch, lr."""
    return spark.range(1, epochs + 1).select(F.col("id").alias("epoch"), (base * F.pow(F.lit(0.1), F.floor(F.col("id") / float(every)))).alias("lr"))


def drop_rates(spark: SparkSession) -> DataFrame:
    """Stochastic depth rises evenly over a model's blocks: model, block, stage, width, rate."""
    rows = [(name, i, stage, width, len(places) - 1, most) for name, (depths, widths, most) in MODELS.items() for places in [[(s, w) for s, (d, w) in enumerate(zip(depths, widths)) for _ in range(d)]] for i, (stage, width) in enumerate(places)]
    table = spark.createDataFrame(rows, "model string, block int, stage int, width int, last int, most double")
    return table.select("model", "block", "stage", "width", (F.col("most") * F.col("block") / F.col("last")).alias("rate"))


def search_space(spark: SparkSession, trials: int = 20, most_filters: int = 128, seed: int = 0) -> DataFrame:
    """Seeded draws of layers (1-3), filters (32 to ``most_filters``), dropout (0.1-0.5) and log-uniform learning rate (1e-5 to 1e-1)."""
    u = lambda name: uniform(F.lit(str(seed)), name, F.col("id"))
    return spark.range(trials).select(
        F.col("id").alias("trial"),
        (1 + F.floor(u("layers") * 3)).cast("int").alias("layers"),
        (32 + F.floor(u("filters") * (most_filters - 31))).cast("int").alias("filters"),
        (0.1 + 0.4 * u("dropout")).alias("dropout"),
        F.pow(F.lit(10.0), -5 + 4 * u("lr")).alias("lr"),
    )


def best_so_far(scores: DataFrame) -> DataFrame:
    """``scores`` (trial, epoch, accuracy) with ``best``, the trial's best up to the epoch."""
    return scores.withColumn("best", F.max("accuracy").over(Window.partitionBy("trial").orderBy("epoch")))


def pruned(scores: DataFrame, warm_up: int = 5) -> DataFrame:
    """``prune`` where a trial's best lies below the median of earlier trials at the epoch, once there are ``warm_up`` of them."""
    best = best_so_far(scores)
    earlier = best.select(F.col("epoch").alias("_epoch"), F.col("trial").alias("_trial"), F.col("accuracy").alias("_accuracy"))
    met = best.join(earlier, (F.col("epoch") == F.col("_epoch")) & (F.col("_trial") < F.col("trial")), "left")
    median = met.groupBy("trial", "epoch", "best").agg(F.count("_trial").alias("n"), F.expr("percentile(_accuracy, 0.5)").alias("median"))
    return median.select("trial", "epoch", "best", (F.col("n") >= warm_up).alias("judged"), F.coalesce((F.col("n") >= warm_up) & (F.col("best") < F.col("median")), F.lit(False)).alias("prune"))


def best_trial(scores: DataFrame) -> DataFrame:
    """The trial and epoch of the highest accuracy, the earlier trial and epoch on ties."""
    top = F.max_by(F.struct("trial", "epoch", "accuracy"), F.struct("accuracy", -F.col("trial"), -F.col("epoch")))
    return scores.agg(top.alias("b")).select("b.trial", "b.epoch", "b.accuracy")


def letterbox(width: Column, height: Column, size: int = 224) -> list[Column]:
    """Scaled width and height (1 at least) and where they are pasted to fit a square of ``size``."""
    scale = F.least(size / width, size / height)
    w, h = (F.greatest(F.lit(1), F.floor(x * scale)).cast("int") for x in (width, height))
    return [w.alias("new_width"), h.alias("new_height"), F.floor((size - w) / 2.0).cast("int").alias("left"), F.floor((size - h) / 2.0).cast("int").alias("top")]
