"""Scaling of series and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.columns import let
from kelpline.operators.groups import with_aggregates


def minmax(df: DataFrame, by: str = "series_id", value: str = "value", out: str = "scaled") -> DataFrame:
    """(x - min) / (max - min) per series; null for a constant series and for null and NaN values.

    NaN values take no part in the extremes.
    """
    fine = F.when(~F.isnan(value), F.col(value))
    known = with_aggregates(df, by, _low=F.min(fine), _high=F.max(fine))
    return known.withColumn(out, F.try_divide(fine - F.col("_low"), F.col("_high") - F.col("_low"))).drop("_low", "_high")


def ratio(df: DataFrame, t: str = "t", value: str = "scaled", out: str = "ratio") -> DataFrame:
    """t / value, null where the value is 0."""
    return df.withColumn(out, F.try_divide(F.col(t), F.col(value)))


def column_stats(df: DataFrame, features: str = "features") -> DataFrame:
    """Mean and population deviation of each feature: place, mean, std."""
    return df.select(F.posexplode(features).alias("place", "x")).groupBy("place").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def zscore(df: DataFrame, fit: DataFrame | None = None, features: str = "features") -> DataFrame:
    """Features less their mean by their population deviation; one of 0 counts as 1.

    Fitted on ``fit`` (all of ``df`` if None). The statistics, one row per feature, travel as a
    single row of two arrays.
    """
    stats = column_stats(df if fit is None else fit, features).agg(F.array_sort(F.collect_list(F.struct("place", "mean", "std"))).alias("stats"))
    scaled = F.zip_with(features, "stats", lambda x, s: F.try_divide(x - s["mean"], F.when(s["std"] == 0, F.lit(1.0)).otherwise(s["std"])))
    return df.crossJoin(F.broadcast(stats)).withColumn(features, scaled).drop("stats")


def standardise_pixels(values: Column, channel: Column, mean: list[float], std: list[float]) -> Column:
    """Bytes by 255, then by the mean and deviation of their channel."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), channel + 1)
    return (values / 255.0 - pick(mean)) / pick(std)


def layer_norm(features: Column, eps: float = 1e-6) -> Column:
    """An array less its mean by the root of its population variance and eps."""
    n = F.size(features)

    def by_spread(mean: Column) -> Column:
        spread = F.aggregate(features, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
        return let(F.sqrt(spread + eps), lambda by: F.transform(features, lambda x: (x - mean) / by))

    return let(F.aggregate(features, F.lit(0.0), lambda s, x: s + x) / n, by_spread)
