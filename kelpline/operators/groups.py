"""Aggregates of a group beside its rows, places in a series, and windows over series of any length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kelpline.sources.tables import in_order

#: Longer series are dealt over several tasks.
LONG = 1 << 20


def with_aggregates(df: DataFrame, by: str, **aggregates: Column) -> DataFrame:
    """``df`` with aggregates of its group as columns; null is a group like others.

    A window would move every row and put a group into one task. Here partial sums move, and the
    rows meet one narrow row per group: Spark broadcasts these where their size allows, and splits
    a hot group where it doesn't.
    """
    found = df.groupBy(F.col(by).alias("_by")).agg(*(c.alias(name) for name, c in aggregates.items()))
    return df.join(found, df[by].eqNullSafe(found["_by"]), "left").drop("_by")


def long_series(df: DataFrame, most: int = LONG) -> DataFrame:
    """Series of more than ``most`` rows: series_id, size, low and high time."""
    fine = F.when(~F.isnan("t"), F.col("t"))
    return df.groupBy("series_id").agg(F.count(F.lit(1)).alias("_size"), F.min(fine).alias("_low"), F.max(fine).alias("_high")).filter(F.col("_size") > most)


def apart(df: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Series of up to ``most`` rows, and the longer ones; None where a job finds none."""
    hot = df.groupBy(F.col("series_id").alias("_hot")).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > most).select("_hot")
    if hot.isEmpty():
        return df, None
    met = df["series_id"].eqNullSafe(hot["_hot"])
    return df.join(hot, met, "left_anti"), df.join(hot, met, "left_semi")


def placed(df: DataFrame, most: int | None = LONG, out: str = "n") -> DataFrame:
    """``df`` with ``out``, the place of a row in its series from 1, by time and event.

    Long series are cut into stretches of equal time, as many as hold ``most`` rows each at an even
    cadence; places are counted inside a stretch and the rows of earlier ones added. Null times come
    first and NaN last. ``most`` is None where it is known that no series is long; else a job asks.
    """
    hot = long_series(df, most) if most else None
    if hot is None or hot.isEmpty():
        return df.withColumn(out, F.row_number().over(in_order()))
    return _placed_in_stretches(df, hot, most, out)


def _placed_in_stretches(df: DataFrame, hot: DataFrame, most: int, out: str) -> DataFrame:
    hot = hot.withColumnRenamed("series_id", "_hot")
    parts = F.ceil(F.col("_size") / most)
    at = F.when(F.col("t").isNull(), F.lit(0)).when(F.isnan("t"), parts - 1).when(F.col("_high") > F.col("_low"), F.least(F.floor((F.col("t") - F.col("_low")) / (F.col("_high") - F.col("_low")) * parts), parts - 1))
    cut = df.join(hot, df["series_id"].eqNullSafe(hot["_hot"]), "left").withColumn("_part", F.coalesce(at.cast("long"), F.lit(0))).drop("_hot", "_size", "_low", "_high")
    counts = cut.groupBy("series_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("series_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("series_id").alias("_s"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("series_id", "_part").orderBy("t", "event_id"))
    counted = cut.withColumn("_inside", inside)
    joined = counted.join(counts, counted["series_id"].eqNullSafe(counts["_s"]) & (counted["_part"] == counts["_p"]))
    return joined.withColumn(out, F.col("_before") + F.col("_inside")).drop("_part", "_s", "_p", "_before", "_inside")


def over_series(df: DataFrame, reach: int, body: Callable[[DataFrame, WindowSpec], DataFrame], most: int | None = LONG) -> DataFrame:
    """``body`` of ``df`` and a window over each series in order, for frames of up to ``reach`` rows either way.

    Long series are dealt over blocks of ``most`` consecutive rows, each with the ``reach`` rows
    before and after it; ``body`` must keep all columns, and its results for those rows go. ``most`` is
    as for ``placed``.
    """
    hot = long_series(df, most) if most else None
    if hot is None or hot.isEmpty():
        return body(df, in_order())
    return own_rows(body(blocks(_placed_in_stretches(df, hot, most, "_n"), reach, most), Window.partitionBy("series_id", "_block").orderBy("_n")))


def blocks(df: DataFrame, reach: int, most: int) -> DataFrame:
    """Rows with a place ``_n``, once for each block of ``most`` places that holds them or ends within ``reach`` of them.

    ``_block`` is that block, and ``_own`` whether the row lies in it. A block after the last one may
    hold no row of its own.
    """
    if reach > most:
        raise ValueError("a block must be as long as the reach")
    holder = lambda place: F.floor(place / F.lit(float(most))).cast("long")
    at = F.col("_n") - 1
    around = F.sequence(F.greatest(holder(at - reach), F.lit(0).cast("long")), holder(at + reach))
    return df.withColumn("_block", F.explode(around)).withColumn("_own", F.col("_block") == holder(at))


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_block", "_own", "_n")
