"""Search of settings by tree-structured Parzen estimators, over trials whose metrics are recorded.

Settings are rows (trial, name, value) on the scale they are searched on: whole numbers as they are,
the learning rate by its logarithm. Good trials are the first tenth; for each setting the good and the
other trials each give a mixture of normal densities cut off at the ends of its range, one at each
value and a wide one in the middle. Of some candidates drawn from the good mixture the one with the
largest ratio of good to other density is proposed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.functions.columns import erf, erf_inverse, uniform
from kelpline.operators import training
from kelpline.operators.network import Net
from kelpline.plans import schedules

CANDIDATES = 24


def ranges(spark: SparkSession, filters: tuple[int, int]) -> DataFrame:
    """name, low, high and whole: the ends of each setting's range; whole numbers reach half a step beyond."""
    rows = [("layers", 0.5, 3.5, True), ("filters", filters[0] - 0.5, filters[1] + 0.5, True), ("dropout", 0.1, 0.5, False), ("rate", math.log(1e-5), math.log(1e-1), False)]
    return spark.createDataFrame(rows, "name string, low double, high double, whole boolean")


def first_trials(spark: SparkSession, space: DataFrame, trials: list[int], seed: int) -> DataFrame:
    """trial, name, value by even draws."""
    ids = spark.createDataFrame([(t,) for t in trials], "trial int")
    drawn = F.col("low") + uniform(F.lit(str(seed)), F.col("name"), F.col("trial")) * (F.col("high") - F.col("low"))
    return ids.crossJoin(F.broadcast(space)).select("trial", "name", settled(drawn).alias("value"))


def settled(value: Column) -> Column:
    """A value of its range, whole where it must be."""
    whole = F.least(F.greatest(F.floor(value + 0.5).cast("double"), F.ceil("low").cast("double")), F.floor("high").cast("double"))
    return F.when(F.col("whole"), whole).otherwise(value)


def judged(metrics: DataFrame, epochs: int) -> DataFrame:
    """trial, epochs and accuracy at the last one recorded, and ``good``: whether it is in the first tenth, rounded up.

    Trials that ran to the end come first, then those that were stopped, by how far they came; ties by
    accuracy and trial.
    """
    last = metrics.groupBy("trial").agg(F.max(F.struct("epoch", "accuracy")).alias("last")).select("trial", F.col("last.epoch").alias("epochs"), F.col("last.accuracy").alias("accuracy"))
    # As many rows as there are trials.
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("epochs"), F.desc("accuracy"), "trial"))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return last.select("trial", "epochs", "accuracy", (F.col("epochs") < epochs).alias("stopped"), (place <= F.least(F.ceil(n / 10.0), F.lit(25))).alias("good"))


def kernels(settings: DataFrame, judged: DataFrame, space: DataFrame) -> DataFrame:
    """The mixtures: name, good, place (from 0), middle, spread, n (normal densities of the mixture), below and above (its shares under either end)."""
    seen = settings.join(judged.select("trial", "good"), "trial").select("name", "good", F.col("value").alias("middle"), "trial", F.lit(False).alias("wide"))
    both = F.explode(F.array(F.lit(True), F.lit(False)))
    wide = space.select("name", both.alias("good"), ((F.col("low") + F.col("high")) / 2).alias("middle"), F.lit(-1).alias("trial"), F.lit(True).alias("wide"))
    rows = seen.unionByName(wide).join(F.broadcast(space.select("name", "low", "high")), "name")
    order = Window.partitionBy("name", "good").orderBy("middle", "trial")
    n = F.count(F.lit(1)).over(Window.partitionBy("name", "good"))
    gap = F.greatest(F.col("middle") - F.coalesce(F.lag("middle").over(order), F.col("low")), F.coalesce(F.lead("middle").over(order), F.col("high")) - F.col("middle"))
    length = F.col("high") - F.col("low")
    spread = F.when(F.col("wide"), length).otherwise(F.least(length, F.greatest(gap, length / F.least(F.lit(100.0), 1.0 + F.col("n")))))
    made = rows.withColumn("n", n).withColumn("place", F.row_number().over(order) - 1).withColumn("gap", gap).withColumn("spread", spread)
    share = lambda edge: 0.5 * (1 + erf((F.col(edge) - F.col("middle")) / (F.col("spread") * math.sqrt(2))))
    return made.select("name", "good", "place", "middle", "spread", "n", share("low").alias("below"), share("high").alias("above"))


def proposed(settings: DataFrame, judged: DataFrame, space: DataFrame, trials: list[int], seed: int) -> DataFrame:
    """trial, name, value for each of ``trials``, from what all earlier ones gave."""
    spark = settings.sparkSession
    held = kernels(settings, judged, space).cache()
    ids = spark.createDataFrame([(t, i) for t in trials for i in range(CANDIDATES)], "trial int, i int")
    u = lambda what: uniform(F.lit(str(seed)), what, F.col("name"), F.col("trial"), F.col("i"))
    sizes = space.join(held.filter("good AND place = 0").select("name", "n"), "name")
    drawn = ids.crossJoin(F.broadcast(sizes)).withColumn("place", F.floor(u("which") * F.col("n")).cast("int"))
    met = drawn.drop("n").join(held.filter("good"), ["name", "place"])
    at = F.col("below") + u("where") * (F.col("above") - F.col("below"))
    value = F.least(F.greatest(F.col("middle") + F.col("spread") * math.sqrt(2) * erf_inverse(2 * at - 1), F.col("low")), F.col("high"))
    candidates = met.select("trial", "name", "i", settled(value).alias("x"))
    z = (F.col("x") - F.col("middle")) / F.col("spread")
    density = F.exp(-0.5 * z * z) / (F.col("spread") * F.col("n") * (F.col("above") - F.col("below")))
    sums = candidates.join(held, "name").groupBy("trial", "name", "i", "x").agg(F.sum(F.when(F.col("good"), density)).alias("l"), F.sum(F.when(~F.col("good"), density)).alias("g"))
    # Rounded, so that the order of a sum doesn't decide between equal candidates.
    return sums.groupBy("trial", "name").agg(F.max_by("x", F.struct(F.round(F.log("l") - F.log("g"), 9), -F.col("i"))).alias("value"))


def to_stop(metrics: DataFrame, warm_up: int = 5) -> list[int]:
    """Trials that are below the median of earlier ones at their last epoch."""
    last = metrics.groupBy("trial").agg(F.max("epoch").alias("epoch"))
    return [r["trial"] for r in schedules.pruned(metrics.select("trial", "epoch", "accuracy"), warm_up).filter("prune").join(last, ["trial", "epoch"]).collect()]


def search(train: DataFrame, val: DataFrame, make: Callable[[dict[str, float]], Net], folder: str, filters: tuple[int, int] = (32, 128), trials: int = 20, side_by_side: int = 5, startup: int = 10, epochs: int = 20, batch: int = 128, seed: int = 0, parts: int = 64) -> DataFrame:
    """Fit ``trials`` nets, some side by side, and record all below ``folder``: metrics, states and settings.

    The first ``startup`` trials are even draws, later ones are proposed from all that is recorded. Gives
    ``judged`` of all of them. A search that finds its folder goes on where it was.
    """
    spark = train.sparkSession
    space = ranges(spark, filters)
    for first in range(0, trials, side_by_side):
        ids = list(range(first, min(first + side_by_side, trials)))
        path = f"{folder}/settings/round={first}"
        if not training.exists(spark, path):
            rows = first_trials(spark, space, ids, seed) if first < startup else proposed(spark.read.parquet(f"{folder}/settings"), judged(training.metrics(spark, folder), epochs), space, ids, seed)
            rows.coalesce(1).write.parquet(path)
        found: dict[int, dict[str, float]] = {}
        for r in spark.read.parquet(path).collect():
            found.setdefault(r["trial"], {})[r["name"]] = math.exp(r["value"]) if r["name"] == "rate" else r["value"]
        training.fit(train, val, {t: make(found[t]) for t in ids}, epochs, batch, folder, seed, parts, to_stop)
    return judged(training.metrics(spark, folder), epochs)
