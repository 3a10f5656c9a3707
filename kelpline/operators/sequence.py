"""Convolution, pooling, attention and recurrence over series."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from kelpline.functions.columns import dot, relu
from kelpline.operators.groups import LONG, over_series, placed, with_aggregates
from kelpline.sources.sinks import scratch


def conv1d(value: str, kernel: tuple[float, float, float], window: WindowSpec, bias: float = 0.0) -> Column:
    """Width 3, step 1, zero padding of 1; over the rows of a series in order."""
    before, after = (F.coalesce(f(value).over(window), F.lit(0.0)) for f in (F.lag, F.lead))
    return kernel[0] * before + kernel[1] * F.col(value) + kernel[2] * after + bias


def conv1d_relu(df: DataFrame, kernel: tuple[float, float, float], bias: float = 0.0, value: str = "value", out: str = "y", most: int = LONG) -> DataFrame:
    return over_series(df, 1, lambda d, w: d.withColumn(out, relu(conv1d(value, kernel, w, bias))), most)


def maxpool1d(df: DataFrame, value: str = "value", most: int = LONG) -> DataFrame:
    """Largest of each two rows in order, an odd last one dropped: series_id, place, pooled."""
    pairs = placed(df, most).withColumn("place", F.floor((F.col("n") - 1) / 2.0))
    return pairs.groupBy("series_id", "place").agg(F.max(value).alias("pooled"), F.count(F.lit(1)).alias("n")).filter("n = 2").drop("n")


def last_step(df: DataFrame, value: str = "value") -> DataFrame:
    return df.groupBy("series_id").agg(F.max_by(value, F.struct("t", "event_id")).alias("last_value"))


def attention_pool(df: DataFrame, score: Column, value: str = "value", activation=None) -> DataFrame:
    """Softmax of the scores over a series, and the values summed by these weights: series_id, pooled, top_weight.

    ``activation`` is put on the score first, if given. Scores are shifted by the series' largest.
    """
    scored = df.withColumn("_u", activation(score) if activation else score)
    shifted = with_aggregates(scored, "series_id", _top=F.max("_u")).withColumn("_e", F.exp(F.col("_u") - F.col("_top")))
    return shifted.groupBy("series_id").agg((F.sum(F.col("_e") * F.col(value)) / F.sum("_e")).alias("pooled"), (F.max("_e") / F.sum("_e")).alias("top_weight"))


def conv1d_channels(df: DataFrame, weights: list, bias: list[float], value: str = "x", out: str = "y", most: int | None = LONG) -> DataFrame:
    """``conv1d`` over arrays of channels, then ReLU; ``weights`` by output, input channel and place."""
    n_in = len(weights[0])
    rows = F.array(*(F.array(*(F.lit(float(by_input[c][t])) for t in range(3) for c in range(n_in))) for by_input in weights))
    none = F.array_repeat(F.lit(0.0), n_in)

    def body(d: DataFrame, w: WindowSpec) -> DataFrame:
        near = F.concat(F.coalesce(F.lag(value).over(w), none), F.col(value), F.coalesce(F.lead(value).over(w), none))
        sums = F.zip_with(rows, F.array(*map(F.lit, bias)), lambda r, b: relu(dot(F.col("_near"), r) + b))
        return d.withColumn("_near", near).withColumn(out, sums).drop("_near")

    return over_series(df, 1, body, most)


def maxpool1d_channels(df: DataFrame, value: str = "y", most: int | None = LONG) -> DataFrame:
    """``maxpool1d`` of each channel of an array: series_id, place, pooled."""
    pairs = placed(df, most).withColumn("place", F.floor((F.col("n") - 1) / 2.0))
    both = pairs.groupBy("series_id", "place").agg(F.collect_list(value).alias("both")).filter("size(both) = 2")
    return both.select("series_id", "place", F.zip_with(F.col("both")[0], F.col("both")[1], lambda a, b: F.greatest(a, b)).alias("pooled"))


def attention_vectors(df: DataFrame, weights: list[float], value: str = "x", activation=None) -> DataFrame:
    """Softmax over a series of the products of its vectors with ``weights``, and the vectors summed by it: series_id, pooled, top_weight."""
    score = dot(F.col(value), F.array(*map(F.lit, weights)))
    scored = df.withColumn("_u", activation(score) if activation else score)
    shifted = with_aggregates(scored, "series_id", _top=F.max("_u")).withColumn("_e", F.exp(F.col("_u") - F.col("_top")))
    sums = F.array(*(F.sum(F.col("_e") * F.get(value, F.lit(i))) / F.sum("_e") for i in range(len(weights))))
    return shifted.groupBy("series_id").agg(sums.alias("pooled"), (F.max("_e") / F.sum("_e")).alias("top_weight"))


def bilstm(df: DataFrame, hidden: int = 128, layers: int = 1, seed: int = 0, value: str = "x", block: int = 4096, most: int | None = LONG) -> DataFrame:
    """A bidirectional LSTM with seeded weights over each series of arrays: series_id, block, steps.

    ``steps`` has the 2 * ``hidden`` outputs of the last layer at each step of a block of ``block``
    steps, forward half first; blocks count from 0. A recurrence can't be a window function, so a
    round goes over one block of every series, with the states that the block before it ended with.
    A task holds blocks, 64 at a time, not series; series of one block, the usual ones, take one round.
    """
    spark, name = df.sparkSession, "recurrence"
    rows = placed(df.select("series_id", "t", "event_id", F.col(value).alias("x")), most).withColumn("block", F.floor((F.col("n") - 1) / float(block)).cast("long"))
    held = rows.groupBy("series_id", "block").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("rows"))
    held = with_aggregates(held, "series_id", last=F.max("block")).select("series_id", "block", "last", F.transform("rows", lambda r: r["x"]).alias("xs"))
    for layer in range(layers):
        held = staged(held, name)
        rounds = (held.agg(F.max("last")).first()[0] or 0) + 1
        ahead, back = (one_way(held, rounds, hidden, seed + 2 * layer + way, bool(way)) for way in (0, 1))
        both = F.zip_with("steps", "_steps", lambda a, b: F.concat(a, b))
        back = back.select(F.col("series_id").alias("_id"), F.col("block").alias("_block"), F.col("steps").alias("_steps"))
        held = ahead.join(back, ahead["series_id"].eqNullSafe(back["_id"]) & (F.col("block") == F.col("_block"))).select("series_id", "block", "last", both.alias("xs"))
    return held.select("series_id", "block", F.col("xs").alias("steps"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that a later round doesn't make it anew."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_way(held: DataFrame, rounds: int, hidden: int, seed: int, turned: bool) -> DataFrame:
    """One direction over blocks (series_id, block, last, xs): series_id, block, last, steps."""
    kind = held.schema["series_id"].dataType
    schema = f"series_id {kind.simpleString()}, block long, last long, steps array<array<double>>, h array<double>, c array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                xs = [np.array(x, "f8") for x in part.column(3).to_pylist()]
                xs = [x[::-1] if turned else x for x in xs]
                states = [np.array([s or [0.0] * hidden for s in part.column(i).to_pylist()]) for i in (4, 5)]
                out, h, c = recur(xs, *weights(xs[0].shape[1], hidden, seed), *states)
                steps = [(y[::-1] if turned else y).tolist() for y in out]
                made = [pa.array(steps, pa.list_(pa.list_(pa.float64()))), *(pa.array(s.tolist(), pa.list_(pa.float64())) for s in (h, c))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *made], ["series_id", "block", "last", "steps", "h", "c"])

    order = F.col("last") - F.col("block") if turned else F.col("block")
    parts, states = [], None
    for k in range(rounds):
        now = held.filter(order == k).select("series_id", "block", "last", "xs")
        if states is None:
            none = F.lit(None).cast("array<double>")
            now = now.select("*", none.alias("h"), none.alias("c"))
        else:
            before = states.select(F.col("series_id").alias("_id"), "h", "c")
            now = now.join(before, now["series_id"].eqNullSafe(before["_id"]), "left").drop("_id")
        states = staged(now.mapInArrow(run, schema), "recurrence")
        parts.append(states.drop("h", "c"))
    return functools.reduce(DataFrame.unionByName, parts)


def weights(n_in: int, hidden: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    draw, bound = np.random.default_rng(seed), 1 / np.sqrt(hidden)
    return tuple(draw.uniform(-bound, bound, shape) for shape in ((n_in, 4 * hidden), (hidden, 4 * hidden), (4 * hidden,)))


def recur(series: list[np.ndarray], w: np.ndarray, u: np.ndarray, b: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hidden states of series of different lengths (steps by channels), from the states ``h`` and ``c`` on, and the states each ends with.

    Gates are in the order input, forget, cell, output.
    """
    lengths = np.array([len(x) for x in series])
    x = np.zeros((len(series), lengths.max(), series[0].shape[1]))
    for row, own in zip(x, series):
        row[: len(own)] = own
    out = np.empty((*x.shape[:2], len(u)))
    for k in range(x.shape[1]):
        i, f, g, o = np.split(x[:, k] @ w + h @ u + b, 4, axis=1)
        i, f, o = (1 / (1 + np.exp(-z)) for z in (i, f, o))
        going = (k < lengths)[:, None]
        c = np.where(going, f * c + i * np.tanh(g), c)
        out[:, k] = h = np.where(going, o * np.tanh(c), h)
    return [y[:n] for y, n in zip(out, lengths)], h, c
