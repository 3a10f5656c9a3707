"""Morlet wavelet transform of series.

W(s, b) = s^-1/2 * sum over k of x_k psi((k - b) / s), psi(u) = exp(-u^2 / 2) cos(5 u), |u| <= 8,
with zeros beyond both ends, and k, b counting samples in order of time.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kelpline.operators.groups import blocks, placed

#: Fixed value: the wavelet's centre frequency in cycles per sample.
CENTRE = 0.8125
REACH = 8


@functools.lru_cache(maxsize=1024)
def kernel(scale: int) -> np.ndarray:
    """The wavelet of a scale at -REACH * scale ... REACH * scale samples."""
    u = np.arange(-REACH * scale, REACH * scale + 1) / scale
    return np.exp(-u * u / 2) * np.cos(5 * u) / np.sqrt(scale)


def powers(x: np.ndarray, scale: int) -> np.ndarray:
    """|W| at each sample of ``x``; the part of the wavelet that can't meet a sample is left out."""
    middle, held = REACH * scale, min(REACH * scale, len(x) - 1)
    return np.abs(np.convolve(x, kernel(scale)[middle - held : middle + held + 1])[held : held + len(x)])


def cwt(df: DataFrame, scales: tuple[int, ...], value: str = "scaled", block: int = 1 << 16) -> DataFrame:
    """|W|: series_id, first (place of the first sample, from 1), scale, power (array over samples).

    Null and NaN samples count as 0. A series comes in blocks of ``block`` samples, at least as many
    as the widest wavelet reaches, and a task holds one of them with its surroundings at a time.
    """
    reach = REACH * max(scales)
    block = max(block, reach)
    kind = to_arrow_type(df.schema["series_id"].dataType)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_n")
        x, own = np.nan_to_num(rows.column(value).to_numpy()), rows.column("_own").to_numpy()
        n = int(own.sum())
        used = scales if n else ()
        flat = np.concatenate([powers(x, s)[own] for s in used]) if used else np.zeros(0)
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * n, pa.int32()), pa.array(flat))
        first = int(rows.column("_n").to_numpy()[own].min()) if n else 0
        made = {"series_id": pa.array([rows.column("series_id")[0].as_py()] * len(used), kind), "first": pa.array([first] * len(used), pa.int64()), "scale": pa.array(used, pa.int32()), "power": each}
        return pa.table(made)

    cut = blocks(placed(df.select("series_id", "t", "event_id", value), out="_n"), reach, block)
    held = cut.select("series_id", "_block", "_n", "_own", F.col(value).cast("double").alias(value))
    out = f"series_id {df.schema['series_id'].dataType.simpleString()}, first long, scale int, power array<double>"
    return held.groupBy("series_id", "_block").applyInArrow(run, out)


def over_whole(df: DataFrame, n_scales: int, body: Callable[[np.ndarray], dict], fields: str, value: str = "scaled") -> DataFrame:
    """series_id and the columns ``fields``, which ``body`` makes of |W| for scales 1 to ``n_scales`` (scales by samples).

    A task holds a series with all its scales, so series must be short; nothing but its rows is moved.
    """
    kind = to_arrow_type(df.schema["series_id"].dataType)

    def run(rows: pa.Table) -> pa.Table:
        x = np.nan_to_num(rows.sort_by("_n").column(value).to_numpy())
        made = body(np.stack([powers(x, s) for s in range(1, n_scales + 1)]))
        n = len(next(iter(made.values())))
        return pa.table({"series_id": pa.array([rows.column("series_id")[0].as_py()] * n, kind), **made})

    held = placed(df.select("series_id", "t", "event_id", F.col(value).cast("double").alias(value)), None, "_n").select("series_id", "_n", value)
    return held.groupBy("series_id").applyInArrow(run, f"series_id {df.schema['series_id'].dataType.simpleString()}, {fields}")


def lists(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype="i4") * rows.shape[1]), pa.array(rows.ravel()))


def cwt_full(df: DataFrame, n_scales: int = 127, value: str = "scaled", block: int = 1 << 16) -> DataFrame:
    """``cwt`` for scales 1 to ``n_scales``."""
    return cwt(df, tuple(range(1, n_scales + 1)), value, block)


def cwt_power(df: DataFrame, scales: tuple[int, ...], value: str = "scaled", block: int = 1 << 16) -> DataFrame:
    """``cwt`` for few scales, a row for each sample: series_id, n (place from 1), scale, power."""
    each = cwt(df, scales, value, block).select("series_id", "first", "scale", F.posexplode("power").alias("i", "power"))
    return each.select("series_id", (F.col("first") + F.col("i")).alias("n"), "scale", "power")


def frequencies(scales: DataFrame, dt: float = 0.02) -> DataFrame:
    """``scales`` with freq (cycles per sample) and freq_hz (by the sampling step)."""
    return scales.withColumn("freq", CENTRE / F.col("scale")).withColumn("freq_hz", F.col("freq") / dt)
