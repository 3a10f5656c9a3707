"""Block coding of byte images: cosine transform, quantisation, zigzag and run lengths of 8 by 8 blocks, and back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The published luminance table, by rows.
LUMINANCE = (
    (16, 11, 10, 16, 24, 40, 51, 61),
    (12, 12, 14, 19, 26, 58, 60, 55),
    (14, 13, 16, 24, 40, 57, 69, 56),
    (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77),
    (24, 35, 55, 64, 81, 104, 113, 92),
    (49, 64, 78, 87, 103, 121, 120, 101),
    (72, 92, 95, 98, 112, 100, 103, 99),
)
SIDE = 8
#: Row and column of each coefficient: by diagonals, odd ones from the top, even ones from the left.
ZIGZAG = sorted(((u, v) for u in range(SIDE) for v in range(SIDE)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else -p[0]))
COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / SIDE) * np.cos((2 * y + 1) * u * np.pi / (2 * SIDE)) for y in range(SIDE)] for u in range(SIDE)])


def steps(quality: int = 95) -> np.ndarray:
    """The table at a quality of 1 to 100, in whole steps of at least 1."""
    by = 200 - 2 * quality if quality >= 50 else 5000 // quality
    return np.maximum(1, (np.array(LUMINANCE) * by + 50) // 100)


def blocks(strips: DataFrame) -> DataFrame:
    """Byte images of one channel as blocks: image, block_y, block_x, high and wide (rows and columns of the block in the image), pixels (64).

    ``strips`` has image, y, x and values, each strip beginning at a multiple of 8 columns. Blocks at
    the right and lower edge are filled with their last column and row. Strips without values are left out.
    """
    n = F.size("values")
    cuts = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / float(SIDE)).cast("int"))).alias("cut")
    rows = strips.filter("size(values) > 0").select("image", "y", F.floor(F.col("x") / float(SIDE)).alias("at"), "values", cuts)
    row = F.slice("values", F.col("cut") * SIDE + 1, SIDE)
    rows = rows.select("image", F.floor(F.col("y") / float(SIDE)).cast("long").alias("block_y"), (F.col("at") + F.col("cut")).cast("long").alias("block_x"), "y", row.alias("row"))
    held = rows.groupBy("image", "block_y", "block_x").agg(F.array_sort(F.collect_list(F.struct("y", "row"))).alias("rows"))
    fill = lambda a: F.concat(a, F.array_repeat(F.element_at(a, -1), SIDE - F.size(a)))
    pixels = F.flatten(fill(F.transform("rows", lambda r: fill(r["row"]))))
    return held.select("image", "block_y", "block_x", F.size("rows").alias("high"), F.size(F.col("rows")[0]["row"]).alias("wide"), pixels.alias("pixels"))


def _by_batch(df: DataFrame, column: str, out: str, kind: str, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``df`` with the 64 values of ``column`` replaced by what ``work`` makes of them as ``out``."""
    keep = [c for c in df.columns if c != column]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{out} array<{kind}>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(keep)).flatten().to_numpy().reshape(-1, SIDE * SIDE)
            made = work(x)
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype="i4") * SIDE * SIDE), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), each], [*keep, out])

    return df.select(*keep, column).mapInArrow(run, schema)


def runs(coefficients: Column) -> Column:
    """The coefficients that aren't 0, each with how many zeros come before it since the last: array of (run, value)."""
    found = F.filter(F.transform(coefficients, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda s: s["v"] != 0)
    with_last = F.arrays_zip(found.alias("own"), F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("v"))), found).alias("last"))
    return F.transform(F.filter(with_last, lambda p: p["own"].isNotNull()), lambda p: F.struct((p["own"]["i"] - p["last"]["i"] - 1).alias("run"), p["own"]["v"].alias("value")))


def spread(runs: Column) -> Column:
    """The 64 coefficients of ``runs``."""
    zeros = lambda n: F.array_repeat(F.lit(0), n)
    held = F.flatten(F.transform(runs, lambda r: F.concat(zeros(r["run"]), F.array(r["value"]))))
    return F.concat(held, zeros(SIDE * SIDE - F.size(held)))


def coded(blocks: DataFrame, quality: int = 95) -> DataFrame:
    """``blocks`` with ``code``, their quantised coefficients in zigzag order as runs, for their pixels. Halves go to the even number."""
    table = steps(quality)
    order = [u * SIDE + v for u, v in ZIGZAG]

    def work(x: np.ndarray) -> np.ndarray:
        x = x.reshape(-1, SIDE, SIDE) - 128.0
        return np.rint(np.round(COSINES @ x @ COSINES.T, 6) / table).astype("i4").reshape(-1, SIDE * SIDE)[:, order]

    own = blocks.withColumn("pixels", F.col("pixels").cast("array<double>"))
    return _by_batch(own, "pixels", "zigzag", "int", work).withColumn("code", runs(F.col("zigzag"))).drop("zigzag")


def decoded(coded: DataFrame, quality: int = 95) -> DataFrame:
    """``coded`` with ``pixels``, real numbers, for ``code``.

    Their root of summed squares is off by at most that of half the steps; without quantisation by nothing.
    """
    table = steps(quality)
    back = np.argsort([u * SIDE + v for u, v in ZIGZAG])

    def work(z: np.ndarray) -> np.ndarray:
        return (COSINES.T @ (z[:, back].reshape(-1, SIDE, SIDE) * table) @ COSINES + 128).reshape(-1, SIDE * SIDE)

    return _by_batch(coded.withColumn("code", spread(F.col("code"))), "code", "pixels", "double", work)


def unblocked(blocks: DataFrame) -> DataFrame:
    """Strips of the blocks' own rows and columns, as bytes."""
    row = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("high") - 1), lambda r: F.slice("pixels", r * SIDE + 1, F.col("wide")))).alias("r", "row")
    each = blocks.select("image", "block_y", "block_x", row)
    values = F.transform("row", lambda v: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v.cast("double")))).cast("int"))
    return each.select("image", (F.col("block_y") * SIDE + F.col("r")).alias("y"), (F.col("block_x") * SIDE).alias("x"), values.alias("values"))
