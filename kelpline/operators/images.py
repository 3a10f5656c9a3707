"""Images as strips, and work on tiles of them: convolution, resizing, colour maps.

An image is rows of strips: image, y, x (of its first column) and values, an array of columns by
channels. An operator cuts its result into tiles; a strip goes to every tile whose values depend on
it, cut to the columns that the tile needs, so a tile comes with its halo, and a task holds one tile
whatever the size of the image. Images of all sizes are worked on together.

An image of few columns that a task holds anyway needs no strips: a ``Local`` operator is also a
function of whole arrays (rows by columns by channels), as are the operators with ``_whole`` in their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kelpline.functions.columns import erf_terms
from kelpline.operators.groups import with_aggregates

#: Result rows and columns of a tile.
TILE = 256
#: Columns up to which a task may hold an image whole.
WHOLE = 512


@dataclass(frozen=True)
class Window:
    """Along one axis, result ``o`` needs ``size`` values from ``o * step - pad`` on."""

    size: int
    step: int = 1
    pad: int = 0

    def length(self, n):
        return _down(n + (2 * self.pad - self.size), self.step) + 1

    def first(self, at, n, m):
        """The first result that depends on the value at ``at``."""
        return _down(at + (self.pad - self.size + self.step), self.step)

    def last(self, at, n, m):
        return _down(at + self.pad, self.step)

    def needs(self, low, high, n, m):
        """The values that results ``low`` to ``high`` depend on; some may lie outside."""
        return low * self.step - self.pad, high * self.step + (self.size - 1 - self.pad)


@dataclass(frozen=True)
class Scale:
    """Along one axis, ``n`` values become ``m`` by a kernel that is as wide as a value and ``reach`` times as far, wider where ``m`` is less."""

    reach: int = 1

    def first(self, at, n, m):
        return _down((at + 0.5 - self.reach * _larger(n / m, 1.0)) * m / n - 0.5, 1)

    def last(self, at, n, m):
        return _down((at + 0.5 + self.reach * _larger(n / m, 1.0)) * m / n - 0.5, 1) + 1

    def needs(self, low, high, n, m):
        wide = self.reach * _larger(n / m, 1.0)
        return _down((low + 0.5) * n / m - wide, 1), _down((high + 0.5) * n / m + wide, 1) + 1

    def weights(self, n: int, m: int, low: int, high: int, start: int, stop: int) -> np.ndarray:
        """Of results ``low`` to ``high`` by values ``start`` to ``stop``; each result's weights on all values sum to 1."""
        made = _weights if max(n, m) <= WHOLE else _weights.__wrapped__
        return made(self.reach, n, m, low, high)[:, start:stop]


@functools.lru_cache(maxsize=128)
def _weights(reach: int, n: int, m: int, low: int, high: int) -> np.ndarray:
    at = (np.arange(n) + 0.5 - (np.arange(low, high)[:, None] + 0.5) * n / m) / max(n / m, 1.0)
    w = np.maximum(1 - np.abs(at), 0) if reach == 1 else np.where(np.abs(at) < reach, np.sinc(at) * np.sinc(at / reach), 0)
    return w / w.sum(axis=1, keepdims=True)


def _down(a, b):
    return F.floor(a / float(b)).cast("long") if isinstance(a, Column) else math.floor(a / b)


def _larger(a, b):
    return F.greatest(a, F.lit(b)) if isinstance(a, Column) else max(a, b)


def _smaller(a, b):
    return F.least(a, b) if isinstance(a, Column) else min(a, b)


@dataclass(frozen=True)
class Local:
    """An operator whose values depend on values nearby, as ``over_tiles`` takes it."""

    channels: int
    out_channels: int
    axes: tuple
    size: Callable
    work: Callable

    def over(self, strips: DataFrame, tile: int = TILE) -> DataFrame:
        return over_tiles(strips, self.channels, self.out_channels, self.axes, self.size, self.work, tile)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The result of a whole image; one without values where there is none."""
        image = x.shape[:2]
        out = tuple(int(n) for n in self.size(*image))
        if min(out) < 1:
            return np.zeros((0, 0, self.out_channels))
        (from_y, to_y), (from_x, to_x) = (axis.needs(0, m - 1, n, m) for axis, n, m in zip(self.axes, image, out))
        held = np.zeros((to_y + 1 - from_y, to_x + 1 - from_x, self.channels))
        top, left = max(from_y, 0), max(from_x, 0)
        inside = np.nan_to_num(x[top : to_y + 1, left : to_x + 1])
        held[top - from_y :, left - from_x :][: inside.shape[0], : inside.shape[1]] = inside
        return self.work(held, (from_y, from_x), image, out, (0, out[0]), (0, out[1]))


def sized(strips: DataFrame, channels: int) -> DataFrame:
    """``strips`` with the height and width of their image."""
    return with_aggregates(strips, "image", height=F.max("y") + 1, width=F.max(F.col("x") + F.size("values") / channels).cast("long"))


def over_tiles(strips: DataFrame, channels: int, out_channels: int, axes: tuple, size: Callable, work: Callable, tile: int = TILE) -> DataFrame:
    """``work`` on each tile of the result; gives strips with ``out_channels``.

    ``axes`` are the ``Window`` or ``Scale`` of rows and columns, ``size`` gives the result's height and
    width from the columns of the image's. ``work`` gets the tile's values (rows by
    columns by channels, 0 outside of the image), where they begin, the sizes of the image and of the
    result, and the tile's rows and columns; it gives these by channels. Null values count as 0, rows without values are left out,
    and images that give no result have no rows.
    """
    kind = strips.schema["image"].dataType
    known = sized(strips.filter("y IS NOT NULL AND x IS NOT NULL AND size(values) > 0").select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "values"), channels)
    for name, n in zip(("high", "wide"), size(F.col("height"), F.col("width"))):
        known = known.withColumn(name, (n if isinstance(n, Column) else F.lit(n)).cast("long"))
    known = known.filter("high > 0 AND wide > 0")
    end = F.col("x") + (F.size("values") / channels).cast("long") - 1

    def tiles(axis, first: Column, last: Column, n: str, m: str) -> Column:
        low = F.greatest(axis.first(first, F.col(n), F.col(m)), F.lit(0))
        high = F.least(axis.last(last, F.col(n), F.col(m)), F.col(m) - 1)
        return F.explode(F.when(low <= high, F.sequence(F.floor(low / float(tile)).cast("long"), F.floor(high / float(tile)).cast("long"))))

    dealt = known.withColumn("_end", end).withColumn("tile_y", tiles(axes[0], F.col("y"), F.col("y"), "height", "high"))
    dealt = dealt.withColumn("tile_x", tiles(axes[1], F.col("x"), F.col("_end"), "width", "wide"))
    low, high = axes[1].needs(F.col("tile_x") * tile, F.least((F.col("tile_x") + 1) * tile, F.col("wide")) - 1, F.col("width"), F.col("wide"))
    dealt = dealt.withColumn("_low", F.greatest(low, F.col("x"))).withColumn("_high", F.least(high, F.col("_end"))).filter("_low <= _high")
    cut = F.slice("values", ((F.col("_low") - F.col("x")) * channels + 1).cast("int"), ((F.col("_high") - F.col("_low") + 1) * channels).cast("int"))
    dealt = dealt.select("image", "tile_y", "tile_x", "height", "width", "high", "wide", "y", F.col("_low").alias("x"), cut.alias("values"))

    def run(rows: pa.Table) -> pa.Table:
        one = {c: rows.column(c)[0].as_py() for c in ("tile_y", "tile_x", "height", "width", "high", "wide")}
        low_y, low_x = one["tile_y"] * tile, one["tile_x"] * tile
        high_y, high_x = min(low_y + tile, one["high"]), min(low_x + tile, one["wide"])
        from_y, to_y = axes[0].needs(low_y, high_y - 1, one["height"], one["high"])
        from_x, to_x = axes[1].needs(low_x, high_x - 1, one["width"], one["wide"])
        held = np.zeros((to_y + 1 - from_y, to_x + 1 - from_x, channels))
        for y, x, values in zip(rows.column("y").to_pylist(), rows.column("x").to_pylist(), rows.column("values")):
            found = np.nan_to_num(values.values.to_numpy(zero_copy_only=False).astype("f8")).reshape(-1, channels)
            if 0 <= y - from_y < len(held):
                held[y - from_y, x - from_x : x - from_x + len(found)] = found
        out = work(held, (from_y, from_x), (one["height"], one["width"]), (one["high"], one["wide"]), (low_y, high_y), (low_x, high_x)).reshape(high_y - low_y, -1)
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype="i4") * out.shape[1]), pa.array(out.ravel()))
        n = len(out)
        return pa.table({"image": pa.array([rows.column("image")[0].as_py()] * n, to_arrow_type(kind)), "y": pa.array(np.arange(low_y, high_y)), "x": pa.array([low_x] * n, pa.int64()), "values": each})

    return dealt.groupBy("image", "tile_y", "tile_x").applyInArrow(run, f"image {kind.simpleString()}, y long, x long, values array<double>")


def convolve(strips: DataFrame, weights: np.ndarray, bias: np.ndarray, step: int = 1, pad: int = 0, each: bool = False, then: Callable | None = None, tile: int = TILE) -> DataFrame:
    return convolution(weights, bias, step, pad, each, then).over(strips, tile)


def convolution(weights: np.ndarray, bias: np.ndarray, step: int = 1, pad: int = 0, each: bool = False, then: Callable | None = None) -> Local:
    """A two-dimensional convolution; ``weights`` are rows by columns by input by output channels, or with ``each`` rows by columns by channels, of which each has its own.

    ``then`` is put on the result's values (rows by columns by channels) and on the values in their places
    before, cut to the same size; that needs step 1 and as many rows and columns.
    """
    rows, columns, channels = weights.shape[:3]
    axes = Window(rows, step, pad), Window(columns, step, pad)

    def work(held, start, image, out, ys, xs):
        m_y, m_x = ys[1] - ys[0], xs[1] - xs[0]
        total = np.zeros((m_y, m_x, len(bias)))
        for r in range(rows):
            for c in range(columns):
                part = held[r : r + (m_y - 1) * step + 1 : step, c : c + (m_x - 1) * step + 1 : step]
                total += part * weights[r, c] if each else part @ weights[r, c]
        total += bias
        return then(total, held[pad : pad + m_y, pad : pad + m_x]) if then else total

    n_out = then(np.zeros((1, 1, len(bias))), np.zeros((1, 1, channels))).shape[-1] if then else len(bias)
    return Local(channels, n_out, axes, lambda h, w: (axes[0].length(h), axes[1].length(w)), work)


def erf(x: np.ndarray) -> np.ndarray:
    """The error function by the same terms as for columns."""
    low, a = 0.25, np.minimum(np.abs(x), 6.0)
    t = 2 / (2 + a)
    return np.sign(x) * np.where(np.abs(x) < 6, 1 - t * np.exp(np.polyval(erf_terms()[::-1], (2 * t - (low + 1)) / (1 - low)) - a * a), 1.0)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def normed(x: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """Every pixel's channels less their mean by the root of their population variance and ``eps``."""
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps)


def block(strips: DataFrame, around: np.ndarray, bias: np.ndarray, up: np.ndarray, down: np.ndarray, scale: float = 1e-6, tile: int = TILE) -> DataFrame:
    return residual(around, bias, up, down, scale).over(strips, tile)


def residual(around: np.ndarray, bias: np.ndarray, up: np.ndarray, down: np.ndarray, scale: float = 1e-6) -> Local:
    """A block of the convolutional model: 7 x 7 for each channel, norm, up to more channels, GELU, down again, scaled and added."""
    return convolution(around, bias, 1, around.shape[0] // 2, True, lambda y, x: x + scale * (gelu(normed(y) @ up) @ down))


def resized(strips: DataFrame, size: Callable, channels: int = 1, reach: int = 1, tile: int = TILE) -> DataFrame:
    return resizing(size, channels, reach).over(strips, tile)


def resizing(size: Callable, channels: int = 1, reach: int = 1) -> Local:
    """Images at another size: ``size`` gives height and width from those of the image. ``reach`` 1 is linear between neighbours, 3 a windowed sinc.

    Where an image shrinks, the kernel is as wide as what falls on one pixel. Weights on pixels beyond an
    edge go to those inside. Values are real numbers; nothing is rounded between the two directions.
    """
    axis = Scale(reach)

    def work(held, start, image, out, ys, xs):
        top, left = max(start[0], 0), max(start[1], 0)
        held = held[top - start[0] :, left - start[1] :][: image[0] - top, : image[1] - left]
        w_y = axis.weights(image[0], out[0], *ys, top, top + held.shape[0])
        w_x = axis.weights(image[1], out[1], *xs, left, left + held.shape[1])
        return np.einsum("oy,yxc,px->opc", w_y, held, w_x, optimize=True)

    return Local(channels, channels, (axis, axis), size, work)


def fitted(size: int = 224) -> Callable:
    """Height and width that fit a square of ``size`` in proportion, 1 at least."""

    def of(height, width) -> tuple:
        scale = _smaller(size / width, size / height)
        return tuple(_larger(_down(v * scale, 1), 1) for v in (height, width))

    return of


def pasted(strips: DataFrame, size: int = 224, channels: int = 1, fill: float = 0.0) -> DataFrame:
    """Images in the middle of squares of ``size``, the rest ``fill``; larger ones aren't cut. One strip for each row."""
    known = sized(strips, channels)
    whole = known.groupBy("image", "y", "height", "width").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("x", "values"))), lambda s: s["values"])).alias("values"))
    left, top = (F.floor((size - F.col(c)) / 2.0).cast("long") for c in ("width", "height"))
    fills = lambda n: F.array_repeat(F.lit(float(fill)), (F.greatest(n, F.lit(0)) * channels).cast("int"))
    middle = whole.select("image", (F.col("y") + top).alias("y"), F.lit(0).cast("long").alias("x"), F.concat(fills(left), "values", fills(size - F.col("width") - left)).alias("values"))
    rest = known.groupBy("image", "height", "width").agg(F.lit(1)).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    rest = rest.filter((F.col("y") < top) | (F.col("y") >= top + F.col("height")))
    return middle.unionByName(rest.select("image", F.col("y").cast("long").alias("y"), F.lit(0).cast("long").alias("x"), fills(F.greatest(F.lit(size), F.col("width"))).alias("values")))


def pasted_whole(x: np.ndarray, size: int = 224, fill: float = 0.0) -> np.ndarray:
    """The same of an array that fits the square."""
    out = np.full((size, size, x.shape[2]), float(fill))
    top, left = ((size - n) // 2 for n in x.shape[:2])
    out[top : top + x.shape[0], left : left + x.shape[1]] = x
    return out


#: The anchors of the published purple to green diverging map, from low to high.
PURPLE_GREEN = ("40004b", "762a83", "9970ab", "c2a5cf", "e7d4e8", "f7f7f7", "d9f0d3", "a6dba0", "5aae61", "1b7837", "00441b")


def coloured(x: Column, anchors: tuple[str, ...] = PURPLE_GREEN) -> Column:
    """Bytes of red, green and blue for values in 0..1: 256 levels, each between its two neighbouring anchors. Null for null, NaN as 0."""
    level = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.when(F.isnan(x), 0.0).otherwise(x) * 256))).cast("int")
    table = F.array(*(F.array(*map(F.lit, colour)) for colour in levels(anchors)))
    return F.when(x.isNotNull(), F.element_at(table, level + 1))


def coloured_whole(x: np.ndarray) -> np.ndarray:
    """The level of ``coloured`` for each value, by which ``levels`` are found."""
    return np.clip(np.floor(np.where(np.isnan(x), 0.0, x) * 256), 0, 255).astype("i4")


def levels(anchors: tuple[str, ...]) -> list[list[int]]:
    """The 256 colours of a map that is linear between its anchors."""
    known = np.array([[int(a[i : i + 2], 16) for i in (0, 2, 4)] for a in anchors], "f8")
    at = np.arange(256) / 255 * (len(anchors) - 1)
    return [[int(np.floor(np.interp(p, np.arange(len(anchors)), known[:, c]) + 1e-9)) for c in range(3)] for p in at]


def colour_counts(strips: DataFrame, keys: list[str]) -> DataFrame:
    """Of each strip (``keys`` and values of three channels): its colours r, g and b and how many of its pixels have them (n)."""
    kinds = ", ".join(f"{k} {strips.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            held = batch.column(len(keys))
            flat = held.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3).astype("i8")
            row = np.repeat(np.arange(len(held)), held.value_lengths().fill_null(0).to_numpy() // 3)
            found, n = np.unique((row << 24) + (flat[:, 0] << 16) + (flat[:, 1] << 8) + flat[:, 2], return_counts=True)
            at = pa.array(found >> 24)
            colours = [pa.array((found >> by & 255).astype("i4")) for by in (16, 8, 0)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keys))), *colours, pa.array(n.astype("i8"))], [*keys, "r", "g", "b", "n"])

    return strips.select(*keys, "values").mapInArrow(run, f"{kinds}, r int, g int, b int, n long")


def tokens(strips: DataFrame, channels: int) -> DataFrame:
    """A row for each pixel: image, y, x, values (its channels), height and width of the image."""
    known = sized(strips, channels)
    at = F.explode(F.sequence(F.lit(0), (F.size("values") / channels).cast("int") - 1)).alias("i")
    each = known.select("image", "y", "x", "height", "width", "values", at)
    return each.select("image", "y", (F.col("x") + F.col("i")).alias("x"), F.slice("values", F.col("i") * channels + 1, channels).alias("values"), "height", "width")


def attended(x: np.ndarray, y_at: np.ndarray, x_at: np.ndarray, region: np.ndarray, weights: dict[str, np.ndarray], heads: int, size: int) -> np.ndarray:
    """Attention among the pixels of each window (windows by pixels by channels); those of other regions don't count.

    ``bias`` has a value for each difference of places, rows by ``2 * size - 1`` and columns, and head.
    """
    windows, n, channels = x.shape
    q, k, v = ((x @ weights[name]).reshape(windows, n, heads, -1).transpose(0, 2, 1, 3) for name in ("q", "k", "v"))
    scores = q @ k.transpose(0, 1, 3, 2) / math.sqrt(channels // heads)
    apart = (y_at[:, :, None] - y_at[:, None] + size - 1) * (2 * size - 1) + x_at[:, :, None] - x_at[:, None] + size - 1
    scores += weights["bias"].T[:, apart].transpose(1, 0, 2, 3)
    scores = np.where((region[:, :, None] == region[:, None])[:, None], scores, -np.inf)
    e = np.exp(scores - scores.max(axis=3, keepdims=True))
    return (e / e.sum(axis=3, keepdims=True) @ v).transpose(0, 2, 1, 3).reshape(x.shape) @ weights["out"]


def windowed(x: np.ndarray, y_at: np.ndarray, x_at: np.ndarray, region: np.ndarray, window: np.ndarray, weights: dict[str, np.ndarray], heads: int, size: int) -> np.ndarray:
    """Pixels (by channels) after attention inside their windows, those of equal size together, and after the two linear layers."""
    x = x.copy()
    order = np.argsort(window, kind="stable")
    cuts = np.flatnonzero(np.diff(window[order], prepend=-1))
    sizes = np.diff(cuts, append=len(order))
    for n in np.unique(sizes):
        own = order[cuts[sizes == n][:, None] + np.arange(n)]
        x[own] += attended(normed(x[own]), y_at[own], x_at[own], region[own], weights, heads, size)
    if "up" in weights:
        x = x + gelu(normed(x) @ weights["up"]) @ weights["down"]
    return x


def window_whole(x: np.ndarray, weights: dict[str, np.ndarray], heads: int, size: int = 7, shift: int = 0) -> np.ndarray:
    """``window_block`` of a whole image."""
    high, wide, channels = x.shape
    if not x.size:
        return x
    y, c = (a.ravel() for a in np.indices((high, wide)))
    y_at, x_at = (y - shift) % high, (c - shift) % wide
    window = y_at // size * (wide // size + 1) + x_at // size
    return windowed(np.nan_to_num(x).reshape(-1, channels), y_at, x_at, (y < shift) * 2 + (c < shift), window, weights, heads, size).reshape(x.shape)


def window_block(strips: DataFrame, weights: dict[str, np.ndarray], heads: int, size: int = 7, shift: int = 0, channels: int | None = None) -> DataFrame:
    """Attention in windows of ``size`` by ``size`` pixels, added to the pixels, then two linear layers (up, down), added again.

    With ``shift`` the image is turned by so many rows and columns first and turned back after; what
    comes together from opposite edges doesn't attend to each other. Windows at an edge may be smaller.
    Windows are dealt by row of windows and 32 of its windows at a time. One strip for each pixel.
    """
    channels = channels or len(weights["q"])
    kind = strips.schema["image"].dataType
    turned = tokens(strips.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "values"), channels)
    for c, n in (("y", "height"), ("x", "width")):
        turned = turned.withColumn(f"at_{c}", F.pmod(F.col(c) - shift, F.col(n))).withColumn(f"w_{c}", F.floor(F.col(f"at_{c}") / float(size)))
    turned = turned.withColumn("region", (F.col("y") < shift).cast("int") * 2 + (F.col("x") < shift).cast("int"))

    def run(rows: pa.Table) -> pa.Table:
        x = np.nan_to_num(rows.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("f8")).reshape(-1, channels)
        y_at, x_at, region, window = (rows.column(c).to_numpy() for c in ("at_y", "at_x", "region", "w_x"))
        x = windowed(x, y_at, x_at, region, window, weights, heads, size)
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="i4") * channels), pa.array(x.ravel()))
        return pa.table({"image": rows.column("image"), "y": rows.column("y"), "x": rows.column("x"), "values": each})

    dealt = turned.withColumn("part", F.floor(F.col("w_x") / 32.0)).drop("height", "width")
    return dealt.groupBy("image", "w_y", "part").applyInArrow(run, f"image {kind.simpleString()}, y long, x long, values array<double>")


def merged(strips: DataFrame, weights: np.ndarray, tile: int = TILE) -> DataFrame:
    return merging(weights).over(strips, tile)


def merging(weights: np.ndarray) -> Local:
    """Each two by two pixels as one: their channels (rows run faster) normed and put through ``weights``, four times the channels by the new ones."""
    channels = len(weights) // 4
    axis = Window(2, 2)

    def work(held, start, image, out, ys, xs):
        m_y, m_x = ys[1] - ys[0], xs[1] - xs[0]
        near = [held[r : r + 2 * m_y - 1 : 2, c : c + 2 * m_x - 1 : 2] for c in (0, 1) for r in (0, 1)]
        return normed(np.concatenate(near, axis=2)) @ weights

    return Local(channels, weights.shape[1], (axis, axis), lambda h, w: (axis.length(h), axis.length(w)), work)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def inverted_bottleneck(strips: DataFrame, weights: dict[str, np.ndarray], step: int = 1, tile: int = TILE) -> DataFrame:
    """Widened to more channels (up), a convolution for each (around), a gate for each from its mean over the image, and narrowed (down).

    After ``up`` and ``around`` comes x times its sigmoid. The gate is the sigmoid of two layers
    (squeeze, excite) on the means. Means are partial sums by tile, added up for each image and joined
    back to its strips. With step 1 and as many channels out as in, the input is added.
    """
    inner, n, wide, narrow = widened(weights, step)
    return gated(inner.over(strips, tile), weights, n, wide, narrow)


def widened(weights: dict[str, np.ndarray], step: int = 1) -> tuple[Local, int, int, int]:
    """What comes before the gates, with how many channels in all, to be gated and after narrowing."""
    channels, wide = weights["up"].shape
    narrow = weights["down"].shape[1]
    swish = lambda x: x * sigmoid(x)
    size = weights["around"].shape[0]
    adds = step == 1 and channels == narrow
    axis = Window(size, step, size // 2)

    def work(held, start, image, out, ys, xs):
        m_y, m_x = ys[1] - ys[0], xs[1] - xs[0]
        inside = [((np.arange(held.shape[k]) + start[k] >= 0) & (np.arange(held.shape[k]) + start[k] < image[k])) for k in (0, 1)]
        up = swish(held @ weights["up"]) * inside[0][:, None, None] * inside[1][None, :, None]
        total = sum(up[r : r + (m_y - 1) * step + 1 : step, c : c + (m_x - 1) * step + 1 : step] * weights["around"][r, c] for r in range(size) for c in range(size))
        own = held[size // 2 : size // 2 + m_y, size // 2 : size // 2 + m_x] if adds else np.zeros((m_y, m_x, 0))
        return np.concatenate([swish(total), own], axis=2)

    n = wide + (channels if adds else 0)
    return Local(channels, n, (axis, axis), lambda h, w: (axis.length(h), axis.length(w)), work), n, wide, narrow


def gate(mean: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    hidden = mean @ weights["squeeze"]
    return sigmoid((hidden * sigmoid(hidden)) @ weights["excite"])


def bottleneck_whole(x: np.ndarray, weights: dict[str, np.ndarray], step: int = 1) -> np.ndarray:
    """``inverted_bottleneck`` of a whole image."""
    inner, n, wide, narrow = widened(weights, step)
    y = inner(x)
    if not y.size:
        return np.zeros((0, 0, narrow))
    out = (y[:, :, :wide] * gate(y[:, :, :wide].sum((0, 1)) / (y.shape[0] * y.shape[1]), weights)) @ weights["down"]
    return out + y[:, :, wide:] if n > wide else out


def gated(inner: DataFrame, weights: dict[str, np.ndarray], n: int, wide: int, narrow: int) -> DataFrame:
    """Strips of ``n`` channels, of which the first ``wide`` are gated and narrowed and the rest added."""
    schema = inner.schema

    def sums(batches):
        for batch in batches:
            x = batch.column(3)
            found = [np.asarray(v.values).reshape(-1, n)[:, :wide].sum(axis=0).tolist() for v in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64())), pa.array([len(v.values) // n for v in x], pa.int64())], ["image", "sums", "pixels"])

    kind = schema["image"].dataType.simpleString()
    parts = inner.mapInArrow(sums, f"image {kind}, sums array<double>, pixels long")
    total = parts.groupBy("image").agg(F.array(*(F.sum(F.get("sums", F.lit(c))) for c in range(wide))).alias("sums"), F.sum("pixels").alias("pixels"))
    means = total.select("image", F.transform("sums", lambda s: s / F.col("pixels")).alias("means"))

    def run(batches):
        for batch in batches:
            out = []
            for values, means in zip(batch.column(3), batch.column(4)):
                x, mean = np.asarray(values.values).reshape(-1, n), np.asarray(means.values)
                y = (x[:, :wide] * gate(mean, weights)) @ weights["down"]
                out.append((y + x[:, wide:] if n > wide else y).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.float64()))], ["image", "y", "x", "values"])

    return inner.join(means, inner["image"].eqNullSafe(means["image"])).select(inner["image"], "y", "x", "values", "means").mapInArrow(run, f"image {kind}, y long, x long, values array<double>")
