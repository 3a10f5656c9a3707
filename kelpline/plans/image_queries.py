"""Queries over scalograms as images: colours, resizing, convolutions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.columns import erf_sql, quantize_u8
from kelpline.operators import coding, images, normalize, wavelet
from kelpline.operators.groups import apart, placed
from kelpline.plans import series_queries
from kelpline.sources.sinks import recorded, write_by_label

#: Means and deviations of the three channels.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


#: Colours by level, and those as the networks get them.
COLOURS = np.array(images.levels(images.PURPLE_GREEN), "i4")
PIXELS = (COLOURS / 255.0 - np.array(MEAN)) / np.array(DEVIATION)


def powers(spark: SparkSession, d: str) -> DataFrame:
    """The scalograms of series of over ``images.WHOLE`` samples with the largest value ``top``: the transform is made once and written."""
    def write(path: str) -> None:
        long = apart(series_queries.scaled(spark, d), images.WHOLE)[1]
        wavelet.cwt_full(long).withColumn("most", F.array_max("power")).write.parquet(path)

    held = spark.read.parquet(recorded(spark, d, "scalograms", write))
    tops = held.select("series_id", "most")
    return held.drop("most").join(tops.groupBy("series_id").agg(F.max("most").alias("top")), "series_id")


def strips(spark: SparkSession, d: str) -> DataFrame:
    """Intensities of all scales of those series as images, scale 1 on top; a series without power is 0.5 throughout."""
    shown = F.transform("power", lambda p: F.coalesce(0.5 + F.try_divide(p, 2 * F.col("top")), F.lit(0.5)))
    return powers(spark, d).select(F.col("series_id").alias("image"), (F.col("scale") - 1).cast("long").alias("y"), (F.col("first") - 1).alias("x"), shown.alias("values"))


def rgb(spark: SparkSession, d: str) -> DataFrame:
    """Colour strips, bytes of three channels."""
    return strips(spark, d).withColumn("values", F.flatten(F.transform("values", lambda v: images.coloured(v))))


def over_scalograms(spark: SparkSession, d: str, body: Callable[[np.ndarray], dict], fields: str, rest: Callable[[], DataFrame]) -> DataFrame:
    """Image and ``fields`` that ``body`` makes of the intensities (scales by samples) of a series in the task that transforms it; of series that are too long for that, the rows of ``rest``."""
    def shown(power: np.ndarray) -> dict:
        top = power.max()
        return body(0.5 + power / (2 * top) if top else np.full(power.shape, 0.5))

    short, long = apart(series_queries.scaled(spark, d), images.WHOLE)
    found = wavelet.over_whole(short, 127, shown, fields).withColumnRenamed("series_id", "image")
    return found if long is None else found.unionByName(rest())


def as_strips(x: np.ndarray) -> dict:
    """Rows of a whole image."""
    return {"y": np.arange(len(x)), "x": np.zeros(len(x), "i8"), "values": wavelet.lists(x.reshape(len(x), x.shape[1] * x.shape[2]))}


def scalogram_rgb(spark, d):
    """Scalograms in colours, written below a directory for each label and read again: how often a row has each colour."""
    def body(x: np.ndarray) -> dict:
        return as_strips(COLOURS[images.coloured_whole(x)]) | {"whole": np.ones(len(x), bool)}

    def write(path: str) -> None:
        drawn = over_scalograms(spark, d, body, "y long, x long, values array<int>, whole boolean", lambda: rgb(spark, d).withColumn("whole", F.lit(False)))
        write_by_label(drawn.withColumn("label", F.pmod("image", F.lit(6))), path, labels=6)

    held = spark.read.parquet(recorded(spark, d, "rgb", write))
    counted = images.colour_counts(held.select(F.col("label").cast("long").alias("label"), F.col("image").alias("series_id"), (F.col("y") + 1).cast("int").alias("scale"), "values", "whole"), ["label", "series_id", "scale", "whole"])
    # A row that is one strip is counted in full; the parts of others meet.
    parts = counted.filter("NOT whole").groupBy("label", "series_id", "scale", "r", "g", "b").agg(F.sum("n").alias("n"))
    return counted.filter("whole").drop("whole").unionByName(parts)


def edges(strips: DataFrame) -> DataFrame:
    """Of each row of an image: its length, first and last value, and sum. Of a strip only these go to where its row is put together."""
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v)
    ends = strips.select("image", "y", "x", F.size("values").cast("long").alias("n"), F.get("values", F.lit(0)).alias("a"), F.element_at("values", -1).alias("b"), total.alias("total"))
    return ends.groupBy("image", "y").agg(F.sum("n").alias("n"), F.min_by("a", "x").alias("first"), F.max_by("b", "x").alias("last"), F.sum("total").alias("total"))


def edge_rows(x: np.ndarray) -> dict:
    """The same of a whole image of one channel."""
    x = x[:, :, 0]
    return {"y": np.arange(len(x)), "n": np.full(len(x), x.shape[1]), "first": x[:, 0], "last": x[:, -1], "total": x.sum(1)}


def edges_of(spark: SparkSession, d: str, body: Callable[[np.ndarray], np.ndarray], rest: Callable[[], DataFrame]) -> DataFrame:
    rows = over_scalograms(spark, d, lambda x: edge_rows(body(x[:, :, None])), "y long, n long, first double, last double, total double", lambda: edges(rest()))
    return rows.select(F.col("image").alias("series_id"), "y", "n", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), F.round("total", 5).alias("total"))


def image_resize(spark, d):
    """Scalograms at 224 by 224, linear between neighbours."""
    square = images.resizing(lambda h, w: (224, 224))
    return edges_of(spark, d, square, lambda: square.over(strips(spark, d)))


def image_letterbox(spark, d):
    """Scalograms in proportion in the middle of squares of 96, by a windowed sinc."""
    fit = images.resizing(images.fitted(96), reach=3)
    return edges_of(spark, d, lambda x: images.pasted_whole(fit(x), 96), lambda: images.pasted(fit.over(strips(spark, d)), 96))


def fixed(*shape: int) -> np.ndarray:
    """Fixed weights: (3 i + 2) % 7 - 3 tenths by place."""
    return (((3 * np.arange(int(np.prod(shape))) + 2) % 7 - 3) / 10).reshape(shape)


#: Patches of 4 by 4 pixels of coloured scalograms as 4 channels, and the block and the halving that follow in the convolutional model.
PATCHES = images.convolution(fixed(4, 4, 3, 4), np.arange(4) / 10, step=4)
BLOCK = images.residual(fixed(7, 7, 4), np.arange(4) / 10, fixed(4, 8), fixed(8, 4), scale=1.0)
HALVING = images.convolution(fixed(2, 2, 4, 8), np.zeros(8), step=2)


def stem(spark: SparkSession, d: str) -> DataFrame:
    """Patches of long series."""
    pixels = F.transform("values", lambda v, i: (v / 255.0 - F.element_at(F.array(*map(F.lit, MEAN)), i % 3 + 1)) / F.element_at(F.array(*map(F.lit, DEVIATION)), i % 3 + 1))
    return PATCHES.over(rgb(spark, d).withColumn("values", pixels))


def by_pixel(strips: DataFrame, channels: int) -> DataFrame:
    out = strips.select(F.col("image").alias("series_id"), "y", "x", F.posexplode("values").alias("i", "v"))
    return out.select("series_id", "y", (F.col("x") + F.floor(F.col("i") / float(channels))).cast("long").alias("x"), (F.col("i") % channels).alias("channel"), F.round("v", 5).alias("v"))


def on_patches(spark: SparkSession, d: str, body: Callable[[np.ndarray], np.ndarray], rest: Callable[[DataFrame], DataFrame], channels: int) -> DataFrame:
    """Values by pixel of ``body`` of whole images of patches, and of ``rest`` of their strips, with fixed weights."""
    whole = lambda x: as_strips(body(PATCHES(PIXELS[images.coloured_whole(x)])))
    return by_pixel(over_scalograms(spark, d, whole, "y long, x long, values array<double>", lambda: rest(stem(spark, d))), channels)


def convnext_stem(spark, d):
    """Stem, one block and a halving of the convolutional model on coloured scalograms: 8 channels."""
    return on_patches(spark, d, lambda x: HALVING(BLOCK(x)), lambda s: HALVING.over(BLOCK.over(s)), 8)


def window_attention(spark, d):
    """Attention in windows of 7 by 7 patches that are shifted by 3, two heads, added to the patches."""
    weights = {name: fixed(4, 4) * by for name, by in (("q", 1.0), ("k", -1.0), ("v", 2.0), ("out", 1.0))} | {"bias": fixed(169, 2)}
    return on_patches(spark, d, lambda x: images.window_whole(x, weights, 2, shift=3), lambda s: images.window_block(s, weights, heads=2, shift=3), 4)


def patch_merging(spark, d):
    """Two by two patches as one of 8 channels."""
    merging = images.merging(fixed(16, 8))
    return on_patches(spark, d, merging, merging.over, 8)


def squeeze_excite(spark, d):
    """An inverted bottleneck with a gate for each channel, on the patches."""
    weights = {"up": fixed(4, 8), "around": fixed(3, 3, 8), "squeeze": fixed(8, 2), "excite": fixed(2, 8), "down": fixed(8, 4)}
    return on_patches(spark, d, lambda x: images.bottleneck_whole(x, weights), lambda s: images.inverted_bottleneck(s, weights), 4)


def matrices(spark: SparkSession, d: str) -> DataFrame:
    """The matrices of time, scaled value and ratio of every series, as byte images of three columns."""
    rows = placed(normalize.ratio(series_queries.scaled(spark, d)))
    return rows.select(F.col("series_id").alias("image"), (F.col("n") - 1).alias("y"), F.lit(0).alias("x"), F.array(*(quantize_u8(F.col(c)).cast("int") for c in ("t", "scaled", "ratio"))).alias("values"))


def block_coding(spark, d):
    """Blocks of the matrices as runs of coefficients, and how far decoding is off at most."""
    cut = coding.blocks(matrices(spark, d))
    code = coding.coded(cut)
    back = coding.decoded(code).select("image", "block_y", "block_x", F.col("pixels").alias("again"))
    off = F.array_max(F.zip_with("pixels", "again", lambda a, b: F.abs(a - b)))
    met = code.join(cut.select("image", "block_y", "block_x", "pixels"), ["image", "block_y", "block_x"]).join(back, ["image", "block_y", "block_x"])
    text = F.array_join(F.transform("code", lambda r: F.concat_ws(":", r["run"].cast("string"), r["value"].cast("string"))), " ")
    return met.select(F.col("image").alias("series_id"), "block_y", "block_x", text.alias("code"), F.round(off, 4).alias("off"))


QUERIES = {f.__name__: f for f in (scalogram_rgb, image_resize, image_letterbox, convnext_stem, window_attention, patch_merging, squeeze_excite, block_coding)}

# Intensities as an image i: series_id, y, x, v, with the height h and width w.
I = series_queries.S + series_queries.ALL + """, i AS (SELECT series_id, scale::BIGINT - 1 AS y, n - 1 AS x, coalesce(0.5 + power / nullif(2 * max(power) OVER (PARTITION BY series_id), 0), 0.5) AS v,
  127 AS h, max(n) OVER (PARTITION BY series_id) AS w FROM w)"""
# A column of anchors for each channel, from the hexadecimal colours.
ANCHORS = ", ".join(f"[{', '.join(str(int(a[c : c + 2], 16)) for a in images.PURPLE_GREEN)}] AS a{c // 2}" for c in (0, 2, 4))
COLOUR = "floor(a{c}[least(k * 10 // 255, 9) + 1] + (a{c}[least(k * 10 // 255, 9) + 2] - a{c}[least(k * 10 // 255, 9) + 1]) * (k * 10 / 255::DOUBLE - least(k * 10 // 255, 9)) + 1e-9)::INT"
RGB = f", c AS (SELECT k, {', '.join(f'{COLOUR.format(c=c)} AS {n}' for c, n in enumerate('rgb'))} FROM range(256) l(k), (SELECT {ANCHORS})), p AS (SELECT i.*, r, g, b FROM i JOIN c ON k = least(255, greatest(0, floor(v * 256)))::BIGINT)"


def weights_sql(name: str, of: str, n: str, m: str, reach: int) -> str:
    """Weights of resizing along an axis: n, m, o (result), j (value), k (weight)."""
    wide, at = f"greatest(n / m::DOUBLE, 1)", f"((j + 0.5 - (o + 0.5) * n / m::DOUBLE) / greatest(n / m::DOUBLE, 1))"
    sinc = lambda z: f"CASE WHEN {z} = 0 THEN 1 ELSE sin(pi() * {z}) / (pi() * {z}) END"
    kernel = f"greatest(1 - abs({at}), 0)" if reach == 1 else f"({sinc(at)}) * ({sinc(f'({at} / {reach})')})"
    return f""", {name}0 AS (SELECT n, m, o, unnest(range(greatest(0, floor((o + 0.5) * n / m - {reach} * {wide})::BIGINT), least(n, ceil((o + 0.5) * n / m + {reach} * {wide})::BIGINT + 1))) AS j
        FROM (SELECT n, m, unnest(range(m)) AS o FROM (SELECT DISTINCT {n}::BIGINT AS n, {m}::BIGINT AS m FROM {of}))),
      {name}1 AS (SELECT *, CASE WHEN abs({at}) < {reach} THEN {kernel} ELSE 0 END AS k FROM {name}0), {name} AS (SELECT n, m, o, j, k / sum(k) OVER (PARTITION BY n, m, o) AS k FROM {name}1)"""


def resize_sql(high: str, wide: str, reach: int) -> str:
    """Resized images z: series_id, y, x, v, high, wide."""
    sizes = f", s2 AS (SELECT *, {high} AS high, {wide} AS wide FROM i)"
    down = ", zy AS (SELECT series_id, ky.o AS y, x, w, high, wide, sum(v * k) AS v FROM s2 JOIN ky ON ky.n = h AND ky.m = high AND ky.j = y AND k <> 0 GROUP BY ALL)"
    across = ", z AS (SELECT series_id, y, kx.o AS x, high, wide, sum(v * k) AS v FROM zy JOIN kx ON kx.n = w AND kx.m = wide AND kx.j = x AND k <> 0 GROUP BY ALL)"
    return sizes + weights_sql("ky", "s2", "h", "high", reach) + weights_sql("kx", "s2", "w", "wide", reach) + down + across


EDGES = " SELECT series_id, y::BIGINT AS y, count(*)::BIGINT AS n, round(arg_min(v, x), 6) AS first, round(arg_max(v, x), 6) AS last, round(sum(v), 5) AS total FROM {} GROUP BY ALL"
FIX = "((3 * ({}) + 2) % 7 - 3) / 10::DOUBLE"
STEM = f""", q AS (SELECT series_id, y, x, unnest([0, 1, 2]) AS c, unnest([{', '.join(f'({n} / 255::DOUBLE - {m}) / {s}' for n, m, s in zip('rgb', MEAN, DEVIATION))}]) AS v, h, w FROM p),
  s0 AS (SELECT series_id, y // 4 AS y, x // 4 AS x, o, any_value(o) / 10::DOUBLE + sum(v * {FIX.format('((y % 4 * 4 + x % 4) * 3 + c) * 4 + o')}) AS v, any_value(h) // 4 AS h, any_value(w) // 4 AS w
    FROM q, (SELECT unnest(range(4)) AS o) WHERE y // 4 < h // 4 AND x // 4 < w // 4 GROUP BY ALL)"""
CONVNEXT = f""",
  s1 AS (SELECT a.series_id, a.y, a.x, a.o, any_value(a.v) AS own, a.o / 10::DOUBLE + sum(b.v * {FIX.format('((b.y - a.y + 3) * 7 + b.x - a.x + 3) * 4 + a.o')}) AS v, any_value(a.h) AS h, any_value(a.w) AS w
    FROM s0 a JOIN s0 b ON a.series_id = b.series_id AND a.o = b.o AND abs(b.y - a.y) <= 3 AND abs(b.x - a.x) <= 3 GROUP BY a.series_id, a.y, a.x, a.o),
  s2 AS (SELECT *, (v - avg(v) OVER k) / sqrt(var_pop(v) OVER k + 1e-6) AS z FROM s1 WINDOW k AS (PARTITION BY series_id, y, x)),
  s3 AS (SELECT series_id, y, x, u, sum(z * {FIX.format('o * 8 + u')}) / sqrt(2) AS t FROM s2, (SELECT unnest(range(8)) AS u) GROUP BY ALL),
  s4 AS (SELECT series_id, y, x, u, 0.5 * t * sqrt(2) * (1 + {erf_sql('t')}) AS t FROM s3),
  s5 AS (SELECT series_id, y, x, o, sum(t * {FIX.format('u * 4 + o')}) AS add FROM s4, (SELECT unnest(range(4)) AS o) GROUP BY ALL),
  s6 AS (SELECT series_id, y, x, o, own + add AS v, h, w FROM s2 JOIN s5 USING (series_id, y, x, o))
  SELECT series_id, (y // 2)::BIGINT AS y, (x // 2)::BIGINT AS x, e::INT AS channel, round(sum(v * {FIX.format('((y % 2 * 2 + x % 2) * 4 + o) * 8 + e')}), 5) + 0.0 AS v
    FROM s6, (SELECT unnest(range(8)) AS e) WHERE y // 2 < h // 2 AND x // 2 < w // 2 GROUP BY ALL"""
# Tokens by series, y, x with lists q, k, v of their channels; a window's pairs meet by an equal join, regions and all.
LINEAR = "list_transform(range({n}), lambda j: list_sum(list_transform(range({m}), lambda i: {x}[i + 1] * " + FIX.format("i * {n} + j") + ")))"
ATTENTION = f""", t AS (SELECT series_id, y, x, any_value(h) AS h, any_value(w) AS w, list(v ORDER BY o) AS f FROM s0 GROUP BY ALL),
  n AS (SELECT *, list_transform(f, lambda c: (c - list_avg(f)) / sqrt(list_var_pop(f) + 1e-6)) AS z FROM t),
  u AS (SELECT series_id, y, x, f, (y - 3 + h) % h AS ay, (x - 3 + w) % w AS ax, y < 3 AS ry, x < 3 AS rx, {LINEAR.format(n=4, m=4, x='z')} AS l FROM n),
  p2 AS (SELECT a.series_id, a.y, a.x, a.f, b.l AS v, e, (a.l[2 * e + 1] * -b.l[2 * e + 1] + a.l[2 * e + 2] * -b.l[2 * e + 2]) / sqrt(2) + {FIX.format('((a.ay - b.ay + 6) * 13 + a.ax - b.ax + 6) * 2 + e')} AS s
    FROM u a JOIN u b ON a.series_id = b.series_id AND a.ay // 7 = b.ay // 7 AND a.ax // 7 = b.ax // 7 AND a.ry = b.ry AND a.rx = b.rx, (SELECT unnest(range(2)) AS e)),
  e2 AS (SELECT *, exp(s - max(s) OVER (PARTITION BY series_id, y, x, e)) AS g FROM p2),
  o2 AS (SELECT series_id, y, x, e, any_value(f) AS f, sum(g * 2 * v[2 * e + 1]) / sum(g) AS a, sum(g * 2 * v[2 * e + 2]) / sum(g) AS b FROM e2 GROUP BY ALL),
  h2 AS (SELECT series_id, y, x, any_value(f) AS f, flatten(list([a, b] ORDER BY e)) AS c FROM o2 GROUP BY ALL),
  z2 AS (SELECT *, {LINEAR.format(n=4, m=4, x='c')} AS d FROM h2)
  SELECT series_id, y::BIGINT AS y, x::BIGINT AS x, unnest(range(4))::INT AS channel, round(unnest(list_transform(range(4), lambda i: f[i + 1] + d[i + 1])), 5) + 0.0 AS v FROM z2"""
SWISH = "{0} / (1 + exp(-({0})))"
GATE = f""", t AS (SELECT series_id, y, x, list(v ORDER BY o) AS f FROM s0 GROUP BY ALL),
  u0 AS (SELECT series_id, y, x, unnest(range(8)) AS c, unnest({LINEAR.format(n=8, m=4, x='f')}) AS v FROM t), u AS (SELECT * EXCLUDE (v), {SWISH.format('v')} AS v FROM u0),
  a0 AS (SELECT a.series_id, a.y, a.x, a.c, sum(b.v * {FIX.format('((b.y - a.y + 1) * 3 + b.x - a.x + 1) * 8 + a.c')}) AS v
    FROM u a JOIN u b ON a.series_id = b.series_id AND a.c = b.c AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.series_id, a.y, a.x, a.c), a AS (SELECT * EXCLUDE (v), {SWISH.format('v')} AS v FROM a0),
  m0 AS (SELECT series_id, c, avg(v) AS m FROM a GROUP BY ALL), mm AS (SELECT series_id, list(m ORDER BY c) AS m FROM m0 GROUP BY ALL),
  g0 AS (SELECT series_id, list_transform({LINEAR.format(n=2, m=8, x='m')}, lambda z: {SWISH.format('z')}) AS z FROM mm), g AS (SELECT series_id, list_transform({LINEAR.format(n=8, m=2, x='z')}, lambda z: 1 / (1 + exp(-z))) AS g FROM g0),
  d AS (SELECT series_id, y, x, o, sum(v * g[c + 1] * {FIX.format('c * 4 + o')}) AS v FROM a JOIN g USING (series_id), (SELECT unnest(range(4)) AS o) GROUP BY ALL)
  SELECT series_id, y::BIGINT AS y, x::BIGINT AS x, o::INT AS channel, round(d.v + s0.v, 5) + 0.0 AS v FROM d JOIN s0 USING (series_id, y, x, o)"""
FIT = "greatest(1, floor({} * least(96 / w::DOUBLE, 96 / h::DOUBLE)))::BIGINT"
BYTES = ", ".join(f"{series_queries.U8.format(x=x)} AS u{i}" for i, x in enumerate(("t", "scaled", "(t / nullif(scaled, 0))")))
TABLE = ", ".join(map(str, coding.steps().ravel().tolist()))
BLOCKS = series_queries.S + f""", u AS (SELECT series_id, n, max(n) OVER (PARTITION BY series_id) AS rows, {BYTES} FROM m),
  g AS (SELECT series_id, rows, unnest(range((rows + 7) // 8 * 8)) AS y FROM (SELECT DISTINCT series_id, rows FROM u)),
  x AS (SELECT g.series_id, y // 8 AS block_y, y % 8 AS y, unnest(range(8)) AS x, [u0, u1, u2] AS p FROM g JOIN u ON u.series_id = g.series_id AND u.n = least(y, g.rows - 1) + 1),
  pix AS (SELECT series_id, block_y, y, x, p[least(x, 2) + 1] AS p FROM x),
  k AS (SELECT unnest(range(8)) AS f), kk AS (SELECT a.f AS u, b.f AS v, row_number() OVER (ORDER BY a.f + b.f, CASE WHEN (a.f + b.f) % 2 = 1 THEN a.f ELSE -a.f END) - 1 AS z, [{TABLE}][a.f * 8 + b.f + 1] AS q FROM k a, k b),
  c0 AS (SELECT series_id, block_y, u, v, z, q, sum((p - 128) * cos((2 * y + 1) * u * pi() / 16) * cos((2 * x + 1) * v * pi() / 16)) * any_value(CASE WHEN u = 0 THEN sqrt(0.5) ELSE 1 END * CASE WHEN v = 0 THEN sqrt(0.5) ELSE 1 END) / 4 AS c
    FROM pix, kk GROUP BY ALL),
  c AS (SELECT *, round_even(round(c, 6) / q, 0)::INT AS value FROM c0),
  r AS (SELECT *, z - coalesce(lag(z) OVER (PARTITION BY series_id, block_y ORDER BY z), -1) - 1 AS run FROM c WHERE value <> 0),
  t AS (SELECT series_id, block_y, string_agg(run || ':' || value, ' ' ORDER BY z) AS code FROM r GROUP BY ALL),
  b AS (SELECT pix.series_id, pix.block_y, y, x, any_value(p) AS p, 128 + sum(value * q * cos((2 * y + 1) * u * pi() / 16) * cos((2 * x + 1) * v * pi() / 16) * CASE WHEN u = 0 THEN sqrt(0.5) ELSE 1 END * CASE WHEN v = 0 THEN sqrt(0.5) ELSE 1 END) / 4 AS again
    FROM pix JOIN c USING (series_id, block_y) GROUP BY ALL)
  SELECT series_id, block_y::BIGINT AS block_y, 0::BIGINT AS block_x, coalesce(any_value(code), '') AS code, round(max(abs(p - again)), 4) AS off FROM b LEFT JOIN t USING (series_id, block_y) GROUP BY ALL"""
ORACLES = {
    "block_coding": BLOCKS,
    "scalogram_rgb": I + RGB + " SELECT series_id % 6 AS label, series_id, (y + 1)::INT AS scale, r, g, b, count(*) AS n FROM p GROUP BY ALL",
    "image_resize": I + resize_sql("224", "224", 1) + EDGES.format("z"),
    "image_letterbox": I + resize_sql(FIT.format("h"), FIT.format("w"), 3) + """, f AS (SELECT series_id, y + (96 - high) // 2 AS y, x + (96 - wide) // 2 AS x, v FROM z),
        g AS (SELECT series_id, y, x, coalesce(v, 0) AS v FROM (SELECT DISTINCT series_id, unnest(range(96)) AS y FROM f) JOIN (SELECT unnest(range(96)) AS x) ON true LEFT JOIN f USING (series_id, y, x))""" + EDGES.format("g"),
    "convnext_stem": I + RGB + STEM + CONVNEXT,
    "window_attention": I + RGB + STEM + ATTENTION,
    "patch_merging": I + RGB + STEM + f""", pm AS (SELECT *, x % 2 * 8 + y % 2 * 4 + o AS c, (v - avg(v) OVER k) / sqrt(var_pop(v) OVER k + 1e-6) AS z FROM s0 WHERE y // 2 < h // 2 AND x // 2 < w // 2
          WINDOW k AS (PARTITION BY series_id, y // 2, x // 2))
        SELECT series_id, (y // 2)::BIGINT AS y, (x // 2)::BIGINT AS x, e::INT AS channel, round(sum(z * {FIX.format('c * 8 + e')}), 5) + 0.0 AS v FROM pm, (SELECT unnest(range(8)) AS e) GROUP BY ALL""",
    "squeeze_excite": I + RGB + STEM + GATE,
}
