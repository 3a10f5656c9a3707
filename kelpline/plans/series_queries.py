"""Queries over series: scans, scaling, features, wavelets, convolution and pooling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.columns import quantize_u8, relu
from kelpline.operators import normalize, sequence, wavelet
from kelpline.operators.groups import LONG, apart, long_series, placed, with_aggregates
from kelpline.sources.sinks import image_name, scratch, write_curves
from kelpline.sources.tables import CLASSES, curve_tables, features, positional, series, table, wide_csv
from kelpline.streaming.windows import window_stats

SCALES = (1, 2, 4, 8, 16)
KERNEL = (0.25, 0.5, -0.25)
#: Samples up to which a task may hold a series with all its scales.
SHORT = 1 << 14

S = """WITH s AS (SELECT user_id AS series_id, event_id, event_type, value,
  date_diff('microsecond', min(ts) OVER (PARTITION BY user_id), ts) / 8.64e10 AS t FROM events),
m AS (SELECT *, (value - min(value) OVER p) / nullif(max(value) OVER p - min(value) OVER p, 0) AS scaled,
  row_number() OVER (PARTITION BY series_id ORDER BY t, event_id) AS n FROM s WINDOW p AS (PARTITION BY series_id)) """


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.minmax(series(spark, sf_dir))


def r6(name: str, out: str | None = None):
    return F.round(F.col(name), 6).alias(out or name)


def scan_series(spark, d):
    return series(spark, d).select("series_id", "event_id", r6("t"), "value")


def scan_features(spark, d):
    rows = features(spark, d)
    return rows.select("id", "label", F.size("features").alias("width"), F.posexplode("features").alias("place", "x")).withColumn("x", r6("x"))


def scan_curves(spark, d):
    """Events as CSV files by class directory, read in one scan into labelled, scaled curves."""
    folder = scratch(spark, "curves")
    names = F.array(*map(F.lit, CLASSES))
    write_curves(series(spark, d).withColumn("class", F.get(names, F.pmod("series_id", F.lit(len(CLASSES))).cast("int"))), folder)
    read = normalize.minmax(curve_tables(spark, folder))
    return read.select("label", "series_id", r6("t"), "value", r6("scaled"))


def scan_wide(spark, d):
    """Features as one wide CSV table, as wide as its longest row, read by position; the whole row comes back."""
    folder, rows = scratch(spark, "wide"), features(spark, d)
    width = rows.agg(F.max(F.size("features"))).first()[0] or 0
    rows.select("label", *(F.get("features", F.lit(i)).alias(f"flux{i}") for i in range(width))).write.option("header", True).csv(folder)
    return wide_csv(spark, folder, width).select("label", *(F.round(F.col("features")[i], 6).alias(f"x{i}") for i in range(width)))


def label_encode(spark, d):
    kinds = F.create_map(*(F.lit(x) for i, k in enumerate(("click", "error", "purchase", "signup", "view")) for x in (k, i)))
    return series(spark, d).select("event_id", "event_type", F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit(-1)).alias("label"))


def project_positional(spark, d):
    return positional(table(spark, d, "events"), 0, 4)


def project_features(spark, d):
    """Label and features apart, by position."""
    rows = positional(table(spark, d, "embeddings"), 0, 2, 1)
    return rows.select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("place", "x")).withColumn("x", r6("x"))


def series_minmax(spark, d):
    return series(spark, d).groupBy("series_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def series_extent(spark, d):
    return series(spark, d).groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).withColumn("extent", F.round(F.col("n") * 0.02, 6))


def minmax_normalize(spark, d):
    return scaled(spark, d).select("series_id", "event_id", r6("scaled"))


def ratio_feature(spark, d):
    return normalize.ratio(scaled(spark, d)).select("series_id", "event_id", r6("scaled"), r6("ratio"))


def stack_features(spark, d):
    rows = normalize.ratio(scaled(spark, d)).withColumn("m", F.array("t", "scaled", "ratio"))
    return rows.select("event_id", F.size("m").alias("width"), F.round(F.col("m")[0], 6).alias("m0"), F.round(F.col("m")[1], 6).alias("m1"), F.round(F.col("m")[2], 6).alias("m2"))


def quantize(spark, d):
    rows = normalize.ratio(scaled(spark, d))
    held = F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair))
    label = F.get(F.map_values(held), F.pmod("series_id", F.lit(len(CLASSES))).cast("int"))
    return rows.select("event_id", image_name(label, F.concat(F.col("series_id").cast("string"), F.lit(".csv"))).alias("file"), *(quantize_u8(F.col(c)).cast("int").alias(o) for c, o in (("t", "u0"), ("scaled", "u1"), ("ratio", "u2"))))


def cwt_power(spark, d):
    return wavelet.cwt_power(scaled(spark, d), SCALES).select("series_id", "n", "scale", F.round("power", 5).alias("power"))


def cwt_full(spark, d):
    power = wavelet.cwt_full(scaled(spark, d))
    return power.groupBy("series_id", "scale").agg(F.sum(F.size("power")).alias("n"), F.round(F.max(F.array_max("power")), 5).alias("top"))


def cwt_freqs(spark, d):
    scales = spark.range(1, 128).select(F.col("id").cast("int").alias("scale"))
    return wavelet.frequencies(scales).select("scale", r6("freq"), r6("freq_hz"))


def scalogram_intensity(spark, d):
    """Power of all 127 scales against the largest of the series.

    A task that holds a series whole knows its largest value. The transform of longer series is
    written once, for that value is needed before the rest.
    """
    short, long = apart(scaled(spark, d), SHORT)

    def body(power: np.ndarray) -> dict:
        n = len(power)
        return {"first": np.ones(n, "i8"), "scale": np.arange(1, n + 1, dtype="i4"), "top": np.full(n, power.max()), "power": wavelet.lists(power)}

    topped = wavelet.over_whole(short, 127, body, "first long, scale int, top double, power array<double>")
    if long is not None:
        folder = scratch(spark, "scalograms")
        wavelet.cwt_full(long).withColumn("most", F.array_max("power")).write.parquet(folder)
        topped = topped.unionByName(with_aggregates(spark.read.parquet(folder), "series_id", top=F.max("most")).drop("most"))
    each = topped.select("series_id", "first", "scale", "top", F.posexplode("power").alias("i", "p"))
    shown = 0.5 + F.try_divide(F.col("p"), 2 * F.col("top"))
    return each.select("series_id", (F.col("first") + F.col("i")).alias("n"), "scale", F.round(shown, 4).alias("intensity"))


def conv1d_relu(spark, d):
    return sequence.conv1d_relu(series(spark, d), KERNEL, 0.1).select("event_id", r6("y"))


def maxpool1d(spark, d):
    return sequence.maxpool1d(series(spark, d)).select("series_id", F.col("place").cast("long").alias("place"), "pooled")


def stack_weights(n_in: int, n_out: int) -> tuple[list, list[float]]:
    """Fixed weights and biases of a convolution."""
    w = [[[((5 * o + 3 * c + 2 * t) % 7 - 3) / 10 for t in range(3)] for c in range(n_in)] for o in range(n_out)]
    return w, [(o % 3 - 1) / 10 for o in range(n_out)]


def convolved(spark: SparkSession, d: str, first: int = 2) -> DataFrame:
    """Three convolutions with ReLU, of ``first``, 2 and 4 times as many channels, the first two pooled: series_id, t, event_id, x (array)."""
    x = scaled(spark, d).select("series_id", "t", "event_id", F.array(F.coalesce("scaled", F.lit(0.0))).alias("x"))
    # Asked once, of the table: no layer makes a series longer.
    most = None if long_series(series(spark, d)).isEmpty() else LONG
    n_in = 1
    for n_out in (first, 2 * first):
        y = sequence.maxpool1d_channels(sequence.conv1d_channels(x, *stack_weights(n_in, n_out), most=most), most=most)
        x, n_in = y.select("series_id", F.col("place").cast("double").alias("t"), F.col("place").alias("event_id"), F.col("pooled").alias("x")), n_out
    last = sequence.conv1d_channels(x, *stack_weights(n_in, 4 * first), most=most)
    return last.select("series_id", "t", "event_id", F.col("y").alias("x"))


def conv_stack(spark, d):
    """The convolutions of the sequence models."""
    rows = convolved(spark, d).select("series_id", F.col("event_id").cast("long").alias("place"), F.posexplode("x").alias("channel", "y"))
    return rows.withColumn("y", r6("y"))


def last_step(spark, d):
    return sequence.last_step(series(spark, d))


def attention_pool(spark, d):
    pooled = sequence.attention_pool(scaled(spark, d), 2.0 * F.col("scaled") - 0.5, "scaled", F.tanh)
    return pooled.select("series_id", r6("pooled"), r6("top_weight"))


def attention_vectors(spark, d):
    """Attention over the vectors that the convolutions give at each step."""
    pooled = sequence.attention_vectors(convolved(spark, d), [(3 * i % 5 - 2) / 5 for i in range(8)])
    return pooled.select("series_id", r6("top_weight"), F.posexplode("pooled").alias("channel", "x")).withColumn("x", r6("x"))


def lstm_forward(spark, d):
    """Output at the last step of two bidirectional layers after the convolutions, all of it."""
    steps = sequence.bilstm(convolved(spark, d), hidden=8, layers=2)
    ends = steps.groupBy("series_id").agg(F.sum(F.size("steps")).cast("int").alias("n_steps"), F.max_by(F.element_at("steps", -1), "block").alias("end"))
    last = ends.select("series_id", "n_steps", F.posexplode("end").alias("place", "h"))
    return last.withColumn("h", r6("h"))


def transpose_matrix(spark, d):
    """Series by step into step by series: what one step holds over all series."""
    rows = placed(scaled(spark, d))
    return rows.groupBy(F.col("n").cast("int").alias("n")).agg(F.count(F.lit(1)).alias("series"), F.round(F.sum("scaled"), 5).alias("total"))


def global_avg_pool(spark, d):
    """Each feature vector as 8 channels of 8 values, averaged per channel."""
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    return rows.groupBy("vec_id", F.floor(F.col("i") / 8.0).cast("int").alias("channel")).agg(F.round(F.avg("x"), 6).alias("pooled"))


def residual_add(spark, d):
    """A scaled convolution block added to its input."""
    return sequence.conv1d_relu(series(spark, d), KERNEL).select("event_id", F.round(F.col("value") + 1e-6 * relu(F.col("y")), 6).alias("y"))


def survey_windows(spark, d):
    """The streaming extension's aggregate, over the table."""
    stats = window_stats(table(spark, d, "events"))
    return stats.select(F.unix_timestamp("began").alias("began_s"), "event_type", "n", "low", "high", r6("mean"))


QUERIES = {f.__name__: f for f in (scan_series, scan_features, label_encode, project_positional, project_features, series_minmax, series_extent, minmax_normalize, ratio_feature, stack_features, scan_curves, scan_wide, cwt_power, cwt_full, cwt_freqs, scalogram_intensity, conv1d_relu, maxpool1d, conv_stack, last_step, attention_pool, attention_vectors, lstm_forward, transpose_matrix, global_avg_pool, residual_add, survey_windows)}
QUERIES["quantize_u8"] = quantize

W = """, k AS (SELECT unnest({scales}) AS scale),
w AS (SELECT a.series_id, a.n, k.scale,
    abs(sum(coalesce(b.scaled, 0) * exp(0 - (((b.n - a.n) / k.scale::DOUBLE) ** 2) / 2) * cos(5 * (b.n - a.n) / k.scale::DOUBLE))) / sqrt(any_value(k.scale)) AS power
  FROM m a CROSS JOIN k JOIN m b ON b.series_id = a.series_id AND b.n BETWEEN a.n - 8 * k.scale AND a.n + 8 * k.scale GROUP BY a.series_id, a.n, k.scale) """
FEW, ALL = W.format(scales=list(SCALES)), W.format(scales="range(1, 128)")


def conv_sql(name: str, of: str, n_in: int, n_out: int) -> str:
    """A convolution with the weights of ``stack_weights``, in SQL: series_id, n, x."""
    none = f"list_transform(range({n_in}), lambda i: 0::DOUBLE)"
    near = f"SELECT series_id, n, list_concat(coalesce(lag(x) OVER w, {none}), x, coalesce(lead(x) OVER w, {none})) AS z FROM {of} WINDOW w AS (PARTITION BY series_id ORDER BY n)"
    product = f"z[i + 1] * ((5 * o + 3 * (i % {n_in}) + 2 * (i // {n_in})) % 7 - 3) / 10::DOUBLE"
    sums = f"list_transform(range({n_out}), lambda o: greatest(list_sum(list_transform(range({3 * n_in}), lambda i: {product})) + (o % 3 - 1) / 10::DOUBLE, 0))"
    return f", {name} AS (SELECT series_id, n, {sums} AS x FROM ({near}))"


def pool_sql(name: str, of: str) -> str:
    """Pairs of rows, the larger value of each channel."""
    return f", {name} AS (SELECT a.series_id, (a.n + 1) // 2 AS n, list_transform(list_zip(a.x, b.x), lambda p: greatest(p[1], p[2])) AS x FROM {of} a JOIN {of} b ON a.series_id = b.series_id AND b.n = a.n + 1 WHERE a.n % 2 = 1)"


STACK = S + ", x0 AS (SELECT series_id, n, [coalesce(scaled, 0)] AS x FROM m)" + conv_sql("y1", "x0", 1, 2) + pool_sql("x1", "y1") + conv_sql("y2", "x1", 2, 4) + pool_sql("x2", "y2") + conv_sql("y3", "x2", 4, 8)
Y = "0.25 * coalesce(lag({v}) OVER o, 0) + 0.5 * {v} - 0.25 * coalesce(lead({v}) OVER o, 0)"
O = "WINDOW o AS (PARTITION BY series_id ORDER BY t, event_id)"
U8 = "CASE WHEN {x} IS NULL OR isnan({x}) THEN 0 ELSE round_even(greatest(0.0, least(255.0, {x}))::DOUBLE, 0)::INT END"
ORACLES = {
    "scan_series": S + "SELECT series_id, event_id, round(t, 6) AS t, value FROM s",
    "scan_features": "SELECT vec_id AS id, label, len(embedding)::INT AS width, (generate_subscripts(embedding, 1) - 1)::INT AS place, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings",
    "scan_curves": S + "SELECT (series_id % 6)::INT AS label, series_id, round(t, 6) AS t, value, round(scaled, 6) AS scaled FROM m",
    "scan_wide": "SELECT label, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS x{i}" for i in range(64)) + " FROM embeddings",
    "label_encode": "SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE -1 END AS label FROM events",
    "project_positional": "SELECT event_id, value FROM events",
    "project_features": "SELECT vec_id, label, (generate_subscripts(embedding, 1) - 1)::INT AS place, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings",
    "series_minmax": "SELECT user_id AS series_id, min(value) AS low, max(value) AS high FROM events GROUP BY 1",
    "series_extent": "SELECT user_id AS series_id, count(*) AS n, round(count(*) * 0.02, 6)::DOUBLE AS extent FROM events GROUP BY 1",
    "minmax_normalize": S + "SELECT series_id, event_id, round(scaled, 6) AS scaled FROM m",
    "ratio_feature": S + "SELECT series_id, event_id, round(scaled, 6) AS scaled, round(t / nullif(scaled, 0), 6) AS ratio FROM m",
    "stack_features": S + "SELECT event_id, 3 AS width, round(t, 6) AS m0, round(scaled, 6) AS m1, round(t / nullif(scaled, 0), 6) AS m2 FROM m",
    "quantize_u8": S + f"SELECT event_id, (series_id % 6) || '/' || series_id || '.csv.jpg' AS file, {U8.format(x='t')} AS u0, {U8.format(x='scaled')} AS u1, {U8.format(x='(t / nullif(scaled, 0))')} AS u2 FROM m",
    "cwt_power": S + FEW + "SELECT series_id, n, scale, round(power, 5) AS power FROM w",
    "cwt_full": S + ALL + "SELECT series_id, scale::INT AS scale, count(*) AS n, round(max(power), 5) AS top FROM w GROUP BY ALL",
    "cwt_freqs": "SELECT i::INT AS scale, round(0.8125 / i, 6)::DOUBLE AS freq, round(0.8125 / i / 0.02, 6)::DOUBLE AS freq_hz FROM range(1, 128) r(i)",
    "scalogram_intensity": S + ALL + "SELECT series_id, n, scale::INT AS scale, round(0.5 + power / nullif(2 * max(power) OVER (PARTITION BY series_id), 0), 4) AS intensity FROM w",
    "conv1d_relu": S + f"SELECT event_id, round(greatest({Y.format(v='value')} + 0.1, 0), 6) AS y FROM s {O}",
    "maxpool1d": S + "SELECT series_id, ((n - 1) // 2)::BIGINT AS place, max(value) AS pooled FROM m GROUP BY ALL HAVING count(*) = 2",
    "conv_stack": STACK + " SELECT series_id, (n - 1)::BIGINT AS place, (unnest(range(8)))::INT AS channel, round(unnest(x), 6) AS y FROM y3",
    "attention_vectors": STACK + """, u AS (SELECT series_id, x, list_sum(list_transform(range(8), lambda i: x[i + 1] * (3 * i % 5 - 2) / 5::DOUBLE)) AS u FROM y3),
        e AS (SELECT series_id, x, exp(u - max(u) OVER (PARTITION BY series_id)) AS e FROM u),
        p AS (SELECT series_id, unnest(range(8))::INT AS channel, unnest(x) AS x, e FROM e)
        SELECT series_id, channel, round(max(e) / sum(e), 6) AS top_weight, round(sum(e * x) / sum(e), 6) AS x FROM p GROUP BY ALL""",
    "last_step": S + "SELECT series_id, arg_max(value, (t, event_id)) AS last_value FROM s GROUP BY 1",
    "attention_pool": S + ", u AS (SELECT series_id, scaled, exp(tanh(2 * scaled - 0.5)) AS e FROM m) SELECT series_id, round(sum(e * scaled) / sum(e), 6) AS pooled, round(max(e) / sum(e), 6) AS top_weight FROM u GROUP BY 1",
    "transpose_matrix": S + "SELECT n::INT AS n, count(*) AS series, round(sum(scaled), 5) AS total FROM m GROUP BY ALL",
    "global_avg_pool": "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT vec_id, (i // 8)::INT AS channel, round(avg(x), 6) AS pooled FROM e GROUP BY ALL",
    "survey_windows": "SELECT epoch(time_bucket(INTERVAL 30 MINUTE, ts))::BIGINT AS began_s, event_type, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "residual_add": S + f"SELECT event_id, round(value + 1e-6 * greatest({Y.format(v='value')}, 0), 6) AS y FROM s {O}",
}
