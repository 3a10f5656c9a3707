"""Edge cases of the operators on small frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.functions import columns as C
from kelpline.operators import chat, dataset, groups, learn, metrics, normalize, sequence, wavelet
from kelpline.plans import schedules
from kelpline.sources import sinks, tables
from kelpline.streaming import windows


def curves(spark, *series):
    """Each series a list of (t, value)."""
    data = [(i, 100 * i + k, float(t), v if v is None else float(v)) for i, s in enumerate(series) for k, (t, v) in enumerate(s)]
    return spark.createDataFrame(data, "series_id long, event_id long, t double, value double")


def column(df, name, order="event_id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_minmax_of_constant_single_null_and_nan(spark):
    df = curves(spark, [(0, 5), (1, 5), (2, 5)], [(0, 7)], [(0, 1), (1, None), (2, 3), (3, math.nan), (4, 2)])
    assert column(normalize.minmax(df), "scaled") == [None] * 4 + [0.0, None, 1.0, None, 0.5]


def test_ratio_at_the_minimum(spark):
    df = curves(spark, [(0, 1), (1, 2)], [(0, 2), (1, 1)])
    assert column(normalize.ratio(normalize.minmax(df)), "ratio") == [None, 1.0, 0.0, None]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_layout_does_not_matter(spark, parts):
    df = curves(spark, [(k, (k * 7) % 11) for k in range(20)], [(k, k * k % 13) for k in range(9)])
    once = column(sequence.conv1d_relu(normalize.minmax(df), (1.0, 2.0, -1.0), value="scaled"), "y")
    assert column(sequence.conv1d_relu(normalize.minmax(df.repartition(parts)), (1.0, 2.0, -1.0), value="scaled"), "y") == once


def long_and_short(spark):
    """A long series with ties, null and NaN times and gaps, a short one, and one without a name."""
    draw = np.random.default_rng(4)
    times = np.sort(np.concatenate([draw.uniform(0, 5, 60), draw.uniform(90, 100, 25), np.full(15, 50.0)])).tolist() + [math.nan, None]
    rows = [(1, 1000 + i, t, float(draw.normal())) for i, t in enumerate(times)] + [(2, i, float(i), float(i % 3)) for i in range(7)] + [(None, i, float(-i), float(i)) for i in range(40)]
    return spark.createDataFrame(rows, "series_id long, event_id long, t double, value double").repartition(5)


@pytest.mark.parametrize("most", [2, 9, 64])
def test_long_series_give_what_short_ones_do(spark, most):
    df = long_and_short(spark)
    once = lambda out: sorted(repr(tuple(r)) for r in out.select(sorted(out.columns)).collect())
    assert once(groups.placed(df, most).withColumn("n", F.col("n").cast("int"))) == once(groups.placed(df))
    assert once(sequence.conv1d_relu(df, (1.0, 2.0, -1.0), most=most)) == once(sequence.conv1d_relu(df, (1.0, 2.0, -1.0)))
    assert once(sequence.maxpool1d(df, most=most)) == once(sequence.maxpool1d(df))
    power = [once(wavelet.cwt_power(df, (1, 2), "value", m).select("series_id", "n", "scale", F.round("power", 9).alias("power"))) for m in (most, groups.LONG)]
    assert power[0] == power[1]


def test_full_transform_in_blocks(spark):
    df = long_and_short(spark)
    joined = lambda out: {(r["series_id"], r["scale"]): r["x"] for r in out.groupBy("series_id", "scale").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "power"))), lambda s: s["power"])).alias("x")).collect()}
    cut, whole = joined(wavelet.cwt_full(df, 2, "value", 1)), joined(wavelet.cwt_full(df, 2, "value"))
    assert cut.keys() == whole.keys() and all(np.allclose(cut[k], whole[k], atol=1e-12) for k in cut)
    assert wavelet.cwt_full(df, 2, "value", 1).filter("series_id = 1 AND scale = 1").count() == 7


def test_zero_variance_feature_becomes_zero(spark):
    df = spark.createDataFrame([(1, [7.0, 1.0]), (2, [7.0, 2.0]), (3, [7.0, 4.0])], "id long, features array<double>")
    found = np.array(column(normalize.zscore(df), "features", "id"))
    assert (found[:, 0] == 0).all()
    assert abs(found[:, 1].mean()) < 1e-12 and abs(found[:, 1].std() - 1) < 1e-12


def test_pool_drops_the_odd_tail(spark):
    df = curves(spark, [(k, k) for k in range(4)], [(k, k) for k in range(5)], [(0, 1)])
    pooled = sequence.maxpool1d(df).groupBy("series_id").count().orderBy("series_id").collect()
    assert [(r["series_id"], r["count"]) for r in pooled] == [(0, 2), (1, 2)]


def test_convolution_of_an_impulse(spark):
    df = curves(spark, [(k, k == 2) for k in range(5)], [(0, 3)])
    assert column(sequence.conv1d_relu(df, (1.0, 2.0, 3.0)), "y") == [0.0, 3.0, 2.0, 1.0, 0.0, 6.0]


def test_wavelet_of_an_impulse_and_full_form(spark):
    df = curves(spark, [(k, float(k == 10)) for k in range(21)])
    power = wavelet.cwt_power(df, (1, 4), "value").collect()
    for r in power:
        u = (10 - (r["n"] - 1)) / r["scale"]
        want = abs(math.exp(-u * u / 2) * math.cos(5 * u)) / math.sqrt(r["scale"]) if abs(u) <= 8 else 0
        assert abs(r["power"] - want) < 1e-9
    full = {r["scale"]: r["power"] for r in wavelet.cwt_full(df, 4, "value").collect()}
    for r in power:
        assert abs(full[r["scale"]][r["n"] - 1] - r["power"]) < 1e-9


def test_softmax_weights_sum_to_one(spark):
    df = curves(spark, [(k, 1) for k in range(6)])
    got = sequence.attention_pool(df, F.col("t") * 1000).first()
    assert abs(got["pooled"] - 1) < 1e-12 and abs(got["top_weight"] - 1) < 1e-12


def test_argmax_takes_the_first_tie(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([],), (None,)], "x array<double>")
    assert [r[0] for r in df.select(C.argmax(F.col("x"))).collect()] == [1, None, None]


def test_quantised_bytes(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (1.5,), (254.6,), (1e9,), (math.nan,), (None,)], "x double")
    assert [r[0] for r in df.select(C.quantize_u8(F.col("x"))).collect()] == [0, 0, 2, 255, 255, 0, 0]


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_exact_split_and_batches(spark, n):
    df = spark.range(n).withColumnRenamed("id", "key")
    split = dataset.split_exact(df, "key", F.floor(F.col("n") * 4 / 5.0))
    assert split.filter("split = 'train'").count() == n * 4 // 5 and split.count() == n
    sizes = [r["count"] for r in dataset.batches(df, "key", 16).groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes == [16] * (n // 16) + ([n % 16] if n % 16 else [])


def test_ranks_are_a_permutation_with_repeated_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "key long")
    assert sorted(r["place"] for r in dataset.ranked(df, "key").collect()) == [1, 2, 3, 4]


def test_confusion_adds_up(spark):
    scored = spark.createDataFrame([(0, 0), (0, 1), (9, 1), (1, 1)], "label int, pred int")
    table = metrics.confusion(scored).collect()
    assert sum(r["n"] for r in table) == 4
    assert metrics.accuracy(scored).first()["accuracy"] == sum(r["n"] for r in table if r["label"] == r["pred"]) / 4


def test_prompt_prefix_bounds(spark):
    df = spark.createDataFrame([([1, 2], [1, 2, 3]), ([1, 2], [1, 2]), ([1, 2, 3], [1])], "p array<int>, o array<int>")
    assert [r[0] for r in df.select(chat.without_prompt(F.col("o"), F.col("p"))).collect()] == [[3], [], []]


def test_letterbox_never_vanishes(spark):
    df = spark.createDataFrame([(3, 5000), (224, 224), (448, 224)], "w int, h int")
    got = [tuple(r) for r in df.select(*schedules.letterbox(F.col("w"), F.col("h"))).collect()]
    assert got == [(1, 224, 111, 0), (224, 224, 0, 0), (224, 112, 0, 56)]


def test_pruning_needs_earlier_trials(spark):
    scores = spark.createDataFrame([(t, 1, 0.1 if t == 6 else 0.5) for t in range(7)], "trial long, epoch int, accuracy double")
    assert [r["trial"] for r in schedules.pruned(scores).filter("prune").collect()] == [6]


def test_curve_files_by_directory(spark, tmp_path):
    for folder, rows in (("RR", "time,flux\n0,1\n1,2\n"), ("Other", "a,b\n5,6\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text(rows)
    got = sorted(map(tuple, tables.curve_files(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, "RR/x.csv", 0.0, 1.0), (1, "RR/x.csv", 1.0, 2.0), (None, "Other/x.csv", 5.0, 6.0)], key=repr)


def test_image_files_and_labelled_sink(spark, tmp_path):
    for folder in ("b", "a"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "1.jpg").write_bytes(folder.encode())
    found = tables.image_files(spark, str(tmp_path / "in"))
    assert sorted((r["class"], r["label"], bytes(r["content"])) for r in found.collect()) == [("a", 0, b"a"), ("b", 1, b"b")]
    sinks.write_by_label(found.drop("path"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("label = 1").count() == 1


def test_wide_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("l,a,b\n3,1.5,2\n")
    assert tuple(tables.wide_csv(spark, str(tmp_path / "m.csv"), 2).first()) == (3, [1.5, 2.0])


def test_stream_appends_closed_windows(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", "a", float(m)) for h in range(4) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    streamed = windows.stream_to_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    closed = windows.window_stats(df).filter("began + INTERVAL 30 MINUTES <= TIMESTAMP '2024-01-01 02:56:00'")  # the last row less an hour
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, closed.collect())) != []


def test_channels_are_convolved_and_pooled(spark):
    draw = np.random.default_rng(1)
    x, w, bias = draw.normal(size=(7, 2)), draw.normal(size=(3, 2, 3)), draw.normal(size=3)
    df = spark.createDataFrame([(1, float(t), t, v.tolist()) for t, v in enumerate(x)], "series_id int, t double, event_id int, x array<double>")
    padded = np.vstack([np.zeros(2), x, np.zeros(2)])
    want = np.maximum(np.array([[np.sum(w[o] * padded[t : t + 3].T) + bias[o] for o in range(3)] for t in range(7)]), 0)
    made = sequence.conv1d_channels(df, w.tolist(), bias.tolist())
    assert np.allclose([r["y"] for r in made.orderBy("t").collect()], want)
    pooled = [r["pooled"] for r in sequence.maxpool1d_channels(made).orderBy("place").collect()]
    assert np.allclose(pooled, want[:6].reshape(3, 2, 3).max(axis=1))
    score = x @ [0.5, -1.0]
    share = np.exp(score) / np.exp(score).sum()
    got = sequence.attention_vectors(df, [0.5, -1.0]).first()
    assert np.allclose(got["pooled"], share @ x) and abs(got["top_weight"] - share.max()) < 1e-12


def test_bilstm_against_a_plain_loop(spark):
    draw, hidden = np.random.default_rng(2), 3
    series = {k: draw.normal(size=(n, 2)) for k, n in ((1, 1), (2, 5), (3, 9))}
    rows = [(k, float(t), t, v.tolist()) for k, x in series.items() for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id int, t double, event_id int, x array<double>").repartition(3)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))

    def one_way(x, w, u, b):
        h, c, out = np.zeros(hidden), np.zeros(hidden), []
        for v in x:
            z = v @ w + h @ u + b
            i, f, g, o = (z[k * hidden : (k + 1) * hidden] for k in range(4))
            c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
            h = sigmoid(o) * np.tanh(c)
            out.append(h)
        return np.array(out)

    for block in (2, 4096):
        found = {}
        for r in sequence.bilstm(df, hidden, 2, 4, block=block).collect():
            found.setdefault(r["series_id"], {})[r["block"]] = r["steps"]
        got = {k: np.concatenate([blocks[i] for i in range(len(blocks))]) for k, blocks in found.items()}
        for k, x in series.items():
            for layer in range(2):
                ahead, back = (sequence.weights(x.shape[1], hidden, 4 + 2 * layer + way) for way in (0, 1))
                x = np.hstack([one_way(x, *ahead), one_way(x[::-1], *back)[::-1]])
            assert np.allclose(got[k], x) and len(found[k]) == -(-len(x) // block)
    # At the last step the backward half has read the last row only.
    w, u, b = sequence.weights(2, hidden, 4 + 1)
    assert np.allclose(np.array({r["series_id"]: r["steps"] for r in sequence.bilstm(df, hidden, 1, 4).collect()}[3])[-1, hidden:], one_way(series[3][-1:], w, u, b)[0])


def test_checkpoints_come_back(spark, tmp_path):
    draw = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, int(x[0] > 0), x.tolist()) for i, x in enumerate(draw.normal(size=(80, 3)))], "id int, label int, features array<double>")
    for hidden in (None, 4):
        model = learn.train(rows, hidden)
        learn.save(model, str(tmp_path / str(hidden)))
        once, again = (sorted(map(tuple, learn.predict(m, rows).collect())) for m in (model, learn.load(str(tmp_path / str(hidden)))))
        assert once == again and sum(label == pred for _, label, pred in once) > 70
