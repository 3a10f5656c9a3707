"""Images cut into small tiles against whole arrays in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.operators import coding, images
from kelpline.plans import image_queries, series_queries, training_queries
from kelpline.sources.sinks import write_by_label

SIZES = {1: (9, 13), 2: (1, 1), 3: (17, 8), 4: (3, 2)}


def drawn(channels, seed=0):
    draw = np.random.default_rng(seed)
    return {k: draw.normal(size=(*s, channels)) for k, s in SIZES.items()}


def strips(spark, held, cut=5):
    """Images as strips of at most ``cut`` columns, with a column of another name beside them."""
    rows = [(k, y, x, a[y, x : x + cut].ravel().astype(float).tolist(), "own") for k, a in held.items() for y in range(a.shape[0]) for x in range(0, a.shape[1], cut)]
    return spark.createDataFrame(rows, "image long, y int, x int, values array<double>, width string")


def whole(frame, channels):
    """Arrays by image, of strips that must cover each exactly once."""
    found = {}
    for r in frame.collect():
        for i, v in enumerate(np.array(r["values"]).reshape(-1, channels)):
            assert found.setdefault(r["image"], {}).setdefault((r["y"], r["x"] + i), None) is None
            found[r["image"]][r["y"], r["x"] + i] = v
    out = {}
    for k, pixels in found.items():
        h, w = (max(p[i] for p in pixels) + 1 for i in (0, 1))
        assert len(pixels) == h * w
        out[k] = np.array([[pixels[y, x] for x in range(w)] for y in range(h)])
    return out


def dense(a, weights, bias, step, pad, each):
    r, c = weights.shape[:2]
    a = np.pad(a, ((pad, pad), (pad, pad), (0, 0)))
    h, w = (a.shape[0] - r) // step + 1, (a.shape[1] - c) // step + 1
    if h < 1 or w < 1:
        return None
    at = lambda y, x: a[y * step : y * step + r, x * step : x * step + c]
    one = (lambda p: (p * weights).sum((0, 1))) if each else (lambda p: np.einsum("rci,rcio->o", p, weights))
    return np.array([[one(at(y, x)) + bias for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("tile", [2, 5, 256])
@pytest.mark.parametrize("size, step, pad, each", [(4, 4, 0, False), (7, 1, 3, True), (2, 2, 0, False), (3, 2, 1, True)])
def test_convolutions_are_dense_ones(spark, tile, size, step, pad, each):
    draw, held = np.random.default_rng(1), drawn(2)
    weights = draw.normal(size=(size, size, 2) if each else (size, size, 2, 3))
    bias = draw.normal(size=2 if each else 3)
    got = whole(images.convolve(strips(spark, held), weights, bias, step, pad, each, tile=tile), len(bias))
    want = {k: v for k, a in held.items() if (v := dense(a, weights, bias, step, pad, each)) is not None}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_nulls_count_as_zero_and_nothing_gives_nothing(spark):
    held = spark.createDataFrame([(1, 0, 0, [1.0, None, float("nan"), 4.0]), (1, None, 0, [9.0]), (2, 0, 0, []), (2, 0, 0, None), (None, 0, 0, [2.0])], "image long, y int, x int, values array<double>")
    got = {r["image"]: r["values"] for r in images.convolve(held, np.ones((1, 1, 1, 1)), np.zeros(1)).collect()}
    assert got == {1: [1.0, 0.0, 0.0, 4.0], None: [2.0]}
    assert images.convolve(held.limit(0), np.ones((1, 1, 1, 1)), np.zeros(1)).count() == 0


def test_block_is_the_dense_one(spark):
    draw, held = np.random.default_rng(2), drawn(3)
    around, bias, up, down = draw.normal(size=(7, 7, 3)), draw.normal(size=3), draw.normal(size=(3, 12)), draw.normal(size=(12, 3))
    got = whole(images.block(strips(spark, held), around, bias, up, down, 0.5, tile=4), 3)
    for k, a in held.items():
        y = dense(a, around, bias, 1, 3, True)
        y = (y - y.mean(-1, keepdims=True)) / np.sqrt(y.var(-1, keepdims=True) + 1e-6) @ up
        assert np.allclose(got[k], a + 0.5 * (0.5 * y * (1 + np.vectorize(math.erf)(y / math.sqrt(2)))) @ down)


def plain_resize(a, high, wide, reach):
    def along(a, m):
        n, out = len(a), []
        for o in range(m):
            at = (o + 0.5) * n / m
            by = max(n / m, 1)
            w = [(j + 0.5 - at) / by for j in range(n)]
            w = [max(1 - abs(z), 0) if reach == 1 else (np.sinc(z) * np.sinc(z / reach) if abs(z) < reach else 0) for z in w]
            out.append(sum(v * p for v, p in zip(w, a)) / sum(w))
        return np.array(out)

    return along(along(a, high).swapaxes(0, 1), wide).swapaxes(0, 1)


@pytest.mark.parametrize("tile", [3, 256])
@pytest.mark.parametrize("high, wide, reach", [(5, 7, 1), (20, 1, 1), (12, 30, 3), (2, 3, 3)])
def test_resizing_is_the_plain_one(spark, tile, high, wide, reach):
    held = drawn(2)
    got = whole(images.resized(strips(spark, held), lambda h, w: (high, wide), 2, reach, tile), 2)
    assert set(got) == set(held)
    for k, a in held.items():
        assert np.allclose(got[k], plain_resize(a, high, wide, reach))


def test_pasting_keeps_the_image_in_the_middle(spark):
    held = drawn(2)
    fit = images.resized(strips(spark, held), images.fitted(12), 2)
    got, inner = whole(images.pasted(fit, 12, 2, 7.0), 2), whole(fit, 2)
    for k, (h, w) in SIZES.items():
        high, wide = max(1, math.floor(h * min(12 / h, 12 / w))), max(1, math.floor(w * min(12 / h, 12 / w)))
        want = np.full((12, 12, 2), 7.0)
        top, left = (12 - high) // 2, (12 - wide) // 2
        want[top : top + high, left : left + wide] = inner[k]
        assert inner[k].shape == (high, wide, 2) and np.allclose(got[k], want)


@pytest.mark.parametrize("shift", [0, 2])
def test_window_attention_is_a_dense_masked_one(spark, shift):
    draw, held, size, heads = np.random.default_rng(3), drawn(4), 4, 2
    weights = {n: draw.normal(size=(4, 4)) for n in ("q", "k", "v", "out")} | {"bias": draw.normal(size=((2 * size - 1) ** 2, heads)), "up": draw.normal(size=(4, 16)), "down": draw.normal(size=(16, 4))}
    got = whole(images.window_block(strips(spark, held), weights, heads, size, shift), 4)
    for k, a in held.items():
        h, w = a.shape[:2]
        at = [((y - shift) % h, (x - shift) % w, y < shift, x < shift) for y in range(h) for x in range(w)]
        x = a.reshape(-1, 4)
        z = images.normed(x)
        total = np.zeros_like(x)
        for head in range(heads):
            q, key, v = ((z @ weights[n])[:, 2 * head : 2 * head + 2] for n in ("q", "k", "v"))
            s = np.full((len(at), len(at)), -np.inf)
            for i, p in enumerate(at):
                for j, o in enumerate(at):
                    if p[0] // size == o[0] // size and p[1] // size == o[1] // size and p[2:] == o[2:]:
                        s[i, j] = q[i] @ key[j] / math.sqrt(2) + weights["bias"][(p[0] - o[0] + size - 1) * (2 * size - 1) + p[1] - o[1] + size - 1, head]
            e = np.exp(s - s.max(1, keepdims=True))
            total[:, 2 * head : 2 * head + 2] = e / e.sum(1, keepdims=True) @ v
        x = x + total @ weights["out"]
        x = x + images.gelu(images.normed(x) @ weights["up"]) @ weights["down"]
        assert np.allclose(got[k], x.reshape(h, w, 4))


def test_merging_takes_two_by_two(spark):
    held, weights = drawn(2), np.random.default_rng(4).normal(size=(8, 3))
    got = whole(images.merged(strips(spark, held), weights, tile=2), 3)
    assert set(got) == {1, 3, 4}
    for k in got:
        h, w = SIZES[k][0] // 2, SIZES[k][1] // 2
        near = [[images.normed(np.concatenate([held[k][2 * y + r, 2 * x + c] for c in (0, 1) for r in (0, 1)])) @ weights for x in range(w)] for y in range(h)]
        assert np.allclose(got[k], near)


@pytest.mark.parametrize("step, narrow", [(1, 2), (2, 2), (1, 3)])
def test_bottleneck_is_the_dense_one(spark, step, narrow):
    draw, held = np.random.default_rng(5), drawn(2)
    weights = {"up": draw.normal(size=(2, 6)), "around": draw.normal(size=(3, 3, 6)), "squeeze": draw.normal(size=(6, 2)), "excite": draw.normal(size=(2, 6)), "down": draw.normal(size=(6, narrow))}
    got = whole(images.inverted_bottleneck(strips(spark, held), weights, step, tile=4), narrow)
    swish = lambda x: x / (1 + np.exp(-x))
    for k, a in held.items():
        y = swish(dense(swish(a @ weights["up"]), weights["around"], np.zeros(6), step, 1, True))
        gate = 1 / (1 + np.exp(-(swish(y.mean((0, 1)) @ weights["squeeze"]) @ weights["excite"])))
        want = (y * gate) @ weights["down"]
        assert np.allclose(got[k], want + a if step == 1 and narrow == 2 else want)


def test_colours_run_from_end_to_end(spark):
    xs = [(0.0,), (0.5,), (1.0,), (2.0,), (-1.0,), (None,), (float("nan"),), (0.75,)]
    got = [r[0] for r in spark.createDataFrame(xs, "x double").select(images.coloured(F.col("x"))).collect()]
    ends = [0x40, 0x00, 0x4B], [0x00, 0x44, 0x1B]
    assert got[0] == got[4] == got[6] == ends[0] and got[2] == got[3] == ends[1] and got[5] is None
    assert all(abs(a - 0xF7) <= 1 for a in got[1]) and got[7][1] > got[7][0] and len(images.levels(images.PURPLE_GREEN)) == 256


@pytest.mark.parametrize("quality", [10, 50, 95, 100])
def test_blocks_come_back_within_their_steps(spark, quality):
    draw = np.random.default_rng(6)
    held = {k: draw.integers(0, 256, (*s, 1)) for k, s in SIZES.items()} | {9: np.full((8, 8, 1), 255), 10: np.arange(64).reshape(8, 8, 1)}
    cut = coding.blocks(strips(spark, held, cut=8))
    code = coding.coded(cut, quality)
    bound = np.sqrt((coding.steps(quality) ** 2).sum()) / 2 + 1e-4
    back = {(r["image"], r["block_y"], r["block_x"]): np.array(r["pixels"]) for r in coding.decoded(code, quality).collect()}
    for r in cut.collect():
        assert np.sqrt(((back[r["image"], r["block_y"], r["block_x"]] - np.array(r["pixels"])) ** 2).sum()) <= bound
    again = whole(coding.unblocked(coding.decoded(code, quality)), 1)
    assert {k: a.shape for k, a in again.items()} == {k: a.shape for k, a in held.items()}
    for r in code.collect():
        assert sum(x["run"] + 1 for x in r["code"]) <= 64 and all(x["value"] for x in r["code"])
    if quality == 100:
        assert max(np.abs(again[k] - held[k]).max() for k in held) <= 4


@pytest.mark.parametrize("shift", [0, 2])
def test_whole_images_are_worked_on_as_strips_are(spark, shift):
    draw, held = np.random.default_rng(7), drawn(4)
    weights = {n: draw.normal(size=(4, 4)) for n in ("q", "k", "v", "out")} | {"bias": draw.normal(size=(49, 2)), "up": draw.normal(size=(4, 16)), "down": draw.normal(size=(16, 4))}
    gates = {"up": draw.normal(size=(4, 6)), "around": draw.normal(size=(3, 3, 6)), "squeeze": draw.normal(size=(6, 2)), "excite": draw.normal(size=(2, 6)), "down": draw.normal(size=(6, 4))}
    local = [images.convolution(draw.normal(size=(4, 4, 4, 3)), np.arange(3), 4), images.residual(draw.normal(size=(7, 7, 4)), np.arange(4), draw.normal(size=(4, 8)), draw.normal(size=(8, 4)), 0.5), images.resizing(images.fitted(12), 4, 3), images.merging(draw.normal(size=(16, 3)))]
    pairs = [(op, op.over(strips(spark, held), 5), op.out_channels) for op in local]
    pairs.append((lambda x: images.window_whole(x, weights, 2, 4, shift), images.window_block(strips(spark, held), weights, 2, 4, shift), 4))
    pairs += [(lambda x, step=step: images.bottleneck_whole(x, gates, step), images.inverted_bottleneck(strips(spark, held), gates, step, 4), 4) for step in (1, 2)]
    fit = images.resizing(images.fitted(12), 4)
    pairs.append((lambda x: images.pasted_whole(fit(x), 12, 7.0), images.pasted(fit.over(strips(spark, held)), 12, 4, 7.0), 4))
    for op, frame, channels in pairs:
        got, want = whole(frame, channels), {k: y for k, a in held.items() if (y := op(a)).size}
        assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def events(spark, path):
    """Series 1 to 3 of 9, 40 and 20 samples, and 4 without a value."""
    value = lambda s, i: None if s == 4 else float((i * i * 7 + s) % 11)
    rows = [(100 * s + i, i, s, "view", value(s, i)) for s, n in ((1, 9), (2, 40), (3, 20), (4, 8)) for i in range(n)]
    frame = spark.createDataFrame(rows, "event_id long, at int, user_id long, event_type string, value double")
    frame.selectExpr("event_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, at) AS ts", "user_id", "event_type", "value").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_short_series_need_no_strips(spark, tmp_path, monkeypatch):
    found = []
    for most in (10, 30, 512):
        monkeypatch.setattr(images, "WHOLE", most)
        monkeypatch.setattr(series_queries, "SHORT", most)
        d = events(spark, tmp_path / str(most))
        if most == 512:
            fail = lambda *_: pytest.fail("a scalogram was written")
            monkeypatch.setattr(image_queries, "strips", fail)
            monkeypatch.setattr(series_queries, "scratch", fail)
        names = ["image_resize", "image_letterbox", "window_attention", "patch_merging", "squeeze_excite", "convnext_stem", "scalogram_rgb"]
        asked = [image_queries.QUERIES[n] for n in names] + [series_queries.scalogram_intensity]
        found.append([sorted([tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in q(spark, d).collect()], key=repr) for q in asked])
    for few, some, all_ in zip(*found):
        assert len(few) == len(some) == len(all_) > 0
        assert all(a == b or all(x == y or abs(x - y) < 3e-4 for x, y in zip(a, b)) for other in (few, some) for a, b in zip(other, all_))


def test_ends_of_rows_travel_without_their_values(spark):
    frame = image_queries.edges(strips(spark, drawn(1)))
    moved = [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "partial_m" in line]
    assert moved and not any("partial_min_by(values" in line or "partial_max_by(values" in line for line in moved)
    got = {(r["image"], r["y"]): r for r in frame.collect()}
    for k, a in drawn(1).items():
        for y, row in enumerate(a[:, :, 0]):
            r = got[k, y]
            assert (r["n"], r["first"], r["last"]) == (len(row), row[0], row[-1]) and abs(r["total"] - row.sum()) < 1e-9


def test_labels_are_written_without_a_sort(spark, tmp_path):
    rows = spark.range(60).withColumn("label", F.col("id") % 6)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    write_by_label(rows.repartition(2), f"{tmp_path}/out", labels=6)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted((i, i % 6) for i in range(60))


def test_zigzag_and_transform():
    assert coding.ZIGZAG[:6] == [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2)] and coding.ZIGZAG[-1] == (7, 7)
    assert np.allclose(coding.COSINES @ coding.COSINES.T, np.eye(8)) and coding.steps(50).ravel().tolist()[:3] == [16, 11, 10]


def test_scans_take_any_rows(spark, tmp_path):
    spark.sql("""SELECT * FROM VALUES (1L, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(NULL AS BIGINT), 'view', 1.0D), (2L, TIMESTAMP_NTZ'2024-01-02 00:00:00', NULL, 'view', 3.0D),
        (3L, TIMESTAMP_NTZ'2024-01-01 00:00:00', -7L, 'view', 2.0D), (4L, TIMESTAMP_NTZ'2024-01-03 00:00:00', -7L, 'view', NULL), (5L, NULL, 8L, 'view', 5.0D) AS t(event_id, ts, user_id, event_type, value)""").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted([tuple(r) for r in series_queries.scan_curves(spark, str(tmp_path)).collect()], key=repr)
    assert got == sorted([(None, None, 0.0, 1.0, 0.0), (None, None, 1.0, 3.0, 1.0), (5, -7, 0.0, 2.0, None), (5, -7, 2.0, None, None), (2, 8, None, 5.0, None)], key=repr)
    spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0), (2, [4.0], 1), (3, [], 2), (4, None, None), (5, [None, 6.0], 3)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted([tuple(r) for r in series_queries.scan_wide(spark, str(tmp_path)).collect()], key=repr)
    assert got == sorted([(0, 1.0, 2.0, 3.0), (1, 4.0, None, None), (2, None, None, None), (None, None, None, None), (3, None, 6.0, None)], key=repr)
    flat = training_queries.flatten_matrix(spark, str(tmp_path)).filter("id = 1").collect()
    assert [(r["n"], r["place"], r["x"]) for r in flat] == [(3, 0, 1.0), (3, 1, 2.0), (3, 2, 3.0)]
