"""Nets, distributed steps, records and the search, against finite differences and plain versions."""

import hashlib
import math
import os
import socket

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kelpline.functions import columns as C
from kelpline.operators import dataset, network, training
from kelpline.operators.network import Net
from kelpline.plans import schedules, search
from kelpline.sources.sinks import scratch

SMALL = Net(9, 3, filters=2, hidden=3, layers=2, dense=4, dropout=0.3, rate=0.02)
LARGER = Net(9, 3, filters=8, hidden=8, dense=16, dropout=0.1, rate=0.05, attention=False)


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def planted(spark, n=120, width=9):
    """Rows whose label is where their bump lies."""
    noise = np.random.default_rng(0).normal(0, 0.2, (n, width))
    rows = [(i, i % 3, [float(v) + 2.0 * (abs(k - 1.5 - 2.5 * (i % 3)) < 1.5) for k, v in enumerate(noise[i])]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label int, features array<double>")


def test_erf_and_its_inverse(spark):
    xs = [*np.linspace(-7, 7, 401).tolist(), 1e-9, -1e-300, 0.0]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", C.erf(F.col("x")).alias("e"), C.gelu(F.col("x")).alias("g")).collect():
        assert abs(r["e"] - math.erf(r["x"])) < 1e-12 and abs(r["g"] - r["x"] * (1 + math.erf(r["x"] / math.sqrt(2))) / 2) < 1e-12
    ys = [*np.linspace(-0.999, 0.999, 201).tolist(), 1 - 1e-8]
    for r in spark.createDataFrame([(y,) for y in ys], "y double").select("y", C.erf_inverse(F.col("y")).alias("x")).collect():
        assert abs(math.erf(r["x"]) - r["y"]) < 1e-12
    odd = spark.createDataFrame([(1.0,), (-1.0,), (2.0,), (None,), (float("nan"),)], "y double").select(C.erf_inverse(F.col("y")), C.erf(F.col("y"))).collect()
    assert odd[0][0] == math.inf and odd[1][0] == -math.inf and math.isnan(odd[2][0]) and odd[3] == (None, None) and math.isnan(odd[4][0]) and math.isnan(odd[4][1])


def test_truncated_normal_stays_inside_and_has_the_spread(spark):
    x = np.array([r[0] for r in spark.range(4000).select(C.truncated_normal(C.uniform("t", F.col("id")), 1.0, 2.0, -1.0, 4.0)).collect()])
    assert x.min() >= -1 and x.max() <= 4
    edges = np.array([math.erf((e - 1) / (2 * math.sqrt(2))) for e in np.linspace(-1, 4, 11)])
    assert np.abs(np.histogram(x, np.linspace(-1, 4, 11))[0] / len(x) - np.diff(edges) / (edges[-1] - edges[0])).max() < 0.02


@pytest.mark.parametrize("attention", [True, False])
def test_gradients_are_finite_differences(attention):
    net = Net(11, 3, filters=2, hidden=3, layers=2, dense=4, dropout=0.3, attention=attention)
    v, x, labels = net.drawn(1), np.random.default_rng(0).normal(size=(5, 11)), np.array([0, 1, 2, 1, 0])
    drops = training.dropper(list(range(5)), 0, 1, net.dropout)
    loss = lambda w: network.losses(network.scores(net, w, x, drops)[0], labels)[0].sum()
    logits, back = network.scores(net, v, x, drops)
    steps = np.eye(len(v)) * 1e-6
    assert np.abs(back(network.losses(logits, labels)[1]) - [(loss(v + e) - loss(v - e)) / 2e-6 for e in steps]).max() < 1e-7


def test_partial_gradients_add_up(spark):
    rows, vector = planted(spark, 40), SMALL.drawn(0)
    x, labels = np.array([r["features"] for r in rows.orderBy("id").collect()]), np.arange(40) % 3
    logits, back = network.scores(SMALL, vector, x, training.dropper(list(range(40)), 5, 7, SMALL.dropout))
    loss, d = network.losses(logits, labels)
    for parts in (1, 3, 40):
        dealt = rows.withColumn("part", F.pmod("id", F.lit(parts)))
        found = training.gradients(dealt, {4: SMALL}, {4: vector}, 5, 7, parts)
        assert found[4][0] == 40 and abs(found[4][1] - loss.sum()) < 1e-9 and np.abs(found[4][2] - back(d)).max() < 1e-9


def test_adam_is_the_published_rule():
    a, m, v, w = training.Adam(np.array([1.0, -2.0]), 0.1), np.zeros(2), np.zeros(2), np.array([1.0, -2.0])
    for t, g in enumerate(np.array([[0.5, -1.0], [0.1, 0.0], [-3.0, 2.0]]), 1):
        a.step(g)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(a.weights, w, rtol=1e-12)


def ledger(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_fit_learns_repeats_and_goes_on(spark):
    rows = planted(spark)
    train, val = rows.filter("id < 90"), rows.filter("id >= 90").unionByName(spark.createDataFrame([(None, 1, [0.0] * 9), (7, None, [0.0] * 9), (8, 1, None), (9, 1, [None] * 9)], rows.schema))
    folders = [scratch(spark, "fit") for _ in range(3)]
    first = training.fit(train, val, {0: SMALL, 3: LARGER}, 5, 32, folders[0], parts=4)
    seen = ledger(first)
    assert [r[:2] for r in seen] == [(t, e) for t in (0, 3) for e in range(1, 6)] and {r[5:] for r in seen} == {(90, 30)}
    assert seen[4][2] < seen[0][2] and seen[9][4] > 0.8
    again = training.fit(train, val, {0: SMALL}, 2, 32, folders[1], parts=4)
    assert ledger(again) == seen[:2]
    went_on = training.fit(train, val, {0: SMALL}, 5, 32, folders[1], parts=4)
    assert ledger(went_on) == seen[:5]
    state = training.load(spark, folders[0], 3, 5)
    scored = training.scored(val.filter("id >= 90 AND label IS NOT NULL"), {3: LARGER}, {3: state.weights}).collect()
    assert abs(sum(r["loss"] for r in scored) / 30 - seen[9][3]) < 1e-12 and sum(r["pred"] == r["label"] for r in scored) / 30 == seen[9][4]


def test_an_epoch_is_no_job_for_each_step(spark):
    rows, jobs = planted(spark, 48), []
    for batch in (24, 2):
        spark.sparkContext.setJobGroup(f"steps of {batch}", "")
        training.fit(rows, rows, {0: SMALL}, 1, batch, scratch(spark, "fit"), parts=4)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"steps of {batch}")))
    assert jobs[1] < jobs[0] + 10


def test_steps_of_a_stage_are_those_of_jobs(spark, monkeypatch):
    rows = planted(spark, 50).withColumn("part", F.pmod("id", F.lit(20))).withColumn("batch_id", F.floor(F.col("id") / 8))
    nets = {4: SMALL, 2: LARGER}
    begun = lambda: {t: training.Adam(net.drawn(t), net.rate) for t, net in nets.items()}
    one = training.epoch_steps(rows, nets, begun(), 5, 7, 7, 20)
    monkeypatch.setattr(training, "tasks_at_once", lambda spark: 0)
    other = training.epoch_steps(rows, nets, begun(), 5, 7, 7, 20)
    for t in nets:
        assert one[t][0].steps == 7 and abs(one[t][1] - other[t][1]) < 1e-12
        assert all(np.array_equal(getattr(one[t][0], n), getattr(other[t][0], n)) for n in ("weights", "first", "second"))


def test_nets_side_by_side_are_those_alone():
    nets = [Net(11, 3, filters=f, hidden=3, layers=n, dense=4, dropout=r, attention=True) for f, n, r in ((2, 3, 0.3), (3, 1, 0.0), (5, 2, 0.2))]
    vectors, x, labels = [n.drawn(i) for i, n in enumerate(nets)], np.random.default_rng(0).normal(size=(7, 11)), np.arange(7) % 3
    drops = [training.dropper(list(range(7)), 0, 1, n.dropout) for n in nets]
    logits, back = network.together(nets, vectors, [x] * 3, drops)
    loss, d = network.losses(logits, labels)
    for i, g in enumerate(back(d)):
        alone, back_alone = network.scores(nets[i], vectors[i], x, drops[i])
        loss_alone, d_alone = network.losses(alone, labels)
        assert np.array_equal(logits[i], alone) and np.array_equal(loss[i], loss_alone) and np.array_equal(g, back_alone(d_alone))


def test_rows_of_a_step_are_dealt_evenly(spark):
    rows = dataset.batches(spark.range(100), "id", 32, 3, parts=5).groupBy("batch_id", "part").count().collect()
    sizes = {b: sorted(r["count"] for r in rows if r["batch_id"] == b) for b in range(4)}
    assert sizes == {0: [6, 6, 6, 7, 7], 1: [6, 6, 6, 7, 7], 2: [6, 6, 6, 7, 7], 3: [1, 1, 1, 1]}


def test_held_out_rows_are_scored_in_many_tasks(spark, monkeypatch):
    rows, dealt, score = planted(spark, 60).coalesce(1), [], training.scored
    monkeypatch.setattr(training, "scored", lambda val, *rest: dealt.append(val.rdd.getNumPartitions()) or score(val, *rest))
    training.fit(rows, rows, {0: SMALL}, 1, 32, scratch(spark, "fit"), parts=2)
    assert dealt and min(dealt) > 1


def test_groups_of_nets_use_all_tasks():
    assert training.grid(12, 8, 10) == (1, 8) and training.grid(6, 8, 10) == (2, 3) and training.grid(4, 4, 2) == (1, 4) and training.grid(1, 8, 10) == (1, 1) and training.grid(8, 8, 1) == (1, 8)
    for many in (1, 2, 5):
        groups = training.grouped({t: Net(9, 3, filters=2 + t, hidden=3) for t in range(5)}, many)
        assert len(groups) == many and all(groups) and sorted(t for g in groups for t in g) == list(range(5))


def test_tasks_trade_without_delay(spark):
    def run(batches):
        with training.Circle(b"key", 2) as circle:
            now = [same.getsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY) for link in circle.links.values() for same in [socket.socket(fileno=os.dup(link.fileno()))]]
            # More than the buffers of a connection hold.
            met = circle.traded({k: bytes([circle.rank, k]) * 5_000_000 for k in range(circle.owners)}, range(circle.tasks if circle.rank < circle.owners else 0))
            yield pa.RecordBatch.from_pylist([{"rank": circle.rank, "all": all(now), "links": len(now), "met": str(sorted((t, len(m), *m[-2:]) for t, m in met.items()))}])

    found = sorted(spark.range(0, 4, 1, 4).mapInArrow(run, "rank long, all boolean, links long, met string", barrier=True).collect())
    assert [tuple(r)[:3] for r in found] == [(0, True, 3), (1, True, 3), (2, True, 2), (3, True, 2)]
    assert [r["met"] for r in found] == [str([(t, 10_000_000, t, k) for t in range(4)] if k < 2 else []) for k in range(4)]


def test_steps_of_groups_are_those_of_jobs(spark, monkeypatch):
    rows = planted(spark, 30).withColumn("part", F.pmod("id", F.lit(2))).withColumn("batch_id", F.floor(F.col("id") / 8))
    nets = {4: SMALL, 2: LARGER, 7: SMALL}
    begun = lambda: {t: training.Adam(net.drawn(t), net.rate) for t, net in nets.items()}
    monkeypatch.setattr(training, "tasks_at_once", lambda spark: 4)
    assert training.grid(4, 2, 3) == (2, 2)
    one = training.epoch_steps(rows, nets, begun(), 5, 7, 4, 2)
    monkeypatch.setattr(training, "tasks_at_once", lambda spark: 0)
    other = training.epoch_steps(rows, nets, begun(), 5, 7, 4, 2)
    for t in nets:
        assert one[t][0].steps == 4 and abs(one[t][1] - other[t][1]) < 1e-12
        assert all(np.array_equal(getattr(one[t][0], n), getattr(other[t][0], n)) for n in ("weights", "first", "second"))


def test_runs_cross_batches():
    batches = [pa.record_batch({"k": k, "v": k}) for k in ([0, 0, 1], [], [1, 1], [1, 3])]
    assert [(k, t.column("v").to_pylist()) for k, t in training.runs(iter([b for b in batches if b.num_rows]), "k")] == [(0, [0, 0]), (1, [1] * 4), (3, [3])]


def test_fit_of_nothing_records_nothing(spark):
    none = planted(spark, 3).filter("id < 0")
    assert training.fit(none, none, {0: SMALL}, 2, 8, scratch(spark, "fit"), parts=2).count() == 0


def test_stopped_nets_have_no_later_rows(spark):
    rows = planted(spark, 30)
    found = training.fit(rows, rows, {0: SMALL, 1: SMALL}, 3, 32, scratch(spark, "fit"), parts=2, stop=lambda m: [1] if m.filter("epoch >= 2").count() else [])
    assert [(r["trial"], r["epoch"]) for r in found.orderBy("trial", "epoch").collect()] == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2)]


def plain_proposal(history, good, low, high, whole, name, trial, seed):
    """One setting's proposal from values and whether each is good, by a plain loop."""
    mixtures = {}
    for kind in (True, False):
        seen = sorted([(v, t, False) for t, v in history.items() if (t in good) == kind] + [((low + high) / 2, -1, True)])
        n = len(seen)
        mixtures[kind] = []
        for i, (v, _, wide) in enumerate(seen):
            gap = max(v - (seen[i - 1][0] if i else low), (seen[i + 1][0] if i + 1 < n else high) - v)
            spread = high - low if wide else min(high - low, max(gap, (high - low) / min(100, 1 + n)))
            share = [0.5 * (1 + math.erf((e - v) / (spread * math.sqrt(2)))) for e in (low, high)]
            mixtures[kind].append((v, spread, *share))

    def density(x, kind):
        return sum(math.exp(-(((x - m) / s) ** 2) / 2) / (s * len(mixtures[kind]) * (b - a)) for m, s, a, b in mixtures[kind])

    best = None
    for i in range(search.CANDIDATES):
        m, s, a, b = mixtures[True][int(draw(seed, "which", name, trial, i) * len(mixtures[True]))]
        at = a + draw(seed, "where", name, trial, i) * (b - a)
        lo, hi = -12.0, 12.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < at else (lo, mid)
        x = min(max(m + s * lo, low), high)
        x = min(max(math.floor(x + 0.5), math.ceil(low)), math.floor(high)) if whole else x
        ratio = (round(math.log(density(x, True)) - math.log(density(x, False)), 9), -i)
        best = max(best, (*ratio, x)) if best else (*ratio, x)
    return best[2]


def test_proposals_are_those_of_a_plain_version(spark):
    space = search.ranges(spark, (4, 12))
    settings = search.first_trials(spark, space, list(range(14)), 3)
    rows = [(t, e, 0.0, 0.0, round(draw("acc", t, e), 3), 1, 1) for t in range(14) for e in range(1, 4) if not (t % 4 == 1 and e > 2)]
    judged = search.judged(spark.createDataFrame(rows, training.METRICS), 3)
    last = {t: max((e, a) for u, e, _, _, a, *_ in rows if u == t) for t in range(14)}
    ranked = sorted(range(14), key=lambda t: (-last[t][0], -last[t][1], t))
    assert {r["trial"] for r in judged.collect() if r["good"]} == set(ranked[:2])
    assert {r["trial"] for r in judged.collect() if r["stopped"]} == {1, 5, 9, 13}
    history = {}
    for r in settings.collect():
        history.setdefault(r["name"], {})[r["trial"]] = r["value"]
    got = {(r["trial"], r["name"]): r["value"] for r in search.proposed(settings, judged, space, [14, 15], 3).collect()}
    for r in space.collect():
        for trial in (14, 15):
            want = plain_proposal(history[r["name"]], set(ranked[:2]), r["low"], r["high"], r["whole"], r["name"], trial, 3)
            assert abs(got[trial, r["name"]] - want) < 1e-7, (r["name"], trial)
    assert len(got) == 8


def test_search_records_and_prunes(spark):
    rows = planted(spark, 60)
    folder = scratch(spark, "search")
    make = lambda x: Net(9, 3, filters=int(x["filters"]), hidden=2, layers=int(x["layers"]), dense=3, dropout=x["dropout"], rate=x["rate"])
    ask = lambda: search.search(rows.filter("id < 45"), rows.filter("id >= 45"), make, folder, filters=(2, 4), trials=8, side_by_side=4, startup=4, epochs=2, batch=64, parts=2)
    found = {r["trial"]: r for r in ask().collect()}
    assert set(found) == set(range(8)) and sum(r["good"] for r in found.values()) == 1
    recorded = training.metrics(spark, folder)
    for r in schedules.pruned(recorded.select("trial", "epoch", "accuracy")).filter("prune").collect():
        assert found[r["trial"]]["epochs"] <= r["epoch"]
    before = ledger(recorded)
    ask()
    assert ledger(training.metrics(spark, folder)) == before
