"""Every registered query that has an oracle agrees with DuckDB on the small tables."""

import os

import duckdb
import numpy as np
import pytest

from kelpline.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, (float, np.floating)):
        return None if np.isnan(x) else round(float(x), 6) + 0.0
    return x.item() if isinstance(x, np.generic) else x


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(plain(x) for x in r) for r in frame.where(frame.notna(), None).itertuples(index=False, name=None)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_sequences_hold_whole_texts(spark, duck):
    turns = duck.sql("SELECT conv_id, turn, text FROM conversations").fetchall()
    ids = {(c, t): [len(w) for w in text.split(" ")] for c, t, text in turns}
    most = {}
    for (c, _), x in ids.items():
        most[c] = max(most.get(c, 0), len(x))
    padded = {(r["conv_id"], r["turn"]): r["ids"] for r in registry.QUERIES["pad_sequences"](spark, DATA).collect()}
    rest = {(r["conv_id"], r["turn"]): r["rest"] for r in registry.QUERIES["trim_prefix"](spark, DATA).collect()}
    assert padded == {(c, t): ",".join(map(str, [-1] * (most[c] - len(x)) + x)) for (c, t), x in ids.items()}
    assert rest == {k: ",".join(map(str, x[3:])) for k, x in ids.items()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_intensities_of_all_scales(spark, duck):
    one = duck.sql("SELECT min(user_id) FROM events").fetchall()[0][0]
    x = np.array([v for (v,) in duck.sql(f"SELECT value FROM events WHERE user_id = {one} ORDER BY ts, event_id").fetchall()])
    x = (x - x.min()) / (x.max() - x.min())
    lag = np.arange(len(x))[:, None] - np.arange(len(x))
    power = {}
    for s in range(1, 128):
        u = lag / s
        power[s] = np.abs(np.where(np.abs(u) <= 8, np.exp(-u * u / 2) * np.cos(5 * u), 0) @ x) / np.sqrt(s)
    top = max(p.max() for p in power.values())
    got = registry.QUERIES["scalogram_intensity"](spark, DATA).filter(f"series_id = {one}").collect()
    assert len(got) == 127 * len(x)
    for r in got:
        assert abs(r["intensity"] - (0.5 + power[r["scale"]][r["n"] - 1] / (2 * top))) < 1e-4
