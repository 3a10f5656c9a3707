"""Awkward tables for every operator and pipeline stage: nulls, empty and long texts, ties, repeats, clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kelpline.llm import blob_secrets, bpe, line_dedup, mixing, near_dup, neighbours, pii, quality, queries, token_counts, warc
from kelpline.llm.common import new_folder

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, COLUMNS)
    if extra:
        for name in ("key", "n", "sig", "ids", "decoded", "size", "base", "at", "doc", "mark", "kept", "n_removed", "entities", "bucket", "label", "_removed", "_key", "taken"):
            df = df.withColumn(name, F.lit("x"))
    return df


AWKWARD = [
    (1, "a b c d e f g h", "en", "s", 15),
    (1, "a b c d e f g h", "en", "s", 15),
    (2, "a b c d e f g h", "en", "s", 15),
    (3, None, "en", "s", None),
    (4, "", None, "s", 0),
    (5, " \n\t ", "en", None, 4),
    (None, "a b c d e f g h", None, None, 15),
    (6, "x" * 100_000, "en", "s", 100_000),
    (7, LONG, "de", "t", len(LONG)),
    (8, "token = abcdef12 mail a.b@c.example.com \x00 é 漢字 😀", "de", "t", 40),
]


@pytest.fixture(scope="module", params=["empty", "awkward", "clashing", "all null"])
def docs(request, spark):
    rows = {"empty": [], "all null": [(None, None, None, None, None)] * 3}.get(request.param, AWKWARD)
    return table(spark, rows, request.param == "clashing")


def ids(df, name="doc_id"):
    return sorted((r[0] for r in df.select(name).collect()), key=repr)


def test_surrogates(docs):
    out = pii.replaced(docs, "secret")
    assert ids(out) == ids(docs) and set(out.columns) == set(docs.columns) | {"entities"}


def test_near_duplicates(docs):
    out = near_dup.near_duplicates(docs)
    assert ids(out) == ids(docs)
    for r in out.collect():
        assert r["doc_id"] is not None or r["kept"]
        assert r["n_shingles"] > 0 or r["component_id"] == r["doc_id"]


def test_line_dedup(docs):
    out = line_dedup.without_repeats(docs)
    assert ids(out) == ids(docs) and set(out.columns) == set(docs.columns) | {"n_removed"}
    assert out.filter("text IS NULL").count() == docs.filter("text IS NULL").count()


def test_mixing(docs):
    out = mixing.plan(docs)
    assert ids(out) == ids(docs)
    assert out.filter("taken > 2 * size OR taken < 0 OR (size = 0 AND taken > 0)").count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns


def test_warc(docs, spark):
    folder = new_folder(spark, "warc")
    warc.write_archives(warc.plan_records(docs, "doc_id", "source", "text"), folder)
    found = warc.read_archives(spark, folder)
    assert found.filter("reason IS NULL").count() == docs.count() and found.filter("reason IS NOT NULL").count() == 0


def test_token_counts(docs):
    out = docs.withColumn("n_tokens", token_counts.counter(docs, queries.vocabulary("piece_bpe_32k.model")))
    assert ids(out) == ids(docs)
    assert all(r["n_tokens"] == 0 for r in out.filter("text IS NULL OR text = ''").collect())


def test_quality(docs):
    out = quality.judge(docs)
    assert ids(out) == ids(docs)
    assert out.filter("kept IS NULL OR base_failed IS NULL").count() == 0


def test_bpe(docs):
    source = queries.vocabulary("byte_bpe_50k.json")
    out = bpe.decode(bpe.encode(docs, source), source)
    assert ids(out) == ids(docs) and set(out.columns) == set(docs.columns) | {"ids", "decoded"}
    assert out.filter("decoded <> coalesce(text, '')").count() == 0


def test_secrets(docs, spark):
    ledger = new_folder(spark, "ledger")
    out = blob_secrets.scan(docs, ledger)
    assert ids(out) == ids(docs)
    assert blob_secrets.read_ledger(spark, ledger).count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_neighbours(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).withColumn("score", F.lit(2))
    got = [tuple(r) for r in neighbours.nearest(df, df.filter("vec_id % 100 = 0"), 3).orderBy("query_id", "rank").collect()]
    root = 2**0.5
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert [s for *_, s in got] == pytest.approx([0, 0, root, root, root, root], abs=1e-12)
    none = df.filter("vec_id = -1")
    assert neighbours.nearest(none, none, 3).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, name, stage):
    out = stage(spark, docs, "unused")
    if name == "bpe":
        assert ids(out) == ids(docs) and out.filter("NOT round_trip").count() == 0
    else:
        assert out.columns == docs.columns
    out.count()
    assert public_tokenizers.path("byte_bpe_50k.json")
