"""A corpus pipeline out of the text operators: what quality rules and deduplication leave, mixed and encoded.

Each stage works on all that the one before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import bpe, line_dedup, mixing, near_dup, quality
from kelpline.llm.common import SPACES, stage_table, with_rows
from kelpline.llm.queries import vocabulary

#: Rows of one long each that may be broadcast; beyond that they are joined by a shuffle.
MOST_BROADCAST = 500_000


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The ``rows`` of ``with_rows`` whose ``__row`` isn't in ``dropped``, without that column."""
    dropped = stage_table(dropped.select(F.col("__row").alias("__dropped")), "dropped")
    few = dropped.count() <= MOST_BROADCAST
    return rows.join(F.broadcast(dropped) if few else dropped.hint("shuffle_hash"), F.col("__row") == F.col("__dropped"), "left_anti").drop("__row")


def with_lengths(docs: DataFrame) -> DataFrame:
    """``n_chars`` says how long the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them. Each row is judged by itself, whatever its id."""
    rows = with_rows(docs)
    return without(rows, quality.judge(rows, "__row").filter("NOT kept"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and with them documents of which no word is left. Null and empty texts stay as they are."""
    left = line_dedup.without_repeats(docs).filter((F.col("n_removed") == 0) | (F.btrim("text", F.lit(SPACES)) != ""))
    return with_lengths(left.select(*docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id, nulls last, or of equal ids the first row.

    Rows are documents of their own: an id that stands for several texts loses only the copies.
    """
    rows = with_rows(docs)
    groups = near_dup.near_duplicates(rows, key="__row").filter("n_shingles > 0").select("__row", "component_id")
    groups = stage_table(groups.join(rows.select("__row", "doc_id"), "__row"), "groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first"), F.count(F.lit(1)).alias("n"))
    staying = stage_table(first.filter("n > 1").select("component_id", F.col("first.__row").alias("__stays")), "staying")
    return without(rows, groups.join(staying, "component_id").filter("__row <> __stays"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: documents are repeated, taken in part or left out."""
    return with_lengths(mixing.mix(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and whether decoding them gives the text again; a null text counts as an empty one, which has no ids."""
    source = vocabulary("byte_bpe_50k.json")
    both = bpe.round_trip(docs, source)
    text = F.coalesce("text", F.lit(""))
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == text).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: SQL can't express the stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn on ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
