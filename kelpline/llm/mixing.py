"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Words stand for tokens. The mix has as many words as its targets hold; sources get them by highest
quotients target / (2k + 1). A source is cut into blocks of equal length, 32 words unless its quota
is so small that a block would be over a 256th of it. The same rule deals a source's blocks to
bundles of shards and a bundle's blocks to its shards. A shard is a seeded share of a source's
documents in seeded order, read as one stream of words that is cut into blocks. Each block is taken
as often as all of them can be, and the rest of the quota picks blocks at even steps from a seeded
start.

Sources, of which there may be many, are ranked by ranges over the cluster. A window holds the
bundles of one source (one row for each SHARD_DOCS * BUNDLE_SHARDS = 524,288 documents), the at most
BUNDLE_SHARDS shards of one bundle, or the some SHARD_DOCS documents of one shard.

The number of words taken from a document is a difference of two closed forms, so blocks are never
made into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.common import in_order, n_words_of, stage_table, words_of

SHARD_DOCS, BUNDLE_SHARDS = 512, 1024
#: A block holds at most one part in so many of its source's quota.
FINENESS = 256


def water_level(rows: DataFrame, total: float) -> float:
    """The x at which the sum of ``least(_cap, x * _w)`` over ``rows`` is ``total``; infinite if the caps hold less.

    Each pass fills the rows that the level so far would fill and shares the rest by weight; it ends
    when no further row is filled. Few passes do, as each can fill many rows; two sums come back.
    """
    level, filled = 0.0, -1
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("_w")
        n, held, free = rows.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w")))).first()
        if not free:
            return float("inf")
        if n == filled:
            return level
        level, filled = (total - (held or 0.0)) / free, n


def _between(lo: Column, hi: Column) -> list[Column]:
    """From the levels that give n/2 seats too few and too many: seats that are sure, and one over the last that may be won."""
    cap = F.col("_cap").cast("long")
    sure = F.greatest(F.lit(0), F.floor(lo * F.col("_w") - 0.5)).cast("double")
    most = F.when((F.col("_w") > 0) & (hi > 0), F.ceil(hi * F.col("_w") + 1.5)).otherwise(F.lit(0))
    return [F.least(F.col("_cap"), sure).cast("long").alias("_lo"), F.least(cap, most.cast("long")).alias("_hi")]


def _quotients(rows: DataFrame) -> DataFrame:
    """One row for each quotient between the bounds, or one with a null ``_k`` where there is none."""
    made = rows.withColumn("_k", F.explode_outer(F.when(F.col("_hi") > F.col("_lo"), F.sequence("_lo", F.col("_hi") - 1))))
    return made.withColumn("_quotient", F.when(F.col("_k").isNotNull(), F.col("_w") / (2 * F.col("_k") + 1)))


def _weighed(df: DataFrame, weight: str, cap: Column) -> DataFrame:
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    return df.withColumn("_w", w).withColumn("_cap", F.when(w > 0, F.greatest(cap.cast("long"), F.lit(0))).otherwise(0).cast("double"))


def apportion_all(df: DataFrame, order: list[Column], weight: str, seats: int, cap: Column) -> DataFrame:
    """``apportion`` of one group that may have any number of rows; ``order`` tells them apart."""
    rows = stage_table(_weighed(df, weight, cap), "weighed")
    n = rows.count()
    lo, hi = (F.lit(min(water_level(rows, seats + side * n / 2), 1e300)) for side in (-1, 1))
    bounds = rows.select("*", *_between(lo, hi))
    left = seats - (bounds.agg(F.sum("_lo")).first()[0] or 0)
    placed = in_order(_quotients(bounds), [F.col("_quotient").desc_nulls_last(), *order, F.col("_k").asc()], "_place")
    return _counted(df, placed.withColumn("_won", (F.col("_k").isNotNull() & (F.col("_place") < left)).cast("long")))


def apportion(df: DataFrame, group: list[str], order: list[str], weight: str, seats: Column, cap: Column) -> DataFrame:
    """Sainte-Lague: ``df`` with ``quota``, the seats of each row out of its group's ``seats``.

    Rows with the highest quotients weight / (2k + 1) get the seats; ties go by ``order``. No row
    gets more than ``cap``: its quotients end there, and the seats go to the next highest of the
    others, so that all are given unless the caps of a group hold fewer. A row with weight 0 or null
    gets none. With n rows in a group, all divisors that can be right lie between those that give
    seats - n/2 and seats + n/2 without rounding, so only quotients between the two bounds are made:
    about 3 n of them.
    """
    every = Window.partitionBy(*group)
    by_limit = every.orderBy("_ratio", *order)
    earlier = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def level(side: int) -> Column:
        """As ``water_level``: rows fill up in order of cap by weight; the first that doesn't sets the level."""
        x = F.try_divide(F.col("_seats") + side * F.col("_n") / 2.0 - F.col("_filled"), F.col("_free"))
        return F.coalesce(F.first(F.when(x <= F.col("_ratio"), x), ignorenulls=True).over(whole), F.lit(1e300))

    ready = (
        _weighed(df, weight, cap).withColumn("_seats", F.coalesce(seats.cast("long"), F.lit(0))).withColumn("_n", F.count(F.lit(1)).over(every))
        .withColumn("_ratio", F.coalesce(F.try_divide("_cap", "_w"), F.lit(0.0)))
        .withColumn("_filled", F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0)))
        .withColumn("_free", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0)))
        .withColumn("_low_level", level(-1)).withColumn("_high_level", level(1))
    )
    bounds = ready.select("*", *_between(F.col("_low_level"), F.col("_high_level")))
    made = _quotients(bounds.withColumn("_left", F.col("_seats") - F.sum("_lo").over(every)))
    best = every.orderBy(F.col("_quotient").desc_nulls_last(), *order, "_k")
    return _counted(df, made.withColumn("_won", (F.col("_k").isNotNull() & (F.row_number().over(best) <= F.col("_left"))).cast("long")))


def _counted(df: DataFrame, won: DataFrame) -> DataFrame:
    return won.groupBy(*df.columns, "_lo").agg(F.sum("_won").alias("_won")).select(*df.columns, (F.col("_lo") + F.col("_won")).alias("quota"))


def targets(sources: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources`` (source, source_size, ...) with ``target``.

    Sources by code point, null last, weigh as ``weights`` repeats, and share ``share`` of all
    words. A target stops at ``most`` times its source's size; the excess is shared again by weight
    until none is above.
    """
    placed = in_order(sources, [F.col("source").asc_nulls_last()], "_place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("_place", F.lit(len(weights))) + 1).cast("int"))
    held = stage_table(placed.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size").cast("double")), "weights")
    level = water_level(held, share * float(held.agg(F.sum("source_size")).first()[0] or 0))
    target = F.col("_cap") if level == float("inf") else F.least(F.lit(level) * F.col("_w"), F.col("_cap"))
    return held.select(*sources.columns, target.cast("double").alias("target"))


def plan(docs: DataFrame, seed: int = 0, block: int = 32, key: str = "doc_id", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: int = 2) -> DataFrame:
    """How much of each document the mix takes.

    Columns: ``key``, ``source``, ``size`` (words), ``source_size``, ``target`` (of the source),
    ``taken`` (words, repeats counted), ``mark`` (hash of the text), ``base`` (copies of the whole text) and, for the words of
    single blocks beyond them, ``block`` (words of a block), ``at`` (the document's place in its
    shard's stream), ``n_blocks``, ``extra`` and ``start``. A null or empty text has size 0 and
    nothing of it is taken; a null source is a source of its own, the last. Repeated rows are mixed
    as documents of their own. Which documents a shard holds, their order and the start depend only
    on ``seed``, keys and texts, so a run can be repeated; no document is taken more than ``most``
    times. Texts of any length count whole; of a long one blocks may be taken. An empty table gives an
    empty plan.
    """
    sizes = stage_table(
        docs.select(F.col(key).alias("key"), "source", n_words_of(F.col("text")).alias("size"), F.xxhash64(F.col(key).cast("string"), "text", F.lit(seed)).alias("draw"), F.xxhash64("text").alias("mark")), "sizes"
    )
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, share, float(most))
    sources = stage_table(sources, "sources")
    n_words = round(sources.agg(F.sum("target")).first()[0] or 0)
    sources = apportion_all(sources, [F.col("source").asc_nulls_last()], "target", n_words, most * F.col("source_size"))
    of_source = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("quota") / F.lit(FINENESS)))).cast("long")
    sources = stage_table(sources.withColumn("block", of_source), "quotas")
    n_shards = F.ceil(F.col("n_docs") / F.lit(SHARD_DOCS)).cast("long")
    same = sizes["source"].eqNullSafe(sources["source"])
    dealt = sizes.join(sources.hint("broadcast") if _few(sources) else sources, same).select(
        "key", sizes["source"], "size", "draw", "mark", "source_size", "target", "block", F.pmod(F.xxhash64("draw"), n_shards).alias("shard")
    )
    shards = dealt.groupBy("source", "shard", "block").agg(F.sum("size").alias("length")).withColumn("bundle", F.floor(F.col("shard") / BUNDLE_SHARDS)).withColumn("n_blocks", F.ceil(F.col("length") / F.col("block")).cast("long"))
    shards = stage_table(shards, "shards")
    bundles = shards.groupBy("source", "bundle").agg(F.sum("length").alias("length"), F.sum("n_blocks").alias("n_blocks"))
    limit = F.col("n_blocks") * most
    per_source = bundles.groupBy("source").agg(F.sum("n_blocks").alias("n_blocks"), F.sum("length").alias("length"))
    # The last block of a shard is shorter than others, so a seat is worth the mean length of the source's blocks.
    seats = F.coalesce(F.round(F.try_divide(F.col("quota") * F.col("n_blocks").cast("double"), F.col("length"))), F.lit(0.0)).cast("long")
    top = per_source.join(sources, per_source["source"].eqNullSafe(sources["source"])).select(per_source["source"], seats.alias("seats"))
    top = stage_table(top, "seats")
    middle = bundles.join(top, bundles["source"].eqNullSafe(top["source"])).select(bundles["source"], "bundle", "length", "n_blocks", "seats")
    middle = stage_table(apportion(middle, ["source"], ["bundle"], "length", F.col("seats"), limit).select("source", "bundle", F.col("quota").alias("seats")), "bundles")
    low = shards.join(middle, shards["source"].eqNullSafe(middle["source"]) & (shards["bundle"] == middle["bundle"])).select(shards["source"], shards["bundle"], "shard", "length", "n_blocks", "seats")
    low = apportion(low, ["source", "bundle"], ["shard"], "length", F.col("seats"), limit)
    low = low.select(
        F.col("source").alias("s"), F.col("shard").alias("h"), "n_blocks",
        F.when(F.col("n_blocks") > 0, F.floor(F.col("quota") / F.col("n_blocks"))).otherwise(0).cast("long").alias("base"),
        F.when(F.col("n_blocks") > 0, F.pmod("quota", "n_blocks")).otherwise(0).cast("long").alias("extra"),
        F.when(F.col("n_blocks") > 0, F.pmod(F.xxhash64("source", "shard", F.lit(seed)), F.col("n_blocks"))).otherwise(0).cast("long").alias("start"),
    )
    low = stage_table(low, "shard_quotas")
    stream = Window.partitionBy("source", "shard").orderBy("draw", "key", "mark", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("at", F.coalesce(F.sum("size").over(stream), F.lit(0)).cast("long"))
    joined = placed.join(low, placed["source"].eqNullSafe(low["s"]) & (placed["shard"] == low["h"]))
    taken = F.col("base") * F.col("size") + picked_until(F.col("at") + F.col("size")) - picked_until(F.col("at"))
    return joined.select(F.col("key").alias(key), "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "mark", "base", "block", "at", "n_blocks", "extra", "start")


def _few(sources: DataFrame, most: int = 100_000) -> bool:
    """Whether the table of sources, one narrow row each, is small enough to be broadcast."""
    return len(sources.select(F.lit(1)).take(most + 1)) <= most


def picks_before(j: Column) -> Column:
    """How many of the shard's first ``j`` blocks are picked beyond the base copies."""
    return F.when(F.col("n_blocks") > 0, F.floor((j * F.col("extra") + F.col("start")) / F.col("n_blocks"))).otherwise(0).cast("long")


def picked_until(at: Column) -> Column:
    """How many of the shard's first ``at`` words lie in picked blocks."""
    block = F.col("block")
    j = F.floor(at / block).cast("long")
    return picks_before(j) * block + (at - j * block) * (picks_before(j + 1) - picks_before(j))


def mix(docs: DataFrame, seed: int = 0, block: int = 32, key: str = "doc_id") -> DataFrame:
    """The mixed documents, with the columns of ``docs``.

    A document comes as often as it has base copies, with its whole text, and once more with the
    words of its picked blocks, joined by spaces, if there are any. Documents of which nothing is
    taken are left out, also those without words. Rows with equal key, source and text are taken
    alike, as the first of them in the plan is.
    """
    chosen = plan(docs, seed, block, key).filter("taken > 0").dropDuplicates([key, "source", "mark"])
    chosen = chosen.select(F.col(key).alias("_key"), F.col("source").alias("_source"), F.col("mark").alias("_mark"), "size", "taken", "base", "block", "at", "n_blocks", "extra", "start")
    same = docs[key].eqNullSafe(chosen["_key"]) & docs["source"].eqNullSafe(chosen["_source"]) & (F.xxhash64(docs["text"]) == chosen["_mark"])
    held = docs.join(chosen.hint("shuffle_hash"), same).select(*(docs[f"`{c}`"].alias(f"doc_{c}") for c in docs.columns), *(chosen[c] for c in ("size", "taken", "base", "block", "at", "n_blocks", "extra", "start")))
    text = F.col("doc_text")
    part = F.array_join(F.filter(words_of(text), lambda w, i: _picked(F.floor((F.col("at") + i) / F.col("block")))), " ")
    copies = F.concat(
        F.when(F.col("base") > 0, F.array_repeat(F.lit(False), F.col("base").cast("int"))).otherwise(F.array().cast("array<boolean>")),
        F.when(F.col("taken") > F.col("base") * F.col("size"), F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")),
    )
    rows = held.withColumn("_partial", F.explode(copies))
    return rows.select(*(F.when(F.col("_partial"), part).otherwise(text).alias("text") if c == "text" else F.col(f"`doc_{c}`").alias(c) for c in docs.columns))


def _picked(j: Column) -> Column:
    return (picks_before(j + 1) - picks_before(j)) > 0
