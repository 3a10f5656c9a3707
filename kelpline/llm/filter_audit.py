"""Filter interaction audit: what each of five filters removes in every order, with duplicates by partition refinement.

Texts with equal content are found by refinement: documents are split by their length in code
points, then by the hash of their first, second, ... block, and a class of one document is dropped
before the next block counts. Blocks grow eightfold, so the longest text sets the number of rounds,
which is logarithmic. Hashes are taken in the one scan of the texts; the rounds move narrow rows.
The full texts of the classes that survive are compared, so that a hash collision joins nothing.

A document's five verdicts are five bits. Documents are counted by part and mask, and the rows of
all 120 orders come from these at most 32 counts of a part. All of it is DataFrame functions.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import stage_table, words_of

#: The filters; the place of a letter is its bit.
LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(LETTERS)]
#: Code points of the first block, and how much longer each block's end lies than the one before.
FIRST, GROWTH = 64, 8
ENDS = [FIRST * GROWTH**k for k in range(9)]


def blocks_of(text: Column) -> Column:
    """Hashes of the successive blocks of a text, which cover all of it; none for an empty text."""
    cuts = F.array(*(F.struct(F.lit(lo).alias("lo"), F.lit(hi - lo).alias("size")) for lo, hi in zip([0, *ENDS], [min(e, 2**31 - 1) for e in ENDS])))
    used = F.filter(cuts, lambda c: c["lo"] < F.length(text))
    return F.transform(used, lambda c: F.xxhash64(F.substring(text, c["lo"] + 1, c["size"])))


def chained(length: Column, blocks: Column) -> Column:
    """The class of a text after all of its blocks."""
    return F.aggregate(blocks, length.cast("long"), lambda c, h: F.xxhash64(c, h))


def surviving_classes(rows: DataFrame) -> DataFrame:
    """``n_chars`` and ``chain`` of the classes of two or more ``rows`` (n_chars, blocks) that no block tells apart."""
    alive = rows.select("n_chars", "blocks", F.col("n_chars").cast("long").alias("cls"))
    ended, k = None, 0
    while True:
        again = stage_table(alive.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cls"), "classes")
        alive = stage_table(alive.join(again, "cls", "left_semi"), "alive")
        done = alive.filter(F.size("blocks") <= k).select("n_chars", F.col("cls").alias("chain")).distinct()
        ended = done if ended is None else ended.unionByName(done)
        alive = alive.filter(F.size("blocks") > k)
        if alive.isEmpty():
            return stage_table(ended, "survivors")
        alive = alive.withColumn("cls", F.xxhash64("cls", F.col("blocks")[k]))
        k += 1


def verdicts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, part, and ``mask``: the bits of the filters that a document fails.

    A: under 200 words. B: distinct words under half of the words. C: more than 3 % of the code
    points are A-Z. D: holds one of ``#$%&*|``. E: its text stands under a smaller key. A null text is
    an empty one and a null language the part ''. Rows keep their number; repeated rows with one key
    don't make each other fail E, and a row without key neither fails E nor makes others fail. Texts
    of any length are read whole. Other columns are ignored. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    words = words_of(text)
    own = docs.select(F.col(key).alias("key"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    known = own.withColumn("words", words).withColumn("n_words", F.size("words")).withColumn("n_chars", F.length("text"))
    fails = [
        F.col("n_words") < 200,
        100 * F.size(F.array_distinct("words")) < 50 * F.col("n_words"),
        100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 3 * F.col("n_chars"),
        F.col("text").rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    found = stage_table(known.select("key", "part", mask.alias("mask"), "n_chars", blocks_of(F.col("text")).alias("blocks")), "verdicts")
    chain = chained(F.col("n_chars"), F.col("blocks"))
    classes = surviving_classes(found)
    # Full texts of what survives; equal ones collapse before they move.
    read = own.select("key", "part", "text", F.length("text").alias("n_chars")).withColumn("chain", chained(F.col("n_chars"), blocks_of(F.col("text"))))
    texts = read.join(classes, ["n_chars", "chain"], "left_semi").groupBy("n_chars", "chain", "text").agg(F.min("key").alias("first"))
    compared = stage_table(texts.groupBy("n_chars", "chain").agg(F.count(F.lit(1)).alias("n_texts"), F.min("first").alias("first")), "compared")
    rows = found.withColumn("chain", chain).join(compared, ["n_chars", "chain"], "left")
    again = F.coalesce(F.col("key") > F.col("first"), F.lit(False))
    marked = lambda df: df.select(F.col("key").alias(key), "part", (F.col("mask") + F.when(again, 16).otherwise(0)).alias("mask"))
    if compared.filter("n_texts > 1").isEmpty():
        return marked(rows)
    # Different texts with one chain of hashes: these meet by the text itself.
    mixed = compared.filter("n_texts > 1").select("n_chars", "chain")
    full = known.select("key", "part", mask.alias("mask"), "n_chars", "text").withColumn("chain", chained(F.col("n_chars"), blocks_of(F.col("text")))).join(mixed, ["n_chars", "chain"], "left_semi")
    exact = full.join(texts.join(mixed, ["n_chars", "chain"], "left_semi"), ["n_chars", "chain", "text"])
    return marked(rows.filter("coalesce(n_texts, 1) = 1")).unionByName(marked(exact))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each part, order of the filters and step.

    part, filter_order, step (from 1), and counts of the part's documents: kept (after the step),
    removed (by it), redundant (failing its filter, removed earlier), unique_fails (failing its filter
    only), good_lost and toxic_lost (removed by it and labelled so), shapley (removed by its filter at
    any step, summed over all orders: a document that fails k filters is removed by each of them in
    120 / k orders). Repeated labels of a key count once, a label that any of them gives; null and
    unknown keys have none. No documents give no rows.
    """
    marks = labels.groupBy(F.col(key).alias("_key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    masks = verdicts(docs, key)
    counts = masks.join(marks, masks[key] == marks["_key"], "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))
    every = held.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.array(*map(F.lit, range(1, 6)))))
    bits = F.create_map(*(F.lit(x) for i, letter in enumerate(LETTERS) for x in (letter, 1 << i)))
    at = every.withColumn("bits", F.transform(F.slice(F.split("filter_order", ""), 1, 5), lambda c: F.element_at(bits, c)))
    at = at.withColumn("own", F.element_at("bits", F.col("step"))).withColumn("before", F.aggregate(F.slice("bits", 1, F.col("step") - 1), F.lit(0), lambda s, b: s + b))

    def total(what: str, when) -> Column:
        return F.aggregate("held", F.lit(0).cast("long"), lambda s, h: s + F.when(when(h["mask"]), h[what]).otherwise(0))

    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~gone(m)
    share = F.aggregate("held", F.lit(0).cast("long"), lambda s, h: s + F.when(fails(h["mask"]), h["n"] * F.element_at(F.array(*(F.lit(len(ORDERS) // k) for k in range(1, 6))), F.bit_count(h["mask"]))).otherwise(0))
    return at.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", here).alias("removed"), total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), share.alias("shapley"),
    )
