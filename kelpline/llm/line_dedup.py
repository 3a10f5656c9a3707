"""Line dedup by a suffix array over line numbers, built by distributed prefix doubling.

Lines with a word are numbered in the order of their hashes; blank lines don't count. Only lines
that occur twice or more matter: a stretch of them between others is a string, and its suffixes are
ranked by their first 1, 2, 4, ... lines. A round pairs each suffix's rank with that of the suffix
as many lines on, sorts the distinct pairs by ranges over the cluster, and numbers them in order.

A run counts if it has ``least_words`` words, so it is settled by at most as many lines, and the
doubling stops at that depth: suffixes with equal first lines of a run are an interval of the array
whose common prefix has at least that many words, and two overlapping ranks name it. In each
interval the suffix that comes first in the corpus stays and the lines of the run are deleted at all
others. Minimal runs are taken forward from each line and backward to each line.

Why that depth is enough: let a maximal repeated run R stand at places p (earlier) and q. Each line
x of R at q lies in a minimal run inside R: the one forward from x, or the one backward to x, or, if
R has too few words on either side of x, the one forward from R's first line, which then can't end
before x. That minimal run occurs at the same offset of p, so q isn't its first place and x goes.
Conversely a deleted line lies in a minimal run, which is a repeated run itself with an earlier
place. So the deleted lines are those of all maximal runs' later copies, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.common import SPACES, n_words_of, stage_table

LEAST_WORDS = 20


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct ``rows`` with ``name``, a long that grows in the order of ``by`` over all partitions."""
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return stage_table(ordered.withColumn(name, F.monotonically_increasing_id() + 1), name)


def lines_of(docs: DataFrame, key: str) -> DataFrame:
    """One row per line with a word: doc, mark (hash of the text), at (its place among them), idx (among all lines), n_words, h1, h2.

    Spark chains hashes as seeds, so ``h2`` hashes the line from another seed than ``h1``: a line is
    known by 128 bits.
    """
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    full = F.filter(lines, lambda s: F.btrim(s["x"], F.lit(SPACES)) != "")
    each = docs.select(F.col(key).alias("doc"), F.xxhash64("text").alias("mark"), F.posexplode(full).alias("at", "line"))
    line = F.col("line.x")
    return each.select("doc", "mark", "at", F.col("line.i").alias("idx"), n_words_of(line).alias("n_words"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def suffix_ranks(active: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """``active`` lines with ranks r0, r1, ... of their suffixes by 1, 2, 4, ... lines, up to ``depth``, and the number of ranks.

    A suffix that ends before has rank 0 there, so it comes before those that go on.
    """
    level = 0
    while 2 << level <= depth:
        string = Window.partitionBy("doc", "mark", "stretch").orderBy("at")
        paired = stage_table(active.withColumn("on", F.coalesce(F.lead(f"r{level}", 1 << level).over(string), F.lit(0))), "paired")
        pairs = numbered(paired.select(f"r{level}", "on").distinct(), [f"r{level}", "on"], f"r{level + 1}")
        active = paired.join(pairs, [f"r{level}", "on"]).drop("on")
        level += 1
    return stage_table(active, "ranks"), level + 1


def minimal_runs(ranks: DataFrame, n_ranks: int, least_words: int) -> DataFrame:
    """Shortest runs of ``least_words`` words from each line and to each line: name, doc, mark, start, idxs."""
    string = Window.partitionBy("doc", "mark", "stretch").orderBy("at")

    def to_length(words: Column) -> Column:
        """How many of the first values reach the sum, or null."""
        step = lambda s, x: F.when(s["sum"] >= least_words, s).otherwise(F.struct((s["sum"] + x).alias("sum"), (s["n"] + 1).alias("n")))
        return F.aggregate(words, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n")), step, lambda s: F.when(s["sum"] >= least_words, s["n"]))

    def runs(frame, first: Column, words: Column) -> DataFrame:
        near = ranks.select("doc", "mark", "at", F.collect_list(F.struct("n_words", "idx", *(f"r{k}" for k in range(n_ranks)))).over(frame).alias("near"))
        sized = near.withColumn("n", to_length(words)).filter("n IS NOT NULL")
        sized = sized.withColumn("run", F.slice("near", first, F.col("n"))).withColumn("level", F.floor(F.log2("n") + 1e-9).cast("int"))
        pick = lambda s: F.array(*(s[f"r{k}"] for k in range(n_ranks)))[F.col("level")]
        # The last rank starts as many lines before the run's end as it covers.
        tail = F.element_at("run", (F.col("n") - F.pow(F.lit(2), F.col("level")) + 1).cast("int"))
        start = F.element_at("run", 1)
        return sized.select("doc", "mark", F.col("n"), pick(start).alias("head"), pick(tail).alias("tail"), start["idx"].alias("start"), F.transform("run", lambda s: s["idx"]).alias("idxs"))

    ahead = runs(string.rowsBetween(0, least_words - 1), F.lit(1), F.transform("near", lambda s: s["n_words"]))
    behind = runs(string.rowsBetween(1 - least_words, 0), F.size("near") - F.col("n") + 1, F.reverse(F.transform("near", lambda s: s["n_words"])))
    return ahead.unionByName(behind).distinct()


def repeated_lines(docs: DataFrame, key: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc``, ``mark`` (hash of the text) and ``removed``, the places of its lines that are later copies.

    A line is a later copy if a run of consecutive lines with words in one document holds it, has
    ``least_words`` words or more, and occurs in the same form at an earlier place. Places are
    ordered by key (null first), text hash and line. Rows with equal key and text are one document.
    """
    lines = stage_table(lines_of(docs, key), "lines")
    again = numbered(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), ["h1", "h2"], "r0")
    active = lines.join(again, ["h1", "h2"]).select("doc", "mark", "at", "idx", "n_words", "r0").distinct()
    in_order = Window.partitionBy("doc", "mark").orderBy("at")
    active = active.withColumn("stretch", F.col("at") - F.row_number().over(in_order))
    ranks, n_ranks = suffix_ranks(active, least_words)
    runs = stage_table(minimal_runs(ranks, n_ranks, least_words), "runs")
    name = ["n", "head", "tail"]
    place = F.struct("doc", "mark", "start")
    # Written out, so that the join reads both sides from plain exchanges, of which Spark splits the one that holds a very common run.
    firsts = stage_table(runs.groupBy(*name).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times"), "firsts")
    later = runs.join(firsts, name).filter(place > F.col("first"))
    # A line lies in many runs; its places are made distinct before a document's meet.
    lines = later.select("doc", "mark", F.explode("idxs").alias("idx")).distinct()
    return lines.groupBy("doc", "mark").agg(F.array_sort(F.collect_list("idx")).alias("removed"))


def without_repeats(docs: DataFrame, key: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the later copies of repeated line runs deleted from ``text``, and ``n_removed``.

    The lines that stay keep their order and are joined by newlines; a text from which nothing goes
    is as it was, also null and empty ones. Rows keep their number. A column ``n_removed`` of
    ``docs`` is replaced. Texts move once, by key, to meet the places of what goes; the cost is linear in
    the lines of a text, of which there may be any number.
    """
    gone = stage_table(repeated_lines(docs, key, least_words), "removed").select(F.col("doc").alias("__gone_doc"), F.col("mark").alias("__gone_mark"), F.col("removed").alias("__gone_removed"))
    plain = docs.drop("n_removed")
    met = plain.join(gone.hint("shuffle_hash"), plain[key].eqNullSafe(gone["__gone_doc"]) & (F.xxhash64(plain["text"]) == gone["__gone_mark"]), "left")
    places = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone_removed"))
    # Lines are split once, and what stays is found by hash, so the cost is linear in a text's lines.
    kept = F.transform(F.array(F.split("text", "\n", -1)), lambda lines: F.array_join(F.transform(places(lines), lambda i: F.get(lines, i)), "\n"))[0]
    text = F.when(F.col("__gone_removed").isNull(), F.col("text")).otherwise(kept)
    return met.select(*(text.alias(c) if c == "text" else plain[f"`{c}`"] for c in plain.columns), F.when(F.col("__gone_removed").isNull(), 0).otherwise(F.size("__gone_removed")).cast("long").alias("n_removed"))
