"""Quality rules, with robust multivariate outliers of document statistics, in DataFrame functions only.

Each document gets a vector of transformed statistics. For each language and source the location
and scatter of these vectors are estimated by minimum covariance determinant: concentration steps
take the share of documents that lie closest to the current estimate and estimate again from them.
Three starts make a few steps each; the one whose scatter has the smallest determinant goes on until
it stops changing. The result of a source is drawn towards that of its language by as much as its
documents are few. Documents are rejected by their squared Mahalanobis distance from it.

The statistics are aggregated over all documents of a group; what travels is one narrow row per
document, pre-aggregated before each shuffle, and one row per group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import SPACES, stage_table, words_of

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
FEATURES = ("f_word", "f_symbol", "f_case", "f_repeat")
#: Share of a group's documents that the estimate is made from.
CORE = 0.75
#: Concentration steps of each start before determinants are compared.
FIRST_STEPS = 2
#: Concentration steps end once no group's location or factor moves by over SETTLED of a deviation,
#: which quantiles of rank error 1e-3 can reach, and after MOST_STEPS in any case.
SETTLED, MOST_STEPS = 0.01, 25
#: Fixed values, for 4 statistics: the chi-square quantile at CORE and the factor that makes the
#: scatter of the closest CORE share consistent for normal vectors, CORE / P(chi2 of 6 < quantile).
QUANTILE, CONSISTENT = 5.3853, 0.75 / 0.5046
#: Documents farther than this squared distance are rejected: the chi-square quantile of 1 - 1e-5
#: for 4 statistics.
CUTOFF = 28.47
#: A source of n documents that pass the base rules counts n, its language as so many documents.
LANGUAGE_DOCS = 40
#: Added to the variances, in order of FEATURES, so that no scatter is singular: what the shortest
#: texts that pass the base rules show by chance. The mean length of 20 words that scatter by half
#: of it has a variance of 0.0087 here; for symbols and capitals it is the square of one character
#: in 100 by CUTOFF, for repeats that of one window in 100 words.
FLOORS = (0.0087, 0.0004, 0.0004, 0.006)


def statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, ``lang``, ``source``, counts and the transformed statistics.

    Counts (long): n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a
    word that equal an earlier line), n_repeat_words (words in windows of 8 words that occur twice
    or more in the text). A null text counts as an empty one; it has zero everywhere.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(F.col(key), "lang", "source", text.alias("text")).withColumn("words", words_of(F.col("text")))
    hashed = words.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    # Hashes of 2, 4 and 8 words, each of two of the one before: that costs a few steps for a word, not WINDOW.
    # A window's hash is enough to tell it from the others of its text.
    for k in (1, 2, 4):
        held = F.greatest(F.size("hashes") - k, F.lit(0))
        hashed = hashed.withColumn("hashes", F.zip_with(F.slice("hashes", 1, held), F.slice("hashes", k + 1, held), lambda x, y: F.xxhash64(x, y)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counted = with_repeated_words(hashed).select(
        key, "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long").alias("n_upper"),
    )
    share = lambda c: F.col(c) / F.greatest(F.col("word_chars"), F.lit(1))
    return counted.select(
        key, "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.log1p(F.col("word_chars") / F.greatest("n_words", F.lit(1))).alias("f_word"),
        F.asin(F.sqrt(F.least(share("n_symbols"), F.lit(1.0)))).alias("f_symbol"),
        F.asin(F.sqrt(F.least(share("n_upper"), F.lit(1.0)))).alias("f_case"),
        F.asin(F.sqrt(F.least(F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)), F.lit(1.0)))).alias("f_repeat"),
    )


def with_repeated_words(rows: DataFrame) -> DataFrame:
    """``n_repeat_words``: the words in windows whose hash occurs twice or more in ``hashes``, as a long.

    Most texts repeat no window; for them only distinct hashes are counted. Otherwise the hashes
    are sorted with their places, those with an equal neighbour are kept, and the words between
    them are added up in order of place. Each step is a column of its own, so it is computed once.
    """
    many = F.size(F.array_distinct("hashes")) < F.size("hashes")
    ranked = F.when(many, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    pairs = F.size("ranked") - 1
    same = F.zip_with(F.slice("ranked", 1, pairs), F.slice("ranked", 2, pairs), lambda x, y: x["h"] == y["h"])
    twice = F.filter("ranked", lambda x, k: F.coalesce(F.get("same", k), F.lit(False)) | F.coalesce(F.get("same", k - 1), F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))

    def add(state: Column, i: Column) -> Column:
        return F.struct(i.alias("last"), (state["n"] + F.least(i - state["last"], F.lit(WINDOW))).cast("long").alias("n"))

    covered = F.aggregate(places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")), add, lambda s: s["n"])
    sorted_ = rows.withColumn("ranked", ranked).withColumn("same", F.when(F.col("ranked").isNotNull(), same))
    return sorted_.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("hashes", "ranked", "same")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]
MEANS = [f"m{i}" for i in range(4)]


def _floored(spread, factor: float = 1.0) -> list[Column]:
    """The scatter c00 ... c33 of ``spread(i, j)`` times ``factor``, with the floors added."""
    return [(factor * spread(i, j) + (F.lit(FLOORS[i]) if i == j else F.lit(0.0))).alias(f"c{i}{j}") for i, j in PAIRS]


def starts(rows: DataFrame) -> DataFrame:
    """Three first estimates per group: medians with deviations on the diagonal, the plain mean and covariance, and
    medians with the covariance of tanh scores, which far values bend little."""
    x = [F.col(c) for c in FEATURES]
    middle = rows.groupBy("grp").agg(*(F.percentile_approx(c, F.lit(0.5), F.lit(1000)).alias(f"m{i}") for i, c in enumerate(x)))
    deviation = [F.percentile_approx(F.abs(c - F.col(f"m{i}")), F.lit(0.5), F.lit(1000)).alias(f"d{i}") for i, c in enumerate(x)]
    medians = stage_table(_attach(rows, middle).groupBy("grp", *MEANS).agg(*deviation), "medians")
    scale = lambda i: F.greatest(1.4826 * F.col(f"d{i}"), F.lit(FLOORS[i] ** 0.5))
    diagonal = medians.select("grp", F.lit(0).alias("start"), *MEANS, *_floored(lambda i, j: scale(i) * scale(j) if i == j else F.lit(0.0)))
    moments = rows.groupBy("grp").agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(x)), *(F.covar_pop(x[i], x[j]).alias(f"v{i}{j}") for i, j in PAIRS))
    plain = moments.select("grp", F.lit(1).alias("start"), *MEANS, *_floored(lambda i, j: F.col(f"v{i}{j}")))
    score = [F.tanh((c - F.col(f"m{i}")) / scale(i)) for i, c in enumerate(x)]
    bent = _attach(rows, medians).groupBy("grp", *MEANS, *(f"d{i}" for i in range(4))).agg(*(F.covar_pop(score[i], score[j]).alias(f"v{i}{j}") for i, j in PAIRS))
    bent = bent.select("grp", F.lit(2).alias("start"), *MEANS, *_floored(lambda i, j: F.col(f"v{i}{j}") * scale(i) * scale(j)))
    return stage_table(cholesky(diagonal.unionByName(plain).unionByName(bent)), "start")


def concentrated(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step of each estimate: the mean and scatter of the CORE share of its group that lies closest.

    Documents as far as the last of them count too, and the quantile is approximate within 1e-3 of rank.
    """
    x = [F.col(c) for c in FEATURES]
    near = _attach(rows, estimate).select("grp", "start", *FEATURES, distance().alias("dist"))
    limit = near.groupBy("grp", "start").agg(F.percentile_approx("dist", F.lit(CORE), F.lit(1000)).alias("limit"))
    named = limit.withColumnsRenamed({"grp": "_grp", "start": "_start"})
    core = near.join(named, near["grp"].eqNullSafe(named["_grp"]) & (near["start"] == named["_start"])).filter("dist <= limit")
    mean = core.groupBy("grp", "start").agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(x)), *(F.covar_pop(x[i], x[j]).alias(f"v{i}{j}") for i, j in PAIRS))
    return stage_table(cholesky(mean.select("grp", "start", *MEANS, *_floored(lambda i, j: F.col(f"v{i}{j}"), CONSISTENT))), "step")


def robust_estimates(rows: DataFrame) -> DataFrame:
    """Location and scatter per group: ``grp``, ``m0`` ... ``m3`` (means) and ``l00`` ... ``l33`` (Cholesky factor).

    ``rows`` holds ``grp`` and the statistics. Aggregates only: each step is one pass with partial
    sums before the shuffle.
    """
    estimate = starts(rows)
    for _ in range(FIRST_STEPS):
        estimate = concentrated(rows, estimate)
    columns = [c for c in estimate.columns if c != "grp"]
    root = reduce(Column.__mul__, (F.col(f"l{i}{i}") for i in range(4)))  # of the determinant
    best = estimate.groupBy("grp").agg(F.min_by(F.struct(*columns), F.struct(root, F.col("start"))).alias("best"))
    estimate = stage_table(best.select("grp", "best.*"), "best")
    for _ in range(MOST_STEPS):
        before, estimate = estimate, concentrated(rows, estimate)
        if settled(before, estimate):
            break
    return estimate.drop("start")


def pooled(sources: DataFrame, languages: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each language and source of ``sizes`` (lang, source, n_group) the estimate of both together.

    It is the mean and scatter of a mixture of n_group parts of the source's estimate and
    LANGUAGE_DOCS parts of its language's, so a source of few documents is judged mostly by its
    language and one of many by itself, without a bound between.
    """
    named = lambda df, tag: df.withColumnsRenamed({c: f"{tag}{c}" for c in df.columns})
    own, wide = named(sources, "s_"), named(languages, "w_")
    met = sizes.join(own, F.col("lang").eqNullSafe(F.col("s_grp.lang")) & F.col("source").eqNullSafe(F.col("s_grp.source")), "left").join(wide, F.col("lang").eqNullSafe(F.col("w_grp.lang")))
    w = F.when(F.col("s_m0").isNull(), 0.0).otherwise(F.col("n_group") / (F.col("n_group") + F.lit(float(LANGUAGE_DOCS))))
    met = met.withColumn("w", w)
    of = lambda tag, i: F.coalesce(F.col(f"{tag}m{i}"), F.col(f"w_m{i}"))
    scatter = lambda tag, i, j: F.coalesce(reduce(Column.__add__, (F.col(f"{tag}l{i}{k}") * F.col(f"{tag}l{j}{k}") for k in range(j + 1))), F.lit(0.0))
    w, rest = F.col("w"), 1 - F.col("w")
    means = [(w * of("s_", i) + rest * of("w_", i)).alias(f"m{i}") for i in range(4)]
    both = [(w * scatter("s_", i, j) + rest * scatter("w_", i, j) + w * rest * (of("s_", i) - of("w_", i)) * (of("s_", j) - of("w_", j))).alias(f"c{i}{j}") for i, j in PAIRS]
    return stage_table(cholesky(met.select(F.struct("lang", "source").alias("grp"), F.lit(0).alias("start"), *means, *both)).drop("start"), "pooled")


def settled(before: DataFrame, after: DataFrame) -> bool:
    """Whether no group's location or factor has moved by over SETTLED of its deviations."""
    after = after.withColumnsRenamed({c: f"_{c}" for c in after.columns})
    moved = lambda c, i: F.abs(F.col(f"_{c}") - F.col(c)) > SETTLED * F.col(f"_l{i}{i}")
    changes = [moved(f"m{i}", i) for i in range(4)] + [moved(f"l{i}{j}", i) for i in range(4) for j in range(i + 1)]
    return before.join(after, F.col("grp").eqNullSafe(F.col("_grp"))).filter(reduce(Column.__or__, changes)).isEmpty()


def _attach(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row with what its group has; groups are one narrow row each, so a plain join is fine."""
    named = groups.withColumnRenamed("grp", "_grp")
    return rows.join(named, rows["grp"].eqNullSafe(named["_grp"])).drop("_grp")


def cholesky(estimate: DataFrame) -> DataFrame:
    """Adds the columns l00 ... l33 of the factor of the scatter c00 ... c33, which has positive floors."""
    for i in range(4):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            estimate = estimate.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return estimate.select("grp", "start", *MEANS, *(f"l{i}{j}" for i, j in PAIRS))


def distance() -> Column:
    """Squared Mahalanobis distance, by forward substitution."""
    z: list[Column] = []
    for i, c in enumerate(FEATURES):
        rest = F.col(c) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def judge(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``key``, the counts, ``base_failed``, ``dist`` and ``kept``.

    The estimates are made from all documents that pass the base rules. ``kept`` is false if these
    fail or the squared distance is over CUTOFF. Null languages and sources are groups like others;
    a language of which no document passes has no estimate and needs none. ``dist`` is null for its
    documents. Null and empty texts have no words and fail. Texts of any length are read whole. Repeated
    rows are judged one by one; other columns than text, language and source are ignored, also those
    with names of the result. An empty table gives no rows.
    """
    rows = stage_table(statistics(docs, key).withColumn("base_failed", base_failed()), "statistics")
    passed = rows.filter(~F.col("base_failed"))
    sizes = stage_table(rows.groupBy("lang", "source").agg(F.sum(F.when(~F.col("base_failed"), 1).otherwise(0)).alias("n_group")), "groups")
    group = lambda source, wide: F.struct("lang", source.alias("source"), F.lit(wide).alias("wide")).alias("grp")
    both = passed.select(group(F.col("source"), False), *FEATURES).unionByName(passed.select(group(F.lit(None).cast("string"), True), *FEATURES))
    estimates = robust_estimates(stage_table(both, "vectors"))
    pool = pooled(estimates.filter("NOT grp.wide"), estimates.filter("grp.wide"), sizes).withColumnRenamed("grp", "_grp")
    far = rows.join(pool, F.col("lang").eqNullSafe(F.col("_grp.lang")) & F.col("source").eqNullSafe(F.col("_grp.source")), "left").withColumn("dist", distance())
    return far.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "dist", (~F.col("base_failed") & F.coalesce(F.col("dist") <= CUTOFF, F.lit(True))).alias("kept"))
