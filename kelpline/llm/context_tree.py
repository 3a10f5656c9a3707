"""Language-model scores by context-tree weighting over bytes.

A text is written as its words, lower-cased in A-Z and joined by single spaces, with a newline as
its end; before it come newlines. Each byte is coded as eight binary decisions, so a node of the tree
is a context of 0 to ``depth`` bytes together with the leading bits of the next byte. Nodes estimate
their bit by Krichevsky-Trofimov, and a node's probability of what it saw is the even mixture of its
own estimate and the product over its contexts that are one byte longer. The weights that follow from
the training texts give every bit a mixture of the estimates at all depths.

What the corpus teaches is a table of byte strings of ``depth`` + 1 with their counts, which grows
with it. It is dealt by the last three bytes of the context: below such a suffix lie at most
256 ** (depth - 2) strings, all deeper levels are settled there by numpy in sorted order, and only sums go up to
the levels of two bytes and fewer, of which there are at most 256 ** 3 strings, and at the root 256.
Strings that only stand in texts that aren't trained on are in the table with count 0, so each byte of
each text has one entry, the log10 probability of its bits.

A byte's entry is read from a broadcast table of the most frequent strings, bounded by a parameter;
the rest are joined by a shuffle, and likewise counts of words for the base score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kelpline.llm.common import arrow_rows, stage_table

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END = b"\n"
#: Bytes of texts that a task counts at a time.
STRETCH = 4_000_000
#: Longer words aren't in the broadcast table.
LONGEST = 32
SUFFIX, TOP = 3, 0xFFFFFF


def words_in(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


def strings_of(texts: list[bytes], depth: int) -> np.ndarray:
    """For each byte of each text the number that it and the ``depth`` bytes before it spell, the oldest byte highest."""
    pad = END * depth
    data = np.frombuffer(pad + pad.join(texts), "u1").astype("i8")
    keys = data[depth:].copy()
    for j in range(1, depth + 1):
        keys |= data[depth - j : len(data) - j] << (8 * j)
    ends = np.cumsum([len(t) + depth for t in texts])[:-1] - depth
    keep = np.ones(len(keys), bool)
    keep[(ends[:, None] + np.arange(depth)).ravel()] = False
    return keys[keep]


def log_gamma(z: np.ndarray) -> np.ndarray:
    """log of gamma for z > 0, by Stirling's series eight places on."""
    shift = np.zeros_like(z)
    for k in range(0, 8, 4):
        shift += np.log((z + k) * (z + k + 1) * (z + k + 2) * (z + k + 3))
    y = z + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


def level(keys: np.ndarray, n: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the nodes at one depth: each string's eight bit estimates, the weights of these, and log mixtures.

    ``keys`` are sorted distinct strings, ``n`` their counts, and ``below`` sums of log mixtures one
    level down, None at the deepest. A node is shared by the strings that agree in context and leading
    bits; its log mixture stands with the first of them, the others have 0.
    """
    context, x = keys >> 8, keys & 255
    own, weight, mixture = np.empty((8, len(keys))), np.ones((8, len(keys))), np.zeros((8, len(keys)))
    fresh = np.concatenate(([True], context[1:] != context[:-1]))
    for k in range(8):
        bits = x >> (8 - k)
        starts = np.flatnonzero(fresh | np.concatenate(([True], bits[1:] != bits[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        bit = (x >> (7 - k)) & 1
        total, ones = np.add.reduceat(n, starts), np.add.reduceat(n * bit, starts)
        kt = log_kt(total - ones, ones)
        if below is None:
            mixed = kt
        else:
            mixed = np.logaddexp(kt, np.add.reduceat(below[k], starts)) - math.log(2)
            weight[k] = np.repeat(np.exp(kt - math.log(2) - mixed), sizes)
        t, o = np.repeat(total, sizes), np.repeat(ones, sizes)
        own[k] = (np.where(bit == 1, o, t - o) + 0.5) / (t + 1)
        mixture[k, starts] = mixed
    return own, weight, mixture


def mixed_levels(keys: np.ndarray, n: np.ndarray, below: np.ndarray | None, high: int, low: int) -> tuple:
    """Depths ``high`` down to ``low`` for sorted distinct strings of ``high`` + 1 bytes.

    Gives for each string and bit ``fixed`` and ``open``, so that the probability seen from depth
    ``low`` is fixed + open * the one below ``high``; then the strings at depth ``low`` with their
    counts and log mixtures.
    """
    own, weight, mixture = level(keys, n, below)
    fixed, open_ = weight * own, 1 - weight
    place = np.arange(len(keys))
    for d in range(high - 1, low - 1, -1):
        keys, up = np.unique(keys & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        n = np.bincount(up, n, len(keys))
        below = np.stack([np.bincount(up, m, len(keys)) for m in mixture])
        own, weight, mixture = level(keys, n, below)
        place = up[place]
        w = weight[:, place]
        fixed, open_ = w * own[:, place] + (1 - w) * fixed, (1 - w) * open_
    return fixed, open_, keys, n, mixture


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 17) -> Iterator[pa.Table]:
    """Rows that come sorted by ``column``, in tables of at least ``most`` that end where its value changes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            table = pa.Table.from_batches(held)
            value = table.column(column).to_numpy()
            cut = int(np.searchsorted(value, value[-1]))
            if cut:
                yield table.slice(0, cut)
                table = table.slice(cut)
            held, size = table.to_batches(), table.num_rows
            most = max(most, 2 * size) if not cut else most
    if size:
        yield pa.Table.from_batches(held)


def lists(values: np.ndarray) -> pa.ListArray:
    """Rows of an array with a column for each bit."""
    return pa.ListArray.from_arrays(pa.array(np.arange(values.shape[1] + 1, dtype="i4") * 8), pa.array(values.T.ravel()))


def settled(strings: DataFrame, group: Column, high: int, low: int) -> DataFrame:
    """``mixed_levels`` of all ``strings`` (string, n, and n_all or below), dealt by ``group``.

    Columns: string, n_all, fixed, open (arrays of eight), and, in as many rows as there are strings at
    depth ``low``, up (such a string), n_up and mixture (array).
    """
    deepest = "below" not in strings.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "_group"):
            keys = table.column("string").to_numpy()
            order = np.argsort(keys)
            n = table.column("n").to_numpy()[order].astype("f8")
            below = None if deepest else np.ascontiguousarray(table.column("below").combine_chunks().flatten().to_numpy().reshape(-1, 8)[order].T)
            fixed, open_, up, n_up, mixture = mixed_levels(keys[order], n, below, high, low)
            rest = len(keys) - len(up)
            ends = np.append(np.arange(len(up) + 1), np.full(rest, len(up))).astype("i4") * 8
            above = pa.ListArray.from_arrays(pa.array(ends), pa.array(mixture.T.ravel()))
            mask = np.arange(len(keys)) >= len(up)
            made = [pa.array(keys[order]), table.column("n_all").combine_chunks().take(pa.array(order)), lists(fixed), lists(open_), pa.array(np.append(up, np.zeros(rest, "i8")), mask=mask), pa.array(np.append(n_up, np.zeros(rest)), mask=mask), above]
            yield pa.RecordBatch.from_arrays(made, ["string", "n_all", "fixed", "open", "up", "n_up", "mixture"])

    dealt = strings.withColumn("_group", group).repartition("_group").sortWithinPartitions("_group")
    return dealt.mapInArrow(run, "string long, n_all long, fixed array<double>, open array<double>, up long, n_up double, mixture array<double>")


def summed_up(rows: DataFrame, mask: int) -> DataFrame:
    """What stands at one depth in ``rows`` of ``settled``, added up by the string without its oldest byte: string, n, n_all, below."""
    up = rows.filter("up IS NOT NULL").groupBy(F.col("up").bitwiseAND(F.lit(mask)).alias("string"))
    sums = [F.sum(F.col("mixture")[k]) for k in range(8)]
    return up.agg(F.sum("n_up").alias("n"), F.lit(0).cast("long").alias("n_all"), F.array(*sums).alias("below"))


def counted(rows: DataFrame, count: Callable[[list, list], pa.RecordBatch], schema: str) -> DataFrame:
    """``count`` of lists of texts (as lists of words) and of their ``train`` flags, a stretch of texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, flags, size = [], [], 0
        for batch in batches:
            for text, flag in zip(batch.column(0), batch.column(1).to_pylist()):
                words = words_in(text.as_py())
                texts.append(words)
                flags.append(flag)
                size += sum(map(len, words)) + len(words) + 1
                if size >= STRETCH:
                    yield count(texts, flags)
                    texts, flags, size = [], [], 0
        if texts:
            yield count(texts, flags)

    return rows.select("text", "train").mapInArrow(run, schema)


def string_table(rows: DataFrame, depth: int) -> DataFrame:
    """Every string of ``depth`` + 1 bytes in ``rows`` (text, train): string, n (times in training texts), n_all."""

    def count(texts: list, flags: list) -> pa.RecordBatch:
        each = [strings_of(part, depth) * 2 + flag if part else np.zeros(0, "i8") for flag in (0, 1) for part in [[b" ".join(w) + END for w, f in zip(texts, flags) if f == flag]]]
        found, n = np.unique(np.concatenate(each), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["mark", "n"])

    marks = counted(rows, count, "mark long, n long")
    trained = F.when(F.col("mark").bitwiseAND(F.lit(1)) == 1, F.col("n")).otherwise(0)
    return marks.groupBy(F.shiftright("mark", 1).alias("string")).agg(F.sum(trained).alias("n"), F.sum("n").alias("n_all"))


def word_table(rows: DataFrame) -> DataFrame:
    """Words of the training texts among ``rows`` (text, train) and how often they stand there: word, n. Ends aren't words."""

    def count(texts: list, flags: list) -> pa.RecordBatch:
        seen = Counter()
        for words in texts:
            seen.update(words)
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return counted(rows.filter("train"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def model(strings: DataFrame, depth: int) -> DataFrame:
    """``strings`` (string, n, n_all) with ``score``, the log10 probability of the last byte after those before it."""
    deep = stage_table(settled(strings, F.shiftright("string", 8).bitwiseAND(F.lit(TOP)), depth, SUFFIX), "deep")
    middle = stage_table(settled(summed_up(deep, TOP), F.shiftright("string", 8).bitwiseAND(F.lit(0xFF)), SUFFIX - 1, 1), "middle")
    root = sorted(summed_up(middle, 0xFF).collect(), key=lambda r: r["string"])  # at most 256 rows, one for each byte
    if not root:
        return strings.withColumn("score", F.lit(0.0))
    fixed, open_, keys, _, _ = mixed_levels(np.array([r["string"] for r in root]), np.array([r["n"] for r in root]), np.array([r["below"] for r in root]).T, 0, 0)
    table = strings.sparkSession.createDataFrame([(int(k), fixed[:, i].tolist(), open_[:, i].tolist()) for i, k in enumerate(keys)], "_x long, _f array<double>, _o array<double>")
    each = middle.join(F.broadcast(table), F.col("string").bitwiseAND(F.lit(0xFF)) == F.col("_x"))
    upper = each.select(
        F.col("string").alias("_upper"),
        F.zip_with("_f", F.zip_with("_o", "fixed", lambda o, f: o * f), lambda a, b: a + b).alias("_fixed"),
        F.zip_with("_o", "open", lambda o, p: o * p).alias("_open"),
    )
    upper = stage_table(upper, "upper")
    met = deep.select("string", "n_all", "fixed").join(upper, F.col("string").bitwiseAND(F.lit(TOP)) == F.col("_upper"))
    chance = F.zip_with("_fixed", F.zip_with("_open", "fixed", lambda o, f: o * f), lambda a, b: a + b)
    return met.select("string", "n_all", F.aggregate(chance, F.lit(0.0), lambda s, p: s + F.log10(p)).alias("score"))


def frequent(rows: DataFrame, n: str, most: int) -> DataFrame:
    """The rows whose ``n`` is at least as large as lets ``most`` rows in; bounded, whatever the table.

    The bound comes from counts by magnitude, of which there are at most 64 times 16.
    """
    step = F.floor(F.log2(F.col(n)) * 16)
    sizes = sorted(rows.filter(F.col(n) > 0).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True)
    least, held = math.inf, 0
    for step_, size in sizes:
        if held + size > most:
            break
        least, held = step_, held + size
    return rows.filter((F.col(n) > 0) & (step >= F.lit(float(min(least, 1e9)))))


class Held:
    """Values by whole number, found for many numbers at once: open addressing in arrays at most a quarter full."""

    EMPTY = -1

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, self.EMPTY), np.zeros(1 << self.bits)
        slot, left = self.slots(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == self.EMPTY
            at, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[at], self.values[at] = keys[put], values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view("i8")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1 for those that aren't held."""
        slot = self.slots(keys)
        seen = self.keys[slot]
        left = np.flatnonzero(seen != keys)
        while len(left):
            gone = self.keys[slot[left]] == self.EMPTY
            slot[left[gone]] = -1
            left = left[~gone]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            left = left[self.keys[slot[left]] != keys[left]]
        return slot


_LOADED: list = []


def _held(broadcast) -> Held:
    """The table of a worker, made once for a broadcast, whose value is kept beside it."""
    if not _LOADED or _LOADED[0] is not broadcast.value:
        _LOADED[:] = [broadcast.value, Held(*broadcast.value[:2])]
    return _LOADED[1]


def scores(docs: DataFrame, key: str = "doc_id", depth: int = 5, folds: int = 5, held_fold: int = 1, table: int = 1 << 20, words: int = 1 << 17) -> DataFrame:
    """Base and model scores of every text, learnt from those outside the held-out fold.

    Columns: ``key``, held_out (crc32 of the key as text, mod ``folds``, is ``held_fold``), n_tokens
    (words and one end), n_known (tokens that training texts have), train_tokens, base_score (log10
    probability by word counts) and score (log10 probability by the context tree, of words, single
    spaces and the end). A null or empty text has the end alone; a null key isn't held out. Repeated
    rows are learnt from as often as they come and scored alike. Texts of any length are read whole.
    Without training texts each bit has probability 1/2. Other columns are ignored; no documents give
    no rows. ``depth``, from 3 to 6, is how many bytes a context has at most.
    """
    if not SUFFIX <= depth <= 6:
        raise ValueError("depth lies in 3..6")
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    rows = docs.select(F.col(key).alias("key"), "text", held_out.alias("held_out"), (~held_out).alias("train"))
    strings = stage_table(string_table(rows, depth), "strings")
    scored = stage_table(model(strings, depth), "scored")
    known = stage_table(word_table(rows), "words")
    n_train = rows.filter("train").count()
    n_words, v_words = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_tokens, kinds = n_words + n_train, v_words + (n_train > 0)
    common = frequent(scored, "n_all", table).select("string", "score").toArrow()
    short = {r["word"].encode(): math.log10(r["n"] + 0.5) for r in frequent(known.filter(F.octet_length("word") <= LONGEST), "n", words).collect()}
    held = spark.sparkContext.broadcast((common.column("string").to_numpy(), common.column("score").to_numpy(), short))
    kind = to_arrow_type(rows.schema["key"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, short = _held(held), held.value[2]

        def out(part: pa.RecordBatch, tokens: list[list[bytes]]) -> pa.RecordBatch:
            texts = [b" ".join(t) + END for t in tokens]
            grams = strings_of(texts, depth)
            starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            at = known.find(grams)
            hit = at >= 0
            each = np.where(hit, known.values[at], 0.0)
            lost_before = np.concatenate(([0], np.cumsum(~hit)))[starts].astype("i4")
            found = [list(map(short.get, t)) for t in tokens]
            lost = [[w for w, v in zip(t, f) if v is None] if None in f else [] for t, f in zip(tokens, found)]
            base = [math.fsum(v for v in f if v is not None) for f in found]
            n = np.array([len(t) for t in tokens], "i8")
            columns = [pa.array(n + 1), pa.array(n - np.array([len(x) for x in lost], "i8")), pa.array(base, pa.float64()), pa.array(np.add.reduceat(each, starts[:-1]))]
            missed = pa.ListArray.from_arrays(pa.array(lost_before), pa.array(grams[~hit]))
            return pa.RecordBatch.from_arrays([part.column(0).cast(kind), part.column(2), *columns, pa.array(lost, pa.list_(pa.binary())).cast(pa.list_(pa.string())), missed], ["key", "held_out", "n_tokens", "n_known", "base", "score", "words", "strings"])

        for batch in batches:
            first, tokens, size = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                tokens.append(words_in(text.as_py()))
                size += sum(map(len, tokens[-1])) + len(tokens[-1]) + 1
                if size >= STRETCH // 4 or i + 1 == batch.num_rows:
                    yield out(batch.slice(first, len(tokens)), tokens)
                    first, tokens, size = i + 1, [], 0

    schema = f"key {rows.schema['key'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, score double, words array<string>, strings array<long>"
    with arrow_rows(spark, 500):
        first = stage_table(rows.select("key", "text", "held_out").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "first")
    words_left = first.select("row", F.explode("words").alias("word")).join(known, "word", "left").groupBy("row")
    words_left = words_left.agg(F.count("n").alias("more_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more_base"))
    strings_left = first.select("row", F.explode("strings").alias("string")).groupBy("row", "string").agg(F.count(F.lit(1)).alias("times"))
    strings_left = strings_left.join(scored.select("string", F.col("score").alias("own")), "string").groupBy("row").agg(F.sum(F.col("own") * F.col("times")).alias("more_score"))
    whole = first.drop("words", "strings").join(words_left, "row", "left").join(strings_left, "row", "left")
    none = F.lit(0)
    per_token = math.log10(n_tokens + 0.5 * (kinds + 1))
    end = math.log10(n_train + 0.5)
    return whole.select(
        F.col("key").alias(key), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", none) + F.lit(int(n_train > 0))).alias("n_known"),
        F.lit(int(n_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", none) + F.lit(end) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", none)).alias("score"),
    )
