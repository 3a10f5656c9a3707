"""Near duplicates: MinHash bands, sequential Bayesian verification, exact checks, components.

Documents with equal shingle sets become one node. Nodes that agree in a band of their signature
are candidates. A candidate pair's signatures are compared batch by batch; it is dropped as soon as
the posterior probability that its similarity reaches the threshold falls below a chosen miss
probability. What survives is verified on the full shingle sets.

Only the components of the links are asked for, so pairs inside a component found so far are never
made. First each member of a band's bucket is compared with two hubs of the bucket; then members
that are still apart from the bucket's largest component with more hubs of that. What is then still
apart meets the nodes of that component exactly: those with which it shares one of its rarest
shingles, which near enough sets must, or that are joined to it by such. This is done in tiles of
bounded size, from which only links come out. A large group of near copies thus costs a few pairs for
each copy, and texts that merely share a passage don't meet at all.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kelpline.llm.common import Recent, arrow_rows, stage_table

#: Shingles are counted by so many leading bits of their hashes.
SLOT_BITS = 18


@dataclass(frozen=True)
class Likeness:
    """What counts as near: ``percent`` similarity of sets of ``words``-word shingles.

    ``bands`` of ``rows`` hashes: a pair at 80 percent meets in none of 32 bands of 5 with
    probability 3e-6, one at 85 percent with 7e-9. ``miss``: the posterior probability below which
    a pair is dropped; ``batch``: signature places compared at a time.
    """

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    miss: float = 1e-6
    batch: int = 32

    @property
    def places(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> list[int]:
        """For each number of batches, the fewest equal places with which a pair isn't dropped.

        With a uniform prior, similarity after m of n equal places is Beta(m + 1, n - m + 1), and
        exceeds t with the probability that a binomial of n + 1 trials at t is at most m.
        """
        t, out = self.percent / 100, []
        for n in range(self.batch, self.places + 1, self.batch):
            below, m = 0.0, -1
            while below < self.miss:
                m += 1
                below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append(m)
        return out


class Shingler:
    """Shingle sets, as sorted 64-bit hashes, and signatures of texts."""

    def __init__(self, like: Likeness) -> None:
        self.like = like
        self.hash_of = Recent(lambda w: xxhash.xxh64_intdigest(w), 200_000, 64).__getitem__
        draw = np.random.default_rng(20240229)
        self.times = (draw.integers(0, 1 << 32, like.places, dtype=np.uint32) | np.uint32(1))[:, None]
        self.plus = draw.integers(0, 1 << 32, like.places, dtype=np.uint32)[:, None]

    def shingles(self, text: str | None) -> np.ndarray:
        """Of the text with A-Z lower-cased; with fewer words than a shingle has, all of them are one."""
        words = (text or "").encode().lower().split()  # of bytes, so by ASCII rules only
        if not words:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self.hash_of, words), np.uint64, len(words))
        k = min(self.like.words, len(words))
        found = np.full(len(words) - k + 1, np.uint64(k))
        for j in range(k):
            found = (found + hashes[j : len(words) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            found ^= found >> np.uint64(29)
            found *= np.uint64(0xBF58476D1CE4E5B9)
            found ^= found >> np.uint64(32)
        return np.unique(found)

    def signature(self, shingles: np.ndarray) -> bytes:
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        best = np.full(self.like.places, 0xFFFFFFFF, np.uint32)
        for lo in range(0, len(low), 512):
            np.minimum(best, (self.times * low[lo : lo + 512] + self.plus).min(axis=1), out=best)
        return best.tobytes()


_MADE: dict[Likeness, Shingler] = {}


def shingler(like: Likeness) -> Shingler:
    if like not in _MADE:
        _MADE[like] = Shingler(like)
    return _MADE[like]


def features(docs: DataFrame, like: Likeness, key: str, whole: bool = False) -> DataFrame:
    """``key``, ``n`` (set size), ``set_id`` (128-bit hash of the set), ``sig``; with ``whole`` also ``shingles``.

    Documents without words have n 0 and nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shingler(like)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 1000):
                sets = [tool.shingles(x.as_py()) for x in texts.slice(lo, 1000)]
                ids = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
                columns = [keys.slice(lo, 1000), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array([tool.signature(s) if len(s) else None for s in sets], pa.binary())]
                if whole:
                    columns.append(pa.array([s.tobytes() for s in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["key", "n", "set_id", "sig", "shingles"][: len(columns)])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {kind}, n long, set_id binary, sig binary" + ", shingles binary" * whole)


def band_keys(sig: Column, like: Likeness) -> Column:
    """One long per band, of its number and its places."""
    size = 4 * like.rows
    return F.array(*(F.xxhash64(F.lit(b), F.substring(sig, size * b + 1, size)) for b in range(like.bands)))


def pruned(pairs: DataFrame, bodies: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) that sequential comparison of their signatures doesn't drop."""
    small = bodies.select("key", "n", "sig")
    least, places, batch_size = like.least_matches(), like.places, like.batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            alive = np.flatnonzero(np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * like.percent)
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, places) for c in ("sig_a", "sig_b"))
            same = np.zeros(batch.num_rows, np.int64)
            for j, fewest in enumerate(least):
                part = slice(j * batch_size, (j + 1) * batch_size)
                same[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
                alive = alive[same[alive] >= fewest]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    with_a = pairs.join(small.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), "a")
    with_b = with_a.join(small.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b")
    kind = pairs.schema["a"].dataType.simpleString()
    return with_b.mapInArrow(run, f"a {kind}, b {kind}")


def verified(pairs: DataFrame, bodies: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) whose full sets are near enough."""
    large = bodies.select("key", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for i, (x, y) in enumerate(zip(batch.column("s_a"), batch.column("s_b"))):
                a, b = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= like.percent * (len(a) + len(b) - both):
                    linked.append(i)
            yield batch.select(["a", "b"]).take(pa.array(linked, pa.int64()))

    with_a = pairs.join(large.select(F.col("key").alias("a"), F.col("shingles").alias("s_a")), "a")
    with_b = with_a.join(large.select(F.col("key").alias("b"), F.col("shingles").alias("s_b")), "b")
    kind = pairs.schema["a"].dataType.simpleString()
    return with_b.mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, for all nodes of the edges (a, b).

    Each round every node takes its smallest neighbour for parent, parents are followed twice, and
    the edges are drawn between the parents that are left; edges shrink fast, and every table of a
    round is written out.
    """
    labels = None
    while True:
        edges = stage_table(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            if labels is None:
                return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return labels
        both = edges.unionAll(edges.select("b", "a").toDF("a", "b"))
        parent = stage_table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "parents")
        for _ in range(2):
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("next"))
            parent = parent.join(above, "up").select("node", F.col("next").alias("up"))
        parent = stage_table(parent, "parents")
        if labels is None:
            labels = parent.select("node", F.col("up").alias("label"))
        else:
            labels = labels.join(parent.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        labels = stage_table(labels, "labels")
        for end in ("a", "b"):
            edges = edges.join(parent.select(F.col("node").alias(end), "up"), end).drop(end).withColumnRenamed("up", end)


def slot_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def shingle_counts(bodies: DataFrame) -> np.ndarray:
    """About how many sets hold a shingle, by the leading bits of its hash: an array of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for body in batch.column(0):
                held += np.bincount(slot_of(np.frombuffer(body.as_buffer(), np.uint64)), minlength=len(held))
        slots = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(held[slots])], ["slot", "n"])

    total = bodies.select("shingles").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    counts[total.column("slot").to_numpy()] = total.column("n").to_numpy()
    return counts


def prefix_groups(nodes: DataFrame, bodies: DataFrame, like: Likeness) -> DataFrame:
    """``nodes`` (main, key, label, apart) that can have a link there, with ``grp``: two that can be linked have one group.

    Shingles are put into one order for all sets, rare ones first. Two sets that are near enough
    share a shingle among the first of each: of n shingles, the first n - ceil(n * percent / 100) +
    1. Sets that share such a shingle fall into one group, and so do those that are joined by others.
    So this loses no link, and texts that merely have a passage in common fall into groups of one,
    because common shingles come last. The order need only be the same for all sets, so approximate
    counts do.
    """
    counts = nodes.sparkSession.sparkContext.broadcast(shingle_counts(bodies.join(nodes.select("key").distinct(), "key", "left_semi")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, body in enumerate(batch.column("shingles")):
                shingles = np.frombuffer(body.as_buffer(), np.uint64)
                first = len(shingles) - -(-like.percent * len(shingles) // 100) + 1
                order = np.lexsort((shingles, counts.value[slot_of(shingles)]))[:first]
                found.append(shingles[order].view(np.int64))
                rows.append(np.full(len(order), i))
            held = batch.select(["main", "key", "label", "apart"]).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array(np.concatenate(found))], [*held.schema.names, "shingle"])

    kind = dict(nodes.dtypes)["key"]
    with arrow_rows(nodes.sparkSession, 500):
        firsts = nodes.join(bodies.select("key", "shingles"), "key").select("main", "key", "label", "apart", "shingles")
        firsts = stage_table(firsts.mapInArrow(run, f"main {kind}, key {kind}, label {kind}, apart boolean, shingle long"), "firsts")
    shared = firsts.groupBy("main", "shingle").agg(F.min("key").alias("least"), F.max("apart").alias("open"), (F.min("label") < F.max("label")).alias("several"))
    shared = stage_table(shared.filter("open AND several").select("main", "shingle", "least"), "shared")
    drawn = stage_table(firsts.join(shared, ["main", "shingle"]).select("main", "key", "label", "apart", "least").distinct(), "drawn")
    ends = components(drawn.select(F.col("key").alias("a"), F.col("least").alias("b")))
    return drawn.select("main", "key", "label", "apart").distinct().join(ends.select(F.col("node").alias("key"), F.col("label").alias("grp")), "key")


def tile_links(r: dict, c: dict, like: Likeness) -> list[tuple]:
    """The links between two blocks of nodes, each a dict of the columns key, label, n, sig, shingles.

    Nodes of one component aren't compared. The signatures of a node and a block are compared batch
    by batch, as in ``pruned``, and what is left on the full sets.
    """
    sigs = np.frombuffer(b"".join(c["sig"]), np.uint32).reshape(-1, like.places)
    sizes, labels = np.asarray(c["n"]), np.asarray(c["label"])
    least, out = like.least_matches(), []
    for key, label, n, sig, body in zip(r["key"], r["label"], r["n"], r["sig"], r["shingles"]):
        own = np.frombuffer(sig, np.uint32)
        alive = np.flatnonzero((labels != label) & (np.minimum(sizes, n) * 100 >= np.maximum(sizes, n) * like.percent))
        same = np.zeros(len(sizes), np.int64)
        for j, fewest in enumerate(least):
            part = slice(j * like.batch, (j + 1) * like.batch)
            same[alive] += (sigs[alive, part] == own[part]).sum(axis=1)
            alive = alive[same[alive] >= fewest]
        a = np.frombuffer(body, np.uint64)
        for i in alive:
            b = np.frombuffer(c["shingles"][i], np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= like.percent * (len(a) + len(b) - both):
                out.append((min(key, c["key"][i]), max(key, c["key"][i])))
    return out


def links_in_tiles(apart: DataFrame, sides: DataFrame, bodies: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) of the nodes ``apart`` (main, grp, key, label) with all nodes ``sides`` of the same main and group.

    Blocks hold at most about 128 and 1024 nodes, and fewer where sets are large; every block of the
    one side meets every block of the other. Pairs stay inside a tile, only links come out.
    """
    group = ["main", "grp"]

    def dealt(nodes: DataFrame, most: int, most_shingles: int, own: str) -> tuple[DataFrame, DataFrame]:
        held = nodes.join(bodies, "key").select(*group, "key", "label", "n", "sig", "shingles")
        count = nodes.join(bodies.select("key", "n"), "key").groupBy(*group).agg(F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum("n") / most_shingles)).cast("int").alias(f"n_{own}"))
        return held, count

    left, n_left = dealt(apart, 128, 100_000, "i")
    right, n_right = dealt(sides, 1024, 400_000, "j")
    counts = stage_table(n_left.join(n_right, group), "blocks")
    place = lambda n: F.pmod(F.xxhash64("key", F.lit(11)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(counts, group).withColumn("i", place("n_i")).withColumn("j", every("n_j")).drop("n_i", "n_j")
    right = right.join(counts, group).withColumn("j", place("n_j")).withColumn("i", every("n_i")).drop("n_i", "n_j")
    right = right.toDF(*right.columns)  # columns of its own, where both sides come from ``bodies``
    field = to_arrow_type(apart.schema["key"].dataType)

    def meet(r: pa.Table, c: pa.Table) -> pa.Table:
        found = tile_links(r.to_pydict(), c.to_pydict(), like) if r.num_rows and c.num_rows else []
        return pa.table({"a": pa.array([x for x, _ in found], field), "b": pa.array([y for _, y in found], field)})

    kind = dict(apart.dtypes)["key"]
    return left.groupBy(*group, "i", "j").cogroup(right.groupBy(*group, "i", "j")).applyInArrow(meet, f"a {kind}, b {kind}")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links between nodes of different labels."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"l_{end}"))
    drawn = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
    merged = components(drawn)
    old = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    fresh = merged.join(labels.select("node"), "node", "left_anti")
    return stage_table(old.unionByName(fresh), "labels")


def _hubs(n: int, first: int) -> Column:
    """``n`` members drawn by hash, the same ones in all buckets that hold them."""
    return F.array(*(F.min_by("key", F.xxhash64("key", F.lit(seed))) for seed in range(first, first + n)))


def _pairs(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_duplicates(docs: DataFrame, like: Likeness = Likeness(), key: str = "doc_id", most_broadcast: int = 500_000) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_shingles``, ``component_id``, ``kept``.

    ``component_id`` is the smallest key that can be reached over links, the document's own
    included; ``kept`` is whether it is the document's own. Null, empty and blank texts have no
    shingles and are linked with nothing; they are kept. Rows with equal keys are taken for one
    document and stay or go together. Rows with a null key come back with a null component and are
    kept. Texts of any length are read whole; a text is one row wherever it goes. Other columns of
    ``docs`` are ignored.
    """
    spark = docs.sparkSession
    all_ = stage_table(features(docs, like, key), "features")
    sets = all_.filter("n > 0 AND key IS NOT NULL")
    reps = stage_table(sets.groupBy("set_id").agg(F.min("key").alias("rep")), "sets")
    nodes = sets.join(reps.withColumnRenamed("set_id", "_set"), (F.col("set_id") == F.col("_set")) & (F.col("key") == F.col("rep"))).select("key", F.explode(band_keys(F.col("sig"), like)).alias("bucket"))
    nodes = nodes.distinct()
    shared = nodes.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stage_table(nodes.join(shared, "bucket").select("bucket", "key"), "members")
    ids = stage_table(members.select("key").distinct(), "member_ids")
    few = ids.count() <= most_broadcast  # of one number each
    wanted = docs.select(F.col(key).alias("doc"), "text").join((F.broadcast(ids) if few else ids).withColumnRenamed("key", "doc"), "doc", "left_semi")
    bodies = features(wanted, like, "doc", whole=True).filter("n > 0").dropDuplicates(["key", "set_id"])
    bodies = stage_table(bodies, "bodies")

    def check(pairs: DataFrame) -> DataFrame:
        with arrow_rows(spark, 500):  # each with two sets
            return stage_table(verified(stage_table(pruned(pairs, bodies, like), "survivors"), bodies, like), "links")

    hubs = members.groupBy("bucket").agg(_hubs(2, 1).alias("hubs"))
    met = members.join(hubs, "bucket").select("key", F.explode("hubs").alias("hub")).filter("key <> hub")
    tested = stage_table(met.select(*_pairs(F.col("key"), F.col("hub"))).distinct(), "pairs")
    labels = components(check(tested))

    def still_open() -> DataFrame:
        """Members of buckets with more than one component: bucket, key, label, and main, the largest component's label."""
        placed = stage_table(members.join(labels.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("label", "key").alias("label")), "placed")
        main = placed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", "main")
        return stage_table(placed.join(main, "bucket"), "open")

    for first in (3, 6):
        open_ = still_open()
        hubs = open_.filter("label = main").groupBy("bucket").agg(_hubs(3, first).alias("hubs"))
        met = open_.filter("label <> main").join(hubs, "bucket").select("key", F.explode("hubs").alias("other"))
        fresh = stage_table(met.select(*_pairs(F.col("key"), F.col("other"))).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        labels = relabelled(labels, check(fresh))
        tested = tested.unionByName(fresh)

    # Exactly: what is apart from a bucket's largest component, with all of that component's nodes of the buckets and with each other.
    placed = stage_table(still_open().select("main", "key", "label", (F.col("label") != F.col("main")).alias("apart")).distinct(), "placed")
    grouped = stage_table(prefix_groups(placed, bodies, like), "grouped")
    links = stage_table(links_in_tiles(grouped.filter("apart").drop("apart"), grouped.drop("apart"), bodies, like), "tile_links")
    labels = relabelled(labels, links)

    found = all_.join(reps, "set_id", "left").select("key", F.col("n").alias("n_shingles"), F.coalesce("rep", "key").alias("node"))
    found = found.join(labels, "node", "left").select(F.col("key").alias(key), "n_shingles", F.coalesce("label", "node").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
