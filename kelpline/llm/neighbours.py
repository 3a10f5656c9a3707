"""Nearest neighbours by a block matrix join with int8 tiles and exact float checks.

Candidates and queries are dealt into blocks; a tile is a pair of blocks. In a tile, vectors stand
as int8 with one scale each, and one matrix product gives all distances of their rounded forms. The
norms of what rounding took away bound each true distance from both sides, so everything below a
query's k-th smallest upper bound, and only that, is computed again from the original vectors in
double precision. The tile's k best of each query then meet those of the other tiles in a heap of k.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of a block: 4,096 rows of 64. A tile of two full blocks needs some 50 MB.
BLOCK = 4096 * 64
#: Queries whose distances to a block are held at once.
STRIP = 512
#: Buckets of queries for each block of queries, in which the results of tiles are merged.
BUCKETS = 16


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, one not zero."""
    fine = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 values (in a float32 matrix, in which their products are exact), scales, squared norms of the rounded vectors, norms of the rest."""
    scale = np.abs(rows).max(axis=1) / 127
    scale[scale == 0] = np.finfo("f8").tiny
    small = np.rint(rows / scale[:, None])
    near = small * scale[:, None]
    exact = "f4" if rows.shape[1] * 127 * 127 < 1 << 24 else "f8"
    return small.astype("i1").astype(exact), scale, (near * near).sum(axis=1), np.sqrt(((rows - near) ** 2).sum(axis=1))


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest candidates of each query: query ids, candidate ids, distances."""
    c8, c_scale, c_norm, c_rest = quantised(c)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(q), STRIP):
        part = q[lo : lo + STRIP]
        q8, q_scale, q_norm, q_rest = quantised(part)
        squares = q_norm[:, None] + c_norm - 2 * (q8 @ c8.T) * q_scale[:, None] * c_scale
        about = np.sqrt(np.maximum(squares, 0))
        # Besides the rounding to int8, that of the sums themselves: their error is below 1e-12 of the norms.
        slack = q_rest[:, None] + c_rest + np.sqrt(1e-12 * (q_norm[:, None] + c_norm))
        own = q_ids[lo : lo + STRIP, None] == c_ids
        upper = np.where(own, np.inf, about + slack)
        limit = np.partition(upper, min(k, upper.shape[1]) - 1, axis=1)[:, min(k, upper.shape[1]) - 1]
        left = (about - slack <= limit[:, None]) & ~own
        for i in range(len(part)):
            near = np.flatnonzero(left[i])
            true = np.sqrt(((c[near] - part[i]) ** 2).sum(axis=1))
            best = np.lexsort((c_ids[near], true))[:k]
            out.append((np.full(len(best), q_ids[lo + i]), c_ids[near][best], true[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def merged(batches: Iterator[pa.RecordBatch], k: int, key: str) -> pa.RecordBatch:
    """The k nearest of each query over the batches, with their ranks; only a heap of k for each query is held."""
    heaps: dict[int, list[tuple[float, int]]] = {}
    for batch in batches:
        for q, c, score in zip(*(batch.column(name).to_pylist() for name in ("query_id", key, "score"))):
            heap = heaps.setdefault(q, [])
            # The farthest, and of equally far ones the largest key, is on top.
            (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (-score, -c))
    ranked = [(q, rank, -c, -far) for q, heap in heaps.items() for rank, (far, c) in enumerate(sorted(heap, reverse=True), 1)]
    columns = zip(*ranked) if ranked else ((),) * 4
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "rank", key, "score"])


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to each query: query_id, rank (from 1), ``key``, score (Euclidean).

    A query is compared with every row of other ``key`` and of as many components; with fewer than
    k of them it gets all. Ties go to the smaller key. Rows and queries with a null key or a vector
    that isn't ``usable`` take no part; of queries with equal keys one, that with the smallest
    vector, is answered; repeated rows are candidates of their own. Other columns are ignored.

    Each row is sent once for each block of queries and each query once for each block of rows. The
    int8 values of a tile are multiplied as float32 numbers, in which their products are exact. Rows
    are dealt by key and vector, and of equal ones ``k`` are enough, so no key fills a block. Results of
    tiles are merged batch by batch, so a task holds ``k`` rows for each query of its bucket, however
    many tiles there are.
    """
    take = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows, queries = take(rows), take(queries).groupBy("id").agg(F.min("v").alias("v"))
    blocks = lambda df: max(1, -(-(df.agg(F.sum(F.size("v"))).first()[0] or 0) // BLOCK))
    n_rows, n_queries = blocks(rows), blocks(queries)
    rows = rows.groupBy("id", "v").agg(F.count(F.lit(1)).alias("n")).select("id", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)))).alias("copy")).drop("copy")
    own = lambda n: F.pmod(F.xxhash64("id", "v", F.lit(7)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("d", F.size("v")).withColumn("qb", own(n_queries)).withColumn("cb", every(n_rows))
    right = rows.withColumn("d", F.size("v")).withColumn("cb", own(n_rows)).withColumn("qb", every(n_queries))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        names = ["query_id", key, "score"]
        if not q.num_rows or not c.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), key: pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        return pa.table(dict(zip(names, tile(q.column("id").to_numpy(), matrix(q), c.column("id").to_numpy(), matrix(c), k))))

    tiles = left.groupBy("d", "qb", "cb").cogroup(right.groupBy("d", "qb", "cb")).applyInArrow(meet, f"query_id long, `{key}` long, score double")
    bucket = F.pmod(F.xxhash64("query_id", F.lit(11)), F.lit(n_queries * BUCKETS))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield merged(batches, k, key)

    return tiles.groupBy(bucket).applyInArrow(merge, f"query_id long, rank int, `{key}` long, score double")
