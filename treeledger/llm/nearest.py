"""Exact nearest neighbours by a block matrix join.

Vectors are packed into blocks as int8 with one scale for each row, beside their floats. A tile is a query block against a
candidate block: the int8 product gives every pair's approximate inner product and a bound on the quantisation error, so
pairs whose upper bound lies under the k-th best lower bound are dropped, and the others are recomputed on the original
numbers. Each task keeps one heap of k for each of its queries; the tasks' heaps are merged by another heap.

Only the stated query set meets the candidates, block by block: no pair is a row. Query blocks and candidate blocks are dealt into groups of
GROUP_BYTES, and each pair of groups is a task, which holds its queries and streams its candidates. So a query block is sent once for each
group of candidates, and a candidate block once for each group of queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm.common import materialize

QUERY_ROWS = 1024
CANDIDATE_ROWS = 2048
GROUP_BYTES = 64 << 20
BLOCK = "block long, n int, dim int, rows binary, ids binary, named binary, vectors binary"


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: no null vector or component, all finite, not all zero."""
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0)).select(F.col("vec_id").cast("long"), "embedding")


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most `rows` vectors of one dimension (vec_id, embedding, row); a block's number is its first row."""

    def run(batches):
        held: dict[int, list] = {}

        def out(dim):
            numbers, ids, mats = zip(*held.pop(dim), strict=True)
            return pa.RecordBatch.from_pydict({
                "block": [numbers[0]], "n": pa.array([len(ids)], pa.int32()), "dim": pa.array([dim], pa.int32()), "rows": [np.array(numbers, "<i8").tobytes()],
                "ids": [np.array([i or 0 for i in ids], "<i8").tobytes()], "named": [bytes(i is not None for i in ids)], "vectors": [np.stack(mats).astype("<f8").tobytes()],
            })

        for batch in batches:
            for i, v, number in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                x = v.values.to_numpy(zero_copy_only=False)
                group = held.setdefault(len(x), [])
                group.append((number, i, x))
                if len(group) == rows:
                    yield out(len(x))
        for dim in list(held):
            yield out(dim)

    return vectors.select("vec_id", "embedding", "row").mapInArrow(run, BLOCK)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 rows (as floats, which the products need) and their scales."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    return np.rint(x / scale[:, None]).astype(np.int8), scale


def tile(x: np.ndarray, qx: np.ndarray, sx: np.ndarray, y: np.ndarray, qy: np.ndarray, sy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Approximate inner products and the error each may have at most."""
    near = qx.astype(np.float32) @ qy.astype(np.float32).T * sx[:, None] * sy[None, :]
    one_x, one_y = np.abs(qx).sum(axis=1, dtype=np.int64) * sx, np.abs(qy).sum(axis=1, dtype=np.int64) * sy
    error = 0.5 * (np.outer(one_x, sy) + np.outer(sx, one_y)) + 0.25 * x.shape[1] * np.outer(sx, sy)
    return near, error * (1 + 1e-6) + 1e-6 * np.abs(near)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed component by component in order."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * y[:, d]
    return total


class Held:
    """A query block in memory, with a heap of (score, named, -id) for each query: the worst of its k best is at the top."""

    def __init__(self, r: dict):
        self.rows, self.ids = np.frombuffer(r["rows"], "<i8"), np.frombuffer(r["ids"], "<i8")
        self.x = np.frombuffer(r["vectors"], "<f8").reshape(-1, r["dim"])
        self.qx, self.sx = quantise(self.x)
        self.heaps: list[list[tuple]] = [[] for _ in self.rows]
        self.floor = np.full(len(self.rows), -np.inf)

    def meet(self, rows: np.ndarray, ids: np.ndarray, named: bytes, y: np.ndarray, qy: np.ndarray, sy: np.ndarray, k: int) -> None:
        near, error = tile(self.x, self.qx, self.sx, y, qy, sy)
        own = self.rows[:, None] == rows[None, :]
        low, high = np.where(own, -np.inf, near - error), np.where(own, -np.inf, near + error)
        size = low.shape[1]
        floor = np.maximum(self.floor, np.partition(low, size - k, axis=1)[:, size - k]) if size > k else self.floor
        i, j = np.nonzero((high >= floor[:, None]) & ~own)
        score = np.concatenate([exact(self.x[i[a : a + 50_000]], y[j[a : a + 50_000]]) for a in range(0, len(i), 50_000)] or [np.empty(0)])
        sure = score >= self.floor[i]
        for q, c, s in zip(i[sure].tolist(), j[sure].tolist(), score[sure].tolist(), strict=True):
            heap, entry = self.heaps[q], (s, named[c], -int(ids[c]))
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == k:
                self.floor[q] = heap[0][0]


NEAR = "query_row long, query_id long, vec_id long, score double"


def tiles(batches, k: int) -> Iterator[pa.RecordBatch]:
    """The heaps of each pair of groups, of rows ordered by pair, queries first."""
    at, held = None, []

    def flush():
        for h in held:
            found = [(int(r), int(q), -i if named else None, s) for r, q, heap in zip(h.rows, h.ids, h.heaps, strict=True) for s, named, i in heap]
            cols = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_row", "query_id", "vec_id", "score"])
        held.clear()

    for batch in batches:
        for r in batch.to_pylist():
            if (r["q"], r["c"]) != at:
                yield from flush()
                at = r["q"], r["c"]
            if r["side"] == 0:
                held.append(Held(r))
                continue
            rows, ids, y = np.frombuffer(r["rows"], "<i8"), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["vectors"], "<f8").reshape(-1, r["dim"])
            qy, sy = quantise(y)
            for h in held:
                if h.x.shape[1] == r["dim"]:
                    h.meet(rows, ids, r["named"], y, qy, sy, k)
    yield from flush()


def merged(batches, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query, ranked, of rows ordered by query."""
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    row, heap, out = None, [], []

    def close():
        for rank, (s, named, i, q) in enumerate(sorted(heap, reverse=True), 1):
            out.append((q, rank, -i if named else None, s))
        heap.clear()

    def batch():
        cols = list(zip(*out, strict=True)) or [[]] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["query_id", "rank", "vec_id", "score"])

    for b in batches:
        for r, q, i, s in zip(*(b.column(n).to_pylist() for n in range(4)), strict=True):
            if r != row:
                close()
                row = r
                if len(out) >= 10_000:
                    yield batch()
            entry = (s, i is not None, -(i or 0), q)
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
    close()
    yield batch()


def nearest(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 20, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The k nearest of each query row by inner product; returns query_id, rank, vec_id, score.

    Vectors that are null, zero or hold null or non-finite components take no part; a vector meets those of its own
    dimension only. Ties go to the smaller vec_id, null after all others. A query has fewer than k rows when there are fewer candidates.
    Every row but the query's own is a candidate: one that repeats the query's vec_id, or has none, too; and each row that repeats
    a query is a query. An empty table gives no rows. Other columns are ignored.
    """
    # Rows are numbered in a written table, as numbers depend on how it is dealt.
    good = materialize(spark, usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    cand = materialize(spark, blocks(good, CANDIDATE_ROWS), "candidate-blocks")
    query = materialize(spark, blocks(good.where(is_query), QUERY_ROWS), "query-blocks")
    size = lambda df: df.agg(F.coalesce(F.sum(F.octet_length("vectors").cast("long")), F.lit(0)), F.count("*")).first()
    (c_bytes, c_blocks), (q_bytes, _) = size(cand), size(query)
    q_groups = max(1, -(-q_bytes // group_bytes))
    # Small tables still give every core something to do.
    c_groups = max(1, -(-c_bytes // group_bytes), min(c_blocks, 2 * spark.sparkContext.defaultParallelism))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("block", "dim"), F.lit(n)).cast("int")
    both = query.select("*", F.lit(0).alias("side"), dealt(q_groups).alias("q"), numbers(c_groups).alias("c")).unionByName(cand.select("*", F.lit(1).alias("side"), dealt(c_groups).alias("c"), numbers(q_groups).alias("q")))
    pairs = both.repartition(min(3 * q_groups * c_groups, 100_000), "q", "c").sortWithinPartitions("q", "c", "side")
    heaps = pairs.mapInArrow(lambda batches: tiles(batches, k), NEAR)
    return heaps.repartition("query_row").sortWithinPartitions("query_row").mapInArrow(lambda batches: merged(batches, k), "query_id long, rank int, vec_id long, score double")
