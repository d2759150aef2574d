"""Balanced sharding by longest processing time.

Documents with equal texts form a group, and a group is never split. Groups go, largest first, to the shard that
holds the fewest bytes so far, taken from a heap.

All groups are scheduled, but the driver sees run lengths only: each size that groups have, and how many have it. There are at most
sqrt(2 * bytes) sizes, since they are different and sum up to no more than all bytes. Groups of one size are interchangeable, so a
run is placed at once, as the heap would place its groups one by one, and each shard then takes a range of the run's ranks.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeledger.llm.common import materialize, text_key

#: Ranks and slots are counted in cells of about so many rows.
CELL_ROWS = 100_000
#: The plan is sent to every task up to so many bytes, and joined beyond.
MOST_SENT = 64 << 20


def place(heap: list[tuple[int, int]], size: int, count: int) -> list[int]:
    """How many of `count` items of one size each shard takes, each to the least-loaded, ties to the smaller number; the heap of (load, shard) is updated."""
    taken = [0] * len(heap)
    if count > 4 * len(heap):
        # All shards reach a common level before any passes it: the highest that the items suffice for is reached at once.
        need = lambda level: sum(max(0, -(-(level - load) // size)) for load, _ in heap)
        low, high = min(heap)[0], max(heap)[0] + size * count + 1
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if need(middle) <= count else (low, middle)
        for k, (load, shard) in enumerate(heap):
            taken[shard] = n = max(0, -(-(low - load) // size))
            heap[k] = (load + n * size, shard)
        heapq.heapify(heap)
    for _ in range(count - sum(taken)):
        load, shard = heap[0]
        taken[shard] += 1
        heapq.heapreplace(heap, (load + size, shard))
    return taken


def longest_first(runs: list[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """{size: items that each shard takes} for (size, count of items) runs, largest first."""
    heap = [(0, s) for s in range(shards)]
    return {size: place(heap, size, count) for size, count in sorted(runs, reverse=True)}


def _runs(df: DataFrame) -> list[tuple]:
    found = df.toArrow()
    return list(zip(*(c.to_pylist() for c in found.columns), strict=True))


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 8, cell_rows: int = CELL_ROWS, most_sent: int = MOST_SENT) -> DataFrame:
    """Place every document; returns doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A document's size is its text's UTF-8 bytes plus 1. Null and empty texts have size 1 and checksum 0, and all of
    them form one group. Repeated rows are placed as often as they occur, in the same shard; slots count them apart.
    A null doc_id is placed like any other. An empty table gives no rows. Other columns are ignored.

    The law kept is `bytes`. One group larger than its fair share cannot be balanced away: its shard then
    holds that group and the others share the rest.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), text_key(text).alias("group"))
    # Rows are numbered in a written table, as numbers depend on how it is dealt.
    base = materialize(spark, base.withColumn("row", F.monotonically_increasing_id()), "shard-base")
    groups = materialize(spark, base.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    runs = _runs(groups.groupBy("bytes").count())
    if not runs:
        return base.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    placed = longest_first(runs, shards)

    # A group's rank among those of its size. Sizes that very many groups have are counted in cells: at most two for each cell_rows groups.
    long = [(size, -(-count // cell_rows)) for size, count in runs if count > cell_rows]
    cells = F.broadcast(spark.createDataFrame(pa.table({"bytes": pa.array([s for s, _ in long], pa.int64()), "cells": pa.array([n for _, n in long], pa.int32())})))
    celled = groups.join(cells, "bytes", "left").select("bytes", "group", "rows", F.coalesce(F.pmod(F.xxhash64("group"), F.col("cells")), F.lit(0)).cast("int").alias("cell"))
    before: dict[int, int] = {}
    starts = []
    for size, cell, n in sorted(_runs(celled.join(cells.select("bytes"), "bytes", "left_semi").groupBy("bytes", "cell").count())):
        starts.append((size, cell, before.get(size, 0)))
        before[size] = starts[-1][2] + n
    plan: list[tuple[int, int, int, list[int]]] = []
    for size, taken in placed.items():
        ends = [sum(taken[: s + 1]) for s in range(shards)]
        if size not in before:
            plan.append((size, 0, 0, ends))
    plan += [(size, cell, start, [sum(placed[size][: s + 1]) for s in range(shards)]) for size, cell, start in starts]
    sizes, numbers, begins, ends = zip(*plan, strict=True)
    where = spark.createDataFrame(pa.table({"bytes": pa.array(sizes, pa.int64()), "cell": pa.array(numbers, pa.int32()), "start": pa.array(begins, pa.int64()), "ends": pa.array(ends, pa.list_(pa.int64()))}))
    where = F.broadcast(where) if len(plan) * (20 + 8 * shards) <= most_sent else where
    nth = F.row_number().over(Window.partitionBy("bytes", "cell").orderBy("group"))
    rank = F.col("start") + F.col("nth") - 1
    homes = celled.withColumn("nth", nth).join(where, ["bytes", "cell"]).select("group", F.size(F.filter("ends", lambda e: e <= rank)).cast("int").alias("shard"))

    rows = materialize(spark, base.join(homes, "group").select("doc_id", "size", "text_crc32", "row", "shard"), "placed")
    all_ = sum(r for r, in _runs(groups.agg(F.sum("rows"))))
    per_shard = max(1, -(-all_ // (shards * cell_rows)))
    rows = rows.withColumn("cell", F.pmod("row", F.lit(per_shard)).cast("int"))
    # About one entry for each cell_rows documents.
    begin, slots = [0] * shards, []
    for shard, cell, n in sorted(_runs(rows.groupBy("shard", "cell").count())):
        slots.append((shard, cell, begin[shard]))
        begin[shard] += n
    slots = F.broadcast(spark.createDataFrame(slots, "shard int, cell int, begin long"))
    order = Window.partitionBy("shard", "cell").orderBy("row")
    return (
        rows.withColumn("nth", F.row_number().over(order)).join(slots, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
