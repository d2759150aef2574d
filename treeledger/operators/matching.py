"""Duplicate matching in tiers.

Equal digests (A full, B sampled) and equal symlinks (S) group by equality. Files of one size and extension form a cohort; in it
equal names group (C when all times agree, D otherwise), and files of one parent name link when their times agree and
form maximal cliques (E). Every rule that the tiers need about a group's pairs is an aggregate over its
members, so pairs are formed only for tier E, within clusters whose size is bounded before.

Groups are named by their key, members are rows (group_key, kind, signal, confidence, size, node_id). `skipped` lists files
for which a judgement was declined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions.scalars import base_name, ext, mtime_match, mtime_seconds, parent_path
from treeledger.scratch import materialize


@dataclass(frozen=True)
class MatchParams:
    min_size: int = 65_536
    min_confidence: float = 40.0
    cohort_cap: int = 2_000
    name_cap: int = 32
    cluster_cap: int = 300
    clique_budget: int = 200_000


def candidates(nodes: DataFrame) -> DataFrame:
    """Files and links that are no aliases, with their extension, parent name and readable time."""
    rows = nodes.where("type IN ('file', 'link') AND alias_of IS NULL")
    return rows.select("node_id", "source_id", "type", "name", "size", "mtime", "content_hash", "hash_kind", "hash_spec", "link_target", ext(F.col("name")).alias("ext"), base_name(parent_path(F.col("rel_path"))).alias("parent_name"), mtime_seconds(F.col("mtime")).alias("secs"))


def _members(rows: DataFrame, groups: DataFrame, keys: list[str], key: Column) -> DataFrame:
    """Members of the groups with these keys; `groups` has signal, confidence and, when it differs from the members', size."""
    return rows.join(groups, keys).select(key.alias("group_key"), F.lit("file").alias("kind"), "signal", "confidence", "size", "node_id")


def hash_groups(files: DataFrame) -> DataFrame:
    """Tiers A and B: equal size, digest spec and digest. No size gate and no cap."""
    keys = ["size", "hash_spec", "content_hash"]
    rows = files.where("type = 'file' AND content_hash IS NOT NULL AND hash_spec IS NOT NULL")
    full = F.bool_and(F.coalesce(F.col("hash_kind") == "full", F.lit(False)))
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), full.alias("full")).where("n > 1")
    groups = groups.select(*keys, F.when(F.col("full"), "hash-full").otherwise("hash-sampled").alias("signal"), F.when(F.col("full"), 100.0).otherwise(99.0).alias("confidence"))
    return _members(rows, groups, keys, F.concat_ws("|", F.lit("hash"), F.col("size").cast("string"), "hash_spec", "content_hash"))


def symlink_groups(files: DataFrame, p: MatchParams) -> DataFrame:
    """Tier S: equal name and target of links."""
    keys = ["name", "link_target"]
    rows = files.where((F.col("type") == "link") & (F.col("size") >= p.min_size) & F.col("link_target").isNotNull())
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("size").alias("least")).where("n > 1").select(*keys, F.lit("symlink-target").alias("signal"), F.lit(100.0).alias("confidence"))
    return _members(rows, groups, keys, F.concat_ws("|", F.lit("link"), "name", "link_target"))


def _pool(files: DataFrame, hashed: DataFrame, p: MatchParams) -> DataFrame:
    """Files for the metadata tiers, each with its cohort's size and its digest group, if any that counts."""
    own = hashed.where(F.col("confidence") >= p.min_confidence).select("node_id", F.col("group_key").alias("hash_group"))
    rows = files.where((F.col("type") == "file") & (F.col("size") >= p.min_size)).join(own, "node_id", "left")
    cohorts = rows.groupBy("size", "ext").agg(F.count("*").alias("cohort")).where("cohort > 1")
    return rows.join(cohorts, ["size", "ext"])


def name_groups(pool: DataFrame, p: MatchParams) -> tuple[DataFrame, DataFrame]:
    """Tiers C and D, and the files for which they declined."""
    keys = ["size", "ext", "name"]
    within = pool.where(F.col("cohort") <= p.cohort_cap)
    by_spec = within.groupBy(*keys, "hash_spec").agg(
        F.count("*").alias("n"), (F.col("hash_spec").isNotNull() & (F.min("content_hash") != F.max("content_hash"))).alias("conflict"),
        F.min("mtime").alias("t0"), F.max("mtime").alias("t1"), F.count("mtime").alias("timed"), F.count("secs").alias("read"), F.min("secs").alias("s0"), F.max("secs").alias("s1"),
        F.min("hash_group").alias("h0"), F.max("hash_group").alias("h1"), F.count("hash_group").alias("grouped"),
    )
    groups = by_spec.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.bool_or(F.coalesce("conflict", F.lit(False))).alias("conflict"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("timed").alias("timed"), F.sum("read").alias("read"),
        F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.min("h0").alias("h0"), F.max("h1").alias("h1"), F.sum("grouped").alias("grouped"),
    ).where("n > 1")
    strong = F.coalesce((F.col("timed") == F.col("n")) & ((F.col("t0") == F.col("t1")) | ((F.col("read") == F.col("n")) & (F.col("s1") - F.col("s0") <= 2))), F.lit(False))
    declined = (F.col("n") > p.name_cap) | F.col("conflict")
    redundant = F.coalesce((F.col("grouped") == F.col("n")) & (F.col("h0") == F.col("h1")), F.lit(False))
    judged = groups.select(*keys, declined.alias("declined"), redundant.alias("redundant"), F.when(strong, "name+mtime").otherwise("name").alias("signal"), F.when(strong, 70.0).otherwise(55.0).alias("confidence"))
    kept = judged.where("NOT declined AND NOT redundant").drop("declined", "redundant")
    members = _members(within, kept, keys, F.concat_ws("|", F.lit("name"), F.col("size").cast("string"), "name"))
    skipped = within.join(judged.where("declined").select(*keys), keys, "left_semi").select("node_id")
    return members, skipped.union(pool.where(F.col("cohort") > p.cohort_cap).select("node_id"))


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def _parts(mask: int, near: list[int], joined: bool) -> list[int]:
    """Connected parts of the graph on these vertices, or, with `joined`, of its complement."""
    out = []
    while mask:
        part = edge = mask & -mask
        mask ^= part
        while edge and mask:
            v = edge & -edge
            edge ^= v
            at = near[v.bit_length() - 1]
            fresh = mask & ~at if joined else mask & at
            part, edge, mask = part | fresh, edge | fresh, mask ^ fresh
        out.append(part)
    return out


def _count(mask: int, near: list[int], limit: int) -> int:
    """Cliques of a graph, the empty one included; any number above the limit once there are more.

    Those of parts without edges between them add up; those of parts that are joined completely multiply. What is neither is split by a vertex.
    """
    beside = 0
    while True:
        if mask.bit_count() < 2:
            return beside + 1 + mask.bit_count()
        parts = _parts(mask, near, False)
        if len(parts) > 1:
            total = beside + 1
            for p in parts:
                if (total := total + _count(p, near, limit) - 1) > limit:
                    break
            return total
        parts = _parts(mask, near, True)
        if len(parts) > 1:
            total = 1
            for p in parts:
                if (total := total * _count(p, near, limit)) > limit:
                    break
            return beside + total
        v = min(_bits(mask), key=lambda v: (near[v] & mask).bit_count())
        if (beside := beside + _count(mask & near[v], near, limit)) > limit:
            return beside
        mask &= ~(1 << v)


def _maximal(mask: int, near: list[int]) -> list[int]:
    """Maximal cliques of a graph, by Bron and Kerbosch with pivots."""
    out, stack = [], [(0, mask, 0)]
    while stack:
        clique, more, done = stack.pop()
        if not more:
            if not done:
                out.append(clique)
            continue
        pivot = max(_bits(more | done), key=lambda v: (near[v] & more).bit_count())
        for v in _bits(more & ~near[pivot]):
            stack.append((clique | 1 << v, more & near[v], done & near[v]))
            more, done = more & ~(1 << v), done | 1 << v
    return out


def cliques(edges: list[tuple[int, int]], isolated: int, budget: int) -> list[list[int]] | None:
    """Maximal cliques of two or more, or nothing when the graph has more cliques (the empty one and `isolated` single ones included) than the budget.

    They are counted without listing them, so a dense cluster costs no more than a sparse one.
    """
    if not edges:
        return []
    names = sorted({v for e in edges for v in e})
    at = {v: i for i, v in enumerate(names)}
    near = [0] * len(names)
    for a, b in edges:
        near[at[a]] |= 1 << at[b]
        near[at[b]] |= 1 << at[a]
    every = (1 << len(names)) - 1
    if _count(every, near, budget - isolated) + isolated > budget:
        return None
    found = (c for part in _parts(every, near, False) for c in _maximal(part, near))
    return [[names[i] for i in _bits(c)] for c in found if c.bit_count() > 1]


def clique_edges(pool: DataFrame, p: MatchParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clustered files, tier E's edges, and the files of clusters that are too large."""
    keys = ["size", "ext", "parent"]
    rows = pool.where((F.col("cohort") <= p.cohort_cap) & (F.col("parent_name") != "") & (F.col("size") != 0)).withColumn("parent", F.lower("parent_name"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("cluster")).where("cluster > 1")
    rows = rows.join(sizes, keys)
    fit = rows.where(F.col("cluster") <= p.cluster_cap).select(*keys, "cluster", "node_id", "name", "mtime", "secs", "content_hash", "hash_spec", "hash_group")
    a, b = fit.alias("a"), fit.alias("b")
    differ = (F.col("a.hash_spec") == F.col("b.hash_spec")) & (F.col("a.content_hash") != F.col("b.content_hash"))
    pair = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.node_id") < F.col("b.node_id"), F.col("a.name") != F.col("b.name"), ~F.coalesce(differ, F.lit(False))]
    near = mtime_match(F.col("a.mtime"), F.col("b.mtime"), F.col("a.secs"), F.col("b.secs")).isNotNull()
    edges = a.join(b, pair).where(near).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.cluster").alias("cluster"), F.col("a.node_id").alias("a"), F.col("b.node_id").alias("b"))
    return fit, edges, rows.where(F.col("cluster") > p.cluster_cap).select("node_id")


def clique_groups(pool: DataFrame, p: MatchParams) -> tuple[DataFrame, DataFrame]:
    """Tier E, and the files for which it declined. A cluster's edges go to one row: at most cluster_cap^2 / 2 of them."""
    keys = ["size", "ext", "parent"]
    fit, edges, skipped = clique_edges(pool, p)
    clusters = edges.groupBy(*keys, "cluster").agg(F.collect_list(F.struct("a", "b")).alias("edges"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for size, x, parent, cluster, pairs in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ends = [(e["a"], e["b"]) for e in pairs]
                nodes = {v for e in ends for v in e}
                found = cliques(ends, cluster - len(nodes), p.clique_budget)
                groups = [(sorted(nodes), True)] if found is None else [(sorted(c), len(c) > p.name_cap) for c in found]
                out += [(size, x, parent, c, declined) for c, declined in groups]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.bool_()), strict=True)], [*keys, "members", "declined"])

    # Written, as the groups and the declined files are read from it at different times.
    found = materialize(pool.sparkSession, clusters.mapInArrow(run, "size long, ext string, parent string, members array<long>, declined boolean"), "cliques")
    rows = found.select("size", "declined", F.concat_ws("|", F.lit("clique"), F.array_join(F.transform("members", lambda v: v.cast("string")), ",")).alias("group_key"), F.explode("members").alias("node_id"))
    own = fit.select("node_id", "hash_group")
    # An exhausted cluster is skipped whole, with the members that have no edge.
    exhausted = found.where("declined").select(*keys).distinct()
    declined = rows.where("declined").select("node_id").union(fit.join(exhausted, keys, "left_semi").select("node_id"))
    kept = rows.where("NOT declined").join(own, "node_id")
    redundant = kept.groupBy("group_key").agg(((F.count("hash_group") == F.count("*")) & (F.min("hash_group") == F.max("hash_group"))).alias("redundant")).where("redundant").select("group_key")
    kept = kept.join(redundant, "group_key", "left_anti")
    return kept.select("group_key", F.lit("file").alias("kind"), F.lit("parent+mtime").alias("signal"), F.lit(45.0).alias("confidence"), "size", "node_id"), skipped.union(declined)


def match(spark: SparkSession, nodes: DataFrame, p: MatchParams = MatchParams()) -> tuple[DataFrame, DataFrame]:
    """All file groups from min_confidence on, and the skipped files: declined ones that no group took, whatever its confidence."""
    files = materialize(spark, candidates(nodes), "candidates")
    hashed = hash_groups(files)
    pool = materialize(spark, _pool(files, hashed, p), "pool")
    named, no_name = name_groups(pool, p)
    linked, no_clique = clique_groups(pool, p)
    groups = materialize(spark, symlink_groups(files, p).unionByName(hashed).unionByName(named).unionByName(linked), "groups")
    skipped = no_name.union(no_clique).distinct().join(groups.select("node_id").distinct(), "node_id", "left_anti")
    return groups.where(F.col("confidence") >= p.min_confidence), skipped
