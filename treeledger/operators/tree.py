"""Ancestor closure and sums over subtrees.

Where paths are true, ancestors are prefixes of the path and need no join; where only parent links are, the closure doubles its reach each
round. Sums are first taken for each directory over its own children, so only one row for each directory is copied
to its ancestors, however many files it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions.scalars import node_key, parent_path
from treeledger.scratch import materialize


def prefixes(path: Column, whole: bool) -> Column:
    """The proper prefixes of a path (and the path itself with `whole`), as structs of path and distance."""
    parts = F.split(path, "/")
    last = F.size(parts) - (0 if whole else 1)
    one = lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), (F.size(parts) - i).alias("distance"))
    return F.when((last >= 1) & (path != ""), F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), one))


def closure_by_path(nodes: DataFrame) -> DataFrame:
    """node_id, ancestor_id, distance from true, unique paths."""
    up = nodes.select("source_id", "node_id", F.explode(prefixes(F.col("rel_path"), False)).alias("up"))
    return up.select("node_id", node_key(F.col("source_id"), F.col("up.path")).alias("ancestor_id"), F.col("up.distance").alias("distance"))


def closure_by_parent(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """node_id, ancestor_id, distance from parent links; ends also when links form a cycle (each pair is kept once)."""
    known = materialize(spark, nodes.where("parent_id IS NOT NULL AND parent_id <> node_id").select("node_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance")), "closure")
    before = known.count()
    while True:
        far = known.alias("a").join(known.select(F.col("node_id").alias("n"), F.col("ancestor_id").alias("far"), F.col("distance").alias("more")), F.col("ancestor_id") == F.col("n"))
        far = far.where("node_id <> far").select("node_id", F.col("far").alias("ancestor_id"), (F.col("distance") + F.col("more")).alias("distance"))
        known = materialize(spark, known.union(far).groupBy("node_id", "ancestor_id").agg(F.min("distance").alias("distance")), "closure")
        if (now := known.count()) == before:
            return known
        before = now


def subtree_sums(leaves: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """source_id, dir_path and the sums over everything below each directory, from leaves with true paths."""
    own = leaves.groupBy("source_id", parent_path(F.col("rel_path")).alias("own_path")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    up = own.select("source_id", *sums, F.explode(prefixes(F.col("own_path"), True)).alias("up"))
    return up.groupBy("source_id", F.col("up.path").alias("dir_path")).agg(*[F.sum(n).alias(n) for n in sums])


def live(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Nodes of sources that are not excluded."""
    return nodes.join(sources.where("NOT excluded").select(F.col("id").alias("source_id")), "source_id", "left_semi")


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """node_id, subtree_size, subtree_file_count of every node: bytes of canonical files, names of files, aliases and links."""
    file, leaf = F.col("type") == "file", F.col("type") != "directory"
    size, name = F.when(file & F.col("alias_of").isNull(), F.col("size")).otherwise(0), F.lit(1)
    below = subtree_sums(nodes.where(leaf), {"subtree_size": size, "subtree_file_count": name})
    dirs = nodes.where(~leaf).select("node_id").join(below.select(node_key(F.col("source_id"), F.col("dir_path")).alias("node_id"), "subtree_size", "subtree_file_count"), "node_id", "left")
    own = nodes.where(leaf).select("node_id", F.when(file, F.col("size")).otherwise(0).alias("subtree_size"), name.cast("long").alias("subtree_file_count"))
    return own.unionByName(dirs.fillna(0, ["subtree_size", "subtree_file_count"]))


def source_totals(nodes: DataFrame) -> DataFrame:
    """source_id, total_size, file_count, alias_bytes, physical_size."""
    file = F.col("type") == "file"
    sums = nodes.groupBy("source_id").agg(
        F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0)).alias("total_size"), F.count_if(F.col("type") != "directory").alias("file_count"),
        F.coalesce(F.sum(F.when(file & F.col("alias_of").isNotNull(), F.col("size"))), F.lit(0)).alias("alias_bytes"),
    )
    return sums.withColumn("physical_size", F.col("total_size") - F.col("alias_bytes"))


def hardlinks(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """node_id, canonical_id, set_size of every name in a hardlink set: the smallest path in byte order is canonical.

    Only scanned sources on file systems that are trusted with inode numbers have any; a missing upper inode half equals another missing one.
    """
    from treeledger.functions.scalars import filesystem_is_trusted

    trusted = sources.where((F.col("kind") == "scan") & filesystem_is_trusted(F.col("filesystem"))).select(F.col("id").alias("source_id"))
    files = nodes.where("type = 'file' AND inode IS NOT NULL AND dev IS NOT NULL").join(trusted, "source_id", "left_semi")
    key = ["source_id", "dev", "inode", F.coalesce("inode_high", F.lit(-1)).alias("high")]
    sets = files.groupBy(*key).agg(F.min(F.struct("rel_path", "node_id"))["node_id"].alias("canonical_id"), F.count("*").alias("set_size")).where("set_size > 1")
    return files.select("node_id", *key).join(sets, ["source_id", "dev", "inode", "high"]).select("node_id", "canonical_id", "set_size")
