"""Consolidated target trees and their path lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeledger.functions.scalars import normalize_type
from treeledger.operators.tree import closure_by_parent
from treeledger.scratch import materialize

NO_ROWS = "id long, consolidation_id long, parent_id long, name string, type string, source_node_id long, sort_order long, done boolean, struck boolean"


def next_position(rows: DataFrame, parent_id: int | None) -> int:
    """One more than the largest sort_order among a folder's children (or the roots)."""
    return (rows.where(F.col("parent_id").eqNullSafe(F.lit(parent_id).cast("long"))).agg(F.max("sort_order")).first()[0] or 0) + 1


def materialize_subtree(nodes: DataFrame, closure: DataFrame, annotations: DataFrame, root_id: int, consolidation_id: int, parent_id: int | None, position: int, first_id: int, funnel: bool) -> DataFrame:
    """Rows of a consolidation for a node and all below it.

    Ids count from `first_id` in the order of node ids. Children are numbered from 1, folders first, then by lower-cased name. With
    the funnel a row is struck when it is a cross duplicate and nothing between it and the root is; the root never is. A root that does not exist gives no rows.
    """
    spark = nodes.sparkSession
    below = closure.where(F.col("ancestor_id") == root_id).select("node_id").union(nodes.where(F.col("node_id") == root_id).select("node_id"))
    rows = materialize(spark, nodes.join(below, "node_id", "left_semi").select("node_id", "parent_id", "name", "type"), "subtree")
    crossed = annotations.where("cross_dup").select("node_id").distinct()
    folders = rows.where("type = 'directory'").select("node_id")
    line = closure.join(folders, "node_id", "left_semi").select("node_id", "ancestor_id").union(folders.select("node_id", F.col("node_id").alias("ancestor_id")))
    inner = line.join(folders.where(F.col("node_id") != root_id).select(F.col("node_id").alias("ancestor_id")), "ancestor_id", "left_semi")
    hidden = inner.join(crossed.select(F.col("node_id").alias("ancestor_id")), "ancestor_id", "left_semi").select(F.col("node_id").alias("parent_id")).distinct().withColumn("under", F.lit(True))
    joined = rows.join(crossed.withColumn("own", F.lit(True)), "node_id", "left").join(hidden, "parent_id", "left")
    struck = F.lit(funnel) & F.coalesce("own", F.lit(False)) & F.col("under").isNull() & (F.col("node_id") != root_id)
    order = Window.partitionBy("parent_id").orderBy(F.col("type") != "directory", F.lower("name"), "node_id")
    numbered = _numbered(spark, rows.select("node_id"), first_id)
    parents = numbered.select(F.col("node_id").alias("parent_id"), F.col("id").alias("new_parent"))
    is_root = F.col("node_id") == root_id
    return joined.withColumn("nth", F.row_number().over(order)).join(numbered, "node_id").join(parents, "parent_id", "left").select(
        "id", F.lit(consolidation_id).cast("long").alias("consolidation_id"), F.when(is_root, F.lit(parent_id).cast("long")).otherwise(F.col("new_parent")).alias("parent_id"), "name",
        normalize_type(F.col("type")).alias("type"), F.col("node_id").alias("source_node_id"), F.when(is_root, position).otherwise(F.col("nth")).cast("long").alias("sort_order"), F.lit(False).alias("done"), struck.alias("struck"),
    )


def _numbered(spark: SparkSession, rows: DataFrame, first: int) -> DataFrame:
    """node_id with ids from `first` in its order: rows are counted in each range, and only the counts of ranges come to the driver."""
    ranged = materialize(spark, rows.orderBy("node_id").withColumn("at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at", 33)
    offsets, at = [], first
    for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        offsets.append((r["p"], at))
        at += r["n"]
    if not offsets:
        return ranged.withColumn("id", F.col("at")).drop("at")
    starts = spark.createDataFrame(offsets, "p long, start long")
    return ranged.withColumn("p", part).join(F.broadcast(starts), "p").select("node_id", (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("id"))


def purge_source_files(rows: DataFrame, nodes: DataFrame, source_id: int) -> DataFrame:
    """Rows without the files that came from a source; folders stay and lose their origin."""
    own = nodes.where(F.col("source_id") == source_id).select(F.col("node_id").alias("source_node_id"), F.lit(True).alias("gone"))
    joined = rows.join(own, "source_node_id", "left")
    kept = joined.where("gone IS NULL OR type = 'directory'")
    return kept.withColumn("source_node_id", F.when(F.col("gone").isNull(), F.col("source_node_id"))).select(*rows.columns)


def delete_nodes(rows: DataFrame, closure: DataFrame, ids: list[int]) -> DataFrame:
    """Rows without some and all below them."""
    gone = closure.where(F.col("ancestor_id").isin(*ids)).select(F.col("node_id").alias("id"))
    return rows.where(~F.col("id").isin(*ids)).join(gone, "id", "left_anti")


def move_node(rows: DataFrame, closure: DataFrame, node: int, parent: int | None, position: int) -> DataFrame:
    """A row under another parent; refused when that is the row itself or below it."""
    if parent is not None and (parent == node or not closure.where((F.col("node_id") == parent) & (F.col("ancestor_id") == node)).isEmpty()):
        raise ValueError("a folder cannot move into itself")
    mine = F.col("id") == node
    return rows.withColumns({"parent_id": F.when(mine, F.lit(parent).cast("long")).otherwise(F.col("parent_id")), "sort_order": F.when(mine, F.lit(position).cast("long")).otherwise(F.col("sort_order"))})


def set_flag(rows: DataFrame, flag: str, ids: list[int], value: bool) -> DataFrame:
    return rows.withColumn(flag, F.when(F.col("id").isin(*ids), F.lit(value)).otherwise(F.col(flag)))


def _folders(rows: DataFrame) -> DataFrame:
    return rows.where("type = 'directory'").select("id").union(rows.where("parent_id IS NOT NULL").select("parent_id")).distinct()


def _folder_closure(rows: DataFrame, closure: DataFrame) -> DataFrame:
    """id, ancestor_id, distance of rows that are folders (or have children), themselves included at distance 0.

    Sums and marks go from children to folders to ancestors, so a folder above very many files gets a row for each folder below it, not for each file.
    """
    held = _folders(rows)
    up = closure.withColumnRenamed("node_id", "id").join(held, "id", "left_semi").select("id", "ancestor_id", F.col("distance").cast("int").alias("distance"))
    return up.unionByName(held.select("id", F.col("id").alias("ancestor_id"), F.lit(0).alias("distance")))


def inherited(rows: DataFrame, closure: DataFrame) -> DataFrame:
    """Rows with `struck_all`: struck themselves or under a struck one."""
    struck = rows.where("struck").select(F.col("id").alias("ancestor_id"))
    hidden = _folder_closure(rows, closure).join(struck, "ancestor_id", "left_semi").select(F.col("id").alias("parent_id")).distinct().withColumn("under", F.lit(True))
    return rows.join(hidden, "parent_id", "left").select(*rows.columns, (F.col("struck") | F.coalesce("under", F.lit(False))).alias("struck_all"))


def consolidated_stats(rows: DataFrame, closure: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each folder: live_files, live_bytes, struck_files, struck_bytes, all_done of what is below it.

    A struck file counts to the struck part of its struck folders only; aliases hold no bytes. A folder is done when all below it is, and there is something.
    """
    flagged = inherited(rows, closure).join(sizes, "source_node_id", "left").select("id", "parent_id", "type", "done", "struck_all", F.coalesce("size", F.lit(0)).alias("size"))
    file, dead = F.col("type") == "file", F.col("struck_all")
    own = flagged.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(
        F.count_if(file & ~dead).alias("live_files"), F.sum(F.when(file & ~dead, F.col("size")).otherwise(0)).alias("live_bytes"),
        F.count_if(file & dead).alias("struck_files"), F.sum(F.when(file & dead, F.col("size")).otherwise(0)).alias("struck_bytes"), F.bool_and("done").alias("all_done"),
    )
    names = ("live_files", "live_bytes", "struck_files", "struck_bytes")
    below = _folder_closure(rows, closure).join(own, "id").groupBy(F.col("ancestor_id").alias("id")).agg(*[F.sum(c).alias(c) for c in names], F.bool_and("all_done").alias("all_done"))
    joined = flagged.where("type = 'directory'").select("id", F.col("struck_all").alias("folder_struck")).join(below, "id", "left")
    shown = {c: F.coalesce(F.col(c) if c.startswith("live") else F.when(F.col("folder_struck"), F.col(c)), F.lit(0)) for c in names}
    return joined.select("id", *[v.cast("long").alias(c) for c, v in shown.items()], F.coalesce("all_done", F.lit(False)).alias("all_done"))


def effective_names(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """Rows with the names that renames of kind `cons` give them; an empty new name counts as none."""
    new = renames.where("kind = 'cons' AND new_name <> ''").select(F.col("ref_id").alias("id"), "new_name")
    return rows.join(new, "id", "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name")


def path_lengths(spark: SparkSession, rows: DataFrame, renames: DataFrame, closure: DataFrame | None = None, prefix: str = "", limit: int = 260) -> DataFrame:
    """id, path, length, measured, over_limit of every row.

    Paths join names with a backslash; length counts code points. Measured are rows that are not struck, by themselves or
    from above, unless they are folders with a child that has no strike of its own. A row is over the limit when it or a
    measured row below it is longer.
    """
    named = effective_names(rows, renames)
    closure = closure_by_parent(spark, named.join(_folders(named), "id", "left_semi").select(F.col("id").alias("node_id"), "parent_id")) if closure is None else closure
    up = _folder_closure(named, closure)
    names = named.select(F.col("id").alias("ancestor_id"), "name")
    parts = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name"))), lambda x: x["name"])
    folders = up.join(names, "ancestor_id").groupBy(F.col("id").alias("parent_id")).agg(F.array_join(parts, "\\").alias("above"))
    holds = named.where("NOT struck AND parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct().withColumn("holds", F.lit(True))
    facts = inherited(named, closure).join(holds, "id", "left").join(folders, "parent_id", "left")
    path = F.concat(F.lit(prefix), F.concat_ws("\\", "above", "name"))
    measured = ~F.col("struck_all") & ~((F.col("type") == "directory") & F.coalesce("holds", F.lit(False)))
    facts = facts.select("id", "parent_id", path.alias("path"), F.length(path).alias("length"), measured.alias("measured"))
    long = F.col("measured") & (F.col("length") > limit)
    near = facts.where(long & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id")).distinct()
    marked = up.join(near, "id", "left_semi").select(F.col("ancestor_id").alias("id")).distinct().withColumn("over", F.lit(True))
    return facts.join(marked, "id", "left").withColumn("over_limit", long | F.coalesce("over", F.lit(False))).drop("over", "parent_id")


def rename(renames: DataFrame, workspace_id: int, kind: str, ref_id: int, current: str, new_name: str) -> DataFrame:
    """A rename recorded; the first original name is kept, and an empty name or the original one takes the rename back."""
    mine = (F.col("workspace_id") == workspace_id) & (F.col("kind") == kind) & (F.col("ref_id") == ref_id)
    held = renames.where(mine).select("original_name").first()
    original = held["original_name"] if held else current
    rest = renames.where(~mine)
    if not new_name or new_name == original:
        return rest
    row = rest.sparkSession.createDataFrame([(None, workspace_id, kind, ref_id, new_name, original, True)], "id long, workspace_id long, kind string, ref_id long, new_name string, original_name string, resolved boolean")
    return rest.unionByName(row, allowMissingColumns=True)
