"""The catalogue: versioned Parquet snapshots of its tables, and what changes them.

A snapshot is a folder for each table version; numbered pointers name them, and the newest one counts, so readers never see half a
write and a writer that fails leaves the version before. Changes rewrite the table they touch. Paths go through Spark's own file systems, so a catalogue may
lie wherever Spark can read.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions.regions import HashSpec
from treeledger.schema import SCHEMAS, with_missing_columns

#: Tables that import and export carry; caches, progress and settings of a workspace stay behind.
CARRIED = ("workspaces", "sources", "nodes", "match_groups", "match_members", "consolidations", "consolidation_nodes", "pathfix_state", "dup_annot")


def now() -> str:
    return time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())


class Catalog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # Snapshots

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _pointers(self, table: str) -> list[int]:
        fs, path = self._fs()
        at = path(f"{self.folder}/{table}/current")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()) if fs.exists(at) else []

    def _version(self, table: str) -> str | None:
        held = self._pointers(table)
        if not held:
            return None
        fs, path = self._fs()
        at = fs.open(path(f"{self.folder}/{table}/current/{held[-1]}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(at, "UTF-8")
        finally:
            at.close()

    def read(self, table: str) -> DataFrame:
        version = self._version(table)
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return with_missing_columns(self.spark.read.parquet(f"{self.folder}/{table}/{version}"), table)

    def write(self, table: str, df: DataFrame) -> None:
        """A new version; the pointer is moved to it when it is whole, and the one before is kept for running readers."""
        version = f"v-{uuid.uuid4().hex}"
        with_missing_columns(df, table).write.parquet(f"{self.folder}/{table}/{version}")
        fs, path = self._fs()
        fresh, held = f"{self.folder}/{table}/.pointer-{version}", self._pointers(table)
        out = fs.create(path(fresh), False)
        out.write(bytearray(version.encode()))
        out.close()
        fs.mkdirs(path(f"{self.folder}/{table}/current"))
        at = path(f"{self.folder}/{table}/current/{held[-1] + 1 if held else 1}")
        if fs.exists(at) or not fs.rename(path(fresh), at):
            raise OSError(f"another writer changed {table}")

    def append(self, table: str, df: DataFrame) -> None:
        self.write(table, self.read(table).unionByName(with_missing_columns(df, table)))

    def upsert(self, table: str, df: DataFrame, keys: list[str]) -> None:
        """Rows of `df` replace those with the same keys."""
        self.write(table, self.read(table).join(df.select(*keys), keys, "left_anti").unionByName(with_missing_columns(df, table)))

    def update(self, table: str, where: Column, **values) -> None:
        rows = self.read(table)
        self.write(table, rows.withColumns({c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}))

    def delete(self, table: str, where: Column) -> None:
        self.write(table, self.read(table).where(~F.coalesce(where, F.lit(False))))

    def _next_id(self, table: str) -> int:
        return (self.read(table).agg(F.max("id")).first()[0] or 0) + 1

    def _row(self, table: str, **values) -> DataFrame:
        names = [c for c in values]
        kinds = dict(c.split() for c in SCHEMAS[table].split(", "))
        return self.spark.createDataFrame([tuple(values.values())], ", ".join(f"{c} {kinds[c]}" for c in names))

    # Workspaces and settings

    def workspaces(self) -> DataFrame:
        return self.read("workspaces").orderBy("id")

    def workspace_create(self, name: str) -> int:
        at = self._next_id("workspaces")
        self.append("workspaces", self._row("workspaces", id=at, name=name, created_at=now(), updated_at=now()))
        return at

    def workspace_rename(self, workspace_id: int, name: str) -> None:
        self.update("workspaces", F.col("id") == workspace_id, name=name, updated_at=now())

    def workspace_delete(self, workspace_id: int) -> None:
        for r in self.read("sources").where(F.col("workspace_id") == workspace_id).select("id").collect():
            self._drop_source(r["id"])
        mine = F.col("workspace_id") == workspace_id
        groups = self.read("match_groups").where(mine).select(F.col("id").alias("group_id"))
        self.write("match_members", self.read("match_members").join(groups, "group_id", "left_anti"))
        plans = self.read("consolidations").where(mine).select(F.col("id").alias("consolidation_id"))
        self.write("consolidation_nodes", self.read("consolidation_nodes").join(plans, "consolidation_id", "left_anti"))
        for table in ("match_groups", "consolidations", "pathfix_state", "workspace_state"):
            self.delete(table, mine)
        self.delete("workspaces", F.col("id") == workspace_id)

    def state_get(self, key: str, workspace_id: int | None = None) -> str | None:
        rows = self.read("app_state") if workspace_id is None else self.read("workspace_state").where(F.col("workspace_id") == workspace_id)
        row = rows.where(F.col("key") == key).first()
        return row["value"] if row else None

    def state_set(self, key: str, value: str, workspace_id: int | None = None) -> None:
        if workspace_id is None:
            self.upsert("app_state", self._row("app_state", key=key, value=value), ["key"])
        else:
            self.upsert("workspace_state", self._row("workspace_state", workspace_id=workspace_id, key=key, value=value), ["workspace_id", "key"])

    # Sources

    def source_add(self, workspace_id: int, nodes: DataFrame, **facts) -> int:
        """A source with its nodes (source_id is set here); totals and hardlinks come from them."""
        from treeledger.functions.scalars import filesystem_is_trusted, node_key, parent_path
        from treeledger.operators.tree import hardlinks, source_totals, subtree_totals
        from treeledger.scratch import materialize

        at = self._next_id("sources")
        names = {c.split()[0]: c.split()[1] for c in SCHEMAS["nodes"].split(", ")}
        blank = {c: F.lit(None).cast(t) for c, t in names.items() if c not in nodes.columns}
        own = nodes.withColumns(blank).withColumn("source_id", F.lit(at).cast("long")).withColumn("node_id", node_key(F.col("source_id"), F.col("rel_path")))
        up = parent_path(F.col("rel_path"))
        own = own.withColumn("parent_id", F.when(up != "", node_key(F.col("source_id"), up)))
        source = self._row("sources", id=at, workspace_id=workspace_id, imported_at=now(), **facts)
        whole = with_missing_columns(source, "sources")
        own = materialize(self.spark, own, "source")
        sets = materialize(self.spark, hardlinks(own, whole), "hardlinks")
        own = own.join(sets.where("node_id <> canonical_id").select("node_id", F.col("canonical_id").alias("found")), "node_id", "left").withColumn("alias_of", F.col("found")).drop("found")
        trusted = whole.select(F.coalesce((F.col("kind") == "scan") & filesystem_is_trusted(F.col("filesystem")), F.lit(False))).first()[0]
        own = own.withColumn("inode_trusted", F.lit(trusted))
        sums = source_totals(own).first()
        totals = subtree_totals(own).withColumnsRenamed({"subtree_size": "s", "subtree_file_count": "n"})
        own = own.join(totals, "node_id", "left").withColumns({"id": F.col("node_id"), "subtree_size": F.col("s"), "subtree_file_count": F.col("n")})
        if sums:
            whole = whole.withColumns({c: F.lit(sums[c]).cast("long") for c in ("total_size", "file_count", "alias_bytes", "physical_size")})
        self.append("nodes", own)
        self.append("sources", whole)
        group = F.concat(F.lit(f"{workspace_id}|hardlink|"), F.col("canonical_id").cast("string"))
        heads = sets.where("node_id = canonical_id").join(own.select("node_id", "size"), "node_id")
        self._add_members(heads.select(group.alias("id"), F.lit(workspace_id).alias("workspace_id"), F.lit("hardlink").alias("kind"), F.lit(100.0).alias("confidence"), F.lit("inode").alias("primary_signal"), "size"), sets.select(group.alias("group_id"), "node_id"))
        self._stale(workspace_id)
        return at

    def _add_members(self, groups: DataFrame, members: DataFrame) -> None:
        if not groups.isEmpty():
            self.append("match_members", members)
            self.append("match_groups", groups)

    def _workspace_of(self, source_id: int) -> int | None:
        row = self.read("sources").where(F.col("id") == source_id).first()
        return row["workspace_id"] if row else None

    def _stale(self, workspace_id: int | None) -> None:
        """What changed sources or digests makes the workspace's groups out of date until the next matching."""
        if workspace_id is not None:
            self.state_set("dedup_stale", "1", workspace_id)

    def source_set(self, source_id: int, **values) -> None:
        """Label, colour, exclusion or least size to digest of a source; exclusion makes groups out of date."""
        self.update("sources", F.col("id") == source_id, **values)
        if "excluded" in values:
            self._stale(self._workspace_of(source_id))

    def _drop_source(self, source_id: int) -> None:
        own = self.read("nodes").where(F.col("source_id") == source_id).select(F.col("id").alias("node_id"))
        self.write("match_members", self.read("match_members").join(own, "node_id", "left_anti"))
        self.write("dup_annot", self.read("dup_annot").join(own, "node_id", "left_anti"))
        self.delete("nodes", F.col("source_id") == source_id)
        self.delete("scan_progress", F.col("source_id") == source_id)
        self.delete("sources", F.col("id") == source_id)
        self._remove(self._digests(source_id))

    def source_delete(self, source_id: int) -> None:
        """Files that came from it leave consolidations, then it goes with its nodes, then groups left with fewer than two members."""
        from treeledger.operators.plan_tree import purge_source_files

        workspace = self._workspace_of(source_id)
        nodes = self.read("nodes").withColumn("node_id", F.col("id"))
        self.write("consolidation_nodes", purge_source_files(self.read("consolidation_nodes"), nodes, source_id))
        self._drop_source(source_id)
        self.sweep_groups()
        self._stale(workspace)

    def sweep_groups(self) -> None:
        held = self.read("match_members").groupBy(F.col("group_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1")
        self.write("match_groups", self.read("match_groups").join(held, "id", "left_semi"))
        self.write("match_members", self.read("match_members").join(held.select(F.col("id").alias("group_id")), "group_id", "left_semi"))

    # Digest settings

    def hash_spec(self, workspace_id: int) -> HashSpec:
        held = self.state_get("hash_spec", workspace_id)
        return HashSpec.parse(held) if held else HashSpec()

    def set_hash_spec(self, workspace_id: int, spec: HashSpec) -> None:
        """Refused once a digest of the workspace was read under another spec."""
        mine = self.read("sources").where(F.col("workspace_id") == workspace_id).select(F.col("id").alias("source_id"))
        used = self.read("nodes").where(F.col("hash_spec").isNotNull() & (F.col("hash_spec") != str(spec))).join(mine, "source_id", "left_semi")
        if not used.isEmpty():
            raise ValueError("digests exist under another specification")
        self.state_set("hash_spec", str(spec), workspace_id)

    def _digests(self, source_id: int) -> str:
        return f"{self.folder}/digests/{source_id}"

    def _remove(self, folder: str) -> None:
        fs, path = self._fs()
        fs.delete(path(folder), True)

    def hash_source(self, source_id: int, cancelled: Callable[[], bool] = lambda: False, progress: Callable[[int, int], None] = lambda done, all_: None, batch: int = 2_000) -> dict[str, int | bool]:
        """Digest a source's files: cached digests first, then reads in committed batches, all merged into nodes, cache and coverage.

        Returns hashed, cached, errors and cancelled. Batches that a lost or cancelled run committed are merged by the next one; a file that
        cannot be read is tried again then. Sources without a root folder have nothing to read.
        """
        from treeledger.functions.scalars import cache_volume_id
        from treeledger.operators import hashing
        from treeledger.scratch import materialize

        source = self.read("sources").where(F.col("id") == source_id).first()
        report = {"hashed": 0, "cached": 0, "errors": 0, "cancelled": False}
        if source is None or not source["orig_root_path"]:
            return report
        spec, at = self.hash_spec(source["workspace_id"]), now()
        own = self.read("nodes").where(F.col("source_id") == source_id).withColumn("node_id", F.col("id"))
        files = materialize(self.spark, hashing.hash_candidates(own, source["hash_min_size"]), "candidates")
        known = materialize(self.spark, hashing.from_cache(files, self.read("hash_cache"), source["volume_id"], spec), "cached")
        left = files.join(known, "node_id", "left_anti")
        self.upsert("scan_progress", self._row("scan_progress", source_id=source_id, phase="hashing", last_cursor=own.where("content_hash IS NOT NULL").count(), updated_at=at), ["source_id"])
        folder = f"{self._digests(source_id)}/{uuid.uuid5(uuid.NAMESPACE_OID, str(spec)).hex}"
        phase = hashing.run_hash_scan(self.spark, left, source["orig_root_path"], folder, spec, cancelled, progress, batch)
        fs, path = self._fs()
        read = self.spark.read.parquet(folder) if fs.exists(path(folder)) else self.spark.createDataFrame([], "node_id long, content_hash string, hash_kind string, hash_spec string, hash_bytes_read long")
        read = read.join(left, "node_id", "left_semi").dropDuplicates(["node_id"])
        new = materialize(self.spark, read.unionByName(known, allowMissingColumns=True), "digests")
        report["hashed"], report["cached"] = new.where("hash_bytes_read IS NOT NULL").count(), new.where("hash_bytes_read IS NULL").count()
        report["cancelled"] = phase != "done"
        report["errors"] = 0 if report["cancelled"] else left.count() - report["hashed"]
        if report["hashed"] or report["cached"]:
            names = ("content_hash", "hash_kind", "hash_spec", "hash_bytes_read")
            nodes = self.read("nodes").join(new.select(F.col("node_id").alias("id"), *[F.col(c).alias(f"new_{c}") for c in names]), "id", "left")
            has = F.col("new_content_hash").isNotNull()
            self.write("nodes", nodes.withColumns({c: F.when(has, F.col(f"new_{c}")).otherwise(F.col(c)) for c in names} | {"hashed_at": F.when(has, F.lit(at)).otherwise(F.col("hashed_at"))}))
            keyed = files.where("dev IS NOT NULL AND inode IS NOT NULL").join(new.where("hash_bytes_read IS NOT NULL").select("node_id", *[F.col(c).alias(f"new_{c}") for c in names]), "node_id")
            rows = keyed.select(cache_volume_id(F.lit(source["volume_id"]).cast("string"), F.col("dev")).alias("volume_id"), F.col("inode").alias("file_id"), "size", F.coalesce("mtime", F.lit("")).alias("mtime"), *[F.col(f"new_{c}").alias(c) for c in names[:3]], F.lit(at).alias("computed_at"))
            key = ["volume_id", "file_id", "size", "mtime", "hash_spec"]
            self.upsert("hash_cache", rows.groupBy(*key).agg(F.min(F.struct("content_hash", "hash_kind", "computed_at")).alias("r")).select(*key, "r.*"), key)
            done = self.read("nodes").where((F.col("source_id") == source_id) & F.col("content_hash").isNotNull()).agg(F.count("*").alias("n"), F.sum(F.coalesce("hash_bytes_read", "size")).alias("b")).first()
            self.update("sources", F.col("id") == source_id, hash_spec=str(spec), hash_coverage_files=done["n"], hash_coverage_bytes=done["b"])
            self.state_set("hash_spec", str(spec), source["workspace_id"])
            self._stale(source["workspace_id"])
        covered = self.read("nodes").where((F.col("source_id") == source_id) & F.col("content_hash").isNotNull()).count()
        self.upsert("scan_progress", self._row("scan_progress", source_id=source_id, phase=phase, last_cursor=covered, updated_at=now()), ["source_id"])
        self._remove(self._digests(source_id))
        return report

    def scan_progress(self, source_id: int) -> tuple[str, int] | None:
        """Phase and files with digests; `hashing` is a run that was cut off."""
        row = self.read("scan_progress").where(F.col("source_id") == source_id).first()
        return (row["phase"], row["last_cursor"]) if row else None

    # Consolidation

    def consolidation_get(self, workspace_id: int) -> tuple[int, DataFrame]:
        """The workspace's consolidation, made when there is none, and its rows with what their origin says."""
        plans = self.read("consolidations").where(F.col("workspace_id") == workspace_id)
        held = plans.orderBy("id").first()
        at = held["id"] if held else self._next_id("consolidations")
        if not held:
            self.append("consolidations", self._row("consolidations", id=at, workspace_id=workspace_id, name="Consolidated"))
        rows = self.read("consolidation_nodes").where(F.col("consolidation_id") == at)
        origin = self.read("nodes").select(F.col("id").alias("source_node_id"), "size", F.col("rel_path").alias("origin_path"), F.col("alias_of").isNotNull().alias("is_alias"), F.col("source_id").alias("origin_source_id"))
        devices = self.read("sources").select(F.col("id").alias("origin_source_id"), F.col("device_label").alias("origin_device"))
        names = self.read("pathfix_state").where((F.col("workspace_id") == workspace_id) & (F.col("kind") == "cons") & (F.col("new_name") != "")).select(F.col("ref_id").alias("id"), "original_name")
        joined = rows.join(origin, "source_node_id", "left").join(devices, "origin_source_id", "left").join(names, "id", "left")
        out = joined.withColumns({"size": F.when(F.col("type") != "directory", F.col("size")), "is_alias": F.coalesce("is_alias", F.lit(False))})
        return at, out.select(*rows.columns, "size", "origin_device", "origin_path", "is_alias", "origin_source_id", "original_name").orderBy("parent_id", "sort_order", "id")

    def consolidation_add_node(self, consolidation_id: int, parent_id: int | None, name: str, node_type: str, source_node_id: int | None = None) -> int:
        """A row after its folder's last child; returns its id."""
        from treeledger.operators.plan_tree import next_position

        at = self._next_id("consolidation_nodes")
        mine = self.read("consolidation_nodes").where(F.col("consolidation_id") == consolidation_id)
        self.append("consolidation_nodes", self._row("consolidation_nodes", id=at, consolidation_id=consolidation_id, parent_id=parent_id, name=name, type=node_type, source_node_id=source_node_id, sort_order=next_position(mine, parent_id)))
        return at

    def consolidation_add_source_subtree(self, consolidation_id: int, parent_id: int | None, source_node_id: int, filter_cross_dup: bool = False) -> DataFrame:
        """A source's folder and all below it as rows, cross duplicates struck where the filter is on; returns the new rows."""
        from treeledger.operators.plan_tree import materialize_subtree, next_position
        from treeledger.operators.tree import closure_by_path
        from treeledger.scratch import materialize

        nodes = self.read("nodes").withColumn("node_id", F.col("id"))
        root = nodes.where(F.col("id") == source_node_id).select("source_id", "rel_path").first()
        if root is None:
            return self.spark.createDataFrame([], SCHEMAS["consolidation_nodes"])
        inside = nodes.where((F.col("source_id") == root["source_id"]) & ((F.col("rel_path") == root["rel_path"]) | F.col("rel_path").startswith(root["rel_path"] + "/")))
        mine = self.read("consolidation_nodes").where(F.col("consolidation_id") == consolidation_id)
        rows = materialize_subtree(inside, closure_by_path(inside), self.read("dup_annot"), source_node_id, consolidation_id, parent_id, next_position(mine, parent_id), self._next_id("consolidation_nodes"), filter_cross_dup)
        rows = materialize(self.spark, rows, "rows")
        self.append("consolidation_nodes", rows)
        return rows

    def _plan_closure(self, rows: DataFrame) -> DataFrame:
        from treeledger.operators.tree import closure_by_parent

        return closure_by_parent(self.spark, rows.select(F.col("id").alias("node_id"), "parent_id"))

    def consolidation_move_node(self, node_id: int, parent_id: int | None, sort_order: int) -> None:
        """A row under another parent; refused when that lies below it."""
        from treeledger.operators.plan_tree import move_node

        rows = self.read("consolidation_nodes")
        self.write("consolidation_nodes", move_node(rows, self._plan_closure(rows), node_id, parent_id, sort_order))

    def consolidation_delete_nodes(self, ids: list[int]) -> None:
        """Rows and all below them."""
        from treeledger.operators.plan_tree import delete_nodes

        rows = self.read("consolidation_nodes")
        self.write("consolidation_nodes", delete_nodes(rows, self._plan_closure(rows), ids))

    def consolidation_set_done(self, ids: list[int], value: bool) -> None:
        """The done mark of exactly these rows."""
        self.update("consolidation_nodes", F.col("id").isin(*ids), done=value)

    def consolidation_set_struck(self, ids: list[int], value: bool) -> None:
        """The strike of exactly these rows; what lies below inherits it when read."""
        self.update("consolidation_nodes", F.col("id").isin(*ids), struck=value)

    # Path limits

    def path_tree(self, workspace_id: int, limit: int = 260) -> DataFrame:
        """id, path, length, measured, over_limit of the rows of the workspace's consolidations."""
        from treeledger.operators.plan_tree import path_lengths

        rows = self.read("consolidation_nodes").join(self.read("consolidations").where(F.col("workspace_id") == workspace_id).select(F.col("id").alias("consolidation_id")), "consolidation_id", "left_semi")
        return path_lengths(self.spark, rows, self.read("pathfix_state").where(F.col("workspace_id") == workspace_id), limit=limit)

    def path_rename(self, workspace_id: int, ref_id: int, new_name: str) -> tuple[str, str | None]:
        """The row's name and, while it is renamed, the original one. An empty name or the original takes a rename back."""
        from treeledger.operators.plan_tree import rename

        row = self.read("consolidation_nodes").where(F.col("id") == ref_id).first()
        if row is None:
            raise ValueError(f"no row {ref_id}")
        mine = (F.col("workspace_id") == workspace_id) & (F.col("kind") == "cons") & (F.col("ref_id") == ref_id)
        before = self.read("pathfix_state")
        held = before.where(mine).select("original_name").first()
        after = rename(before, workspace_id, "cons", ref_id, row["name"], new_name).withColumn("id", F.coalesce("id", F.lit(self._next_id("pathfix_state")).cast("long")))
        back = not new_name or (held is not None and new_name == held["original_name"])
        name = (held["original_name"] if held else row["name"]) if back else new_name
        original = None if back or new_name == row["name"] and not held else (held["original_name"] if held else row["name"])
        self.write("pathfix_state", after)
        self.update("consolidation_nodes", F.col("id") == ref_id, name=name)
        return name, original

    # Matching

    def run_matching(self, workspace_id: int, params=None, progress: Callable[[str, int, int], None] = lambda phase, done, all_: None) -> int:
        """Match live sources, rebuild groups, annotations and listing digests; returns the number of groups.

        `progress` gets each phase: loading, matching, folders, writing, done.
        """
        from treeledger.functions.scalars import node_key
        from treeledger.operators import matching, rollup, tree
        from treeledger.scratch import materialize

        params = params or matching.MatchParams()
        sources = self.read("sources").where(F.col("workspace_id") == workspace_id)
        progress("loading", 0, 4)
        nodes = materialize(self.spark, tree.live(self.read("nodes").withColumn("node_id", F.col("id")), sources), "live")
        progress("matching", 1, 4)
        groups, skipped = matching.match(self.spark, nodes, params)
        cross = materialize(self.spark, rollup.cross_source(groups, nodes), "cross")
        progress("folders", 2, 4)
        folders = rollup.overlap_folders(nodes, cross).withColumn("kind", F.lit("folder"))
        hashes = materialize(self.spark, rollup.listing_hashes(self.spark, nodes), "listings")
        listed = rollup.listing_folders(nodes, hashes, params.min_size).withColumn("kind", F.lit("folder"))
        found = materialize(self.spark, groups.unionByName(folders.select(*groups.columns)).unionByName(listed.select(*groups.columns)), "found")
        # A group's key is the same in every workspace that holds the same files, so its id names the workspace too.
        found = found.withColumn("group_key", F.concat(F.lit(f"{workspace_id}|"), "group_key"))
        progress("writing", 3, 4)
        rows = found.groupBy(F.col("group_key").alias("id"), "kind", "confidence", F.col("signal").alias("primary_signal")).agg(F.min("size").alias("size")).withColumn("workspace_id", F.lit(workspace_id).cast("long"))
        old = self.read("match_groups").where((F.col("workspace_id") == workspace_id) & (F.col("kind") != "hardlink")).select(F.col("id").alias("group_id"))
        members = self.read("match_members").join(old, "group_id", "left_anti").unionByName(found.select(F.col("group_key").alias("group_id"), "node_id", F.lit("member").alias("role")))
        self.write("match_members", members)
        self.write("match_groups", with_missing_columns(self.read("match_groups").where((F.col("workspace_id") != workspace_id) | (F.col("kind") == "hardlink")), "match_groups").unionByName(with_missing_columns(rows, "match_groups")))
        fresh = rollup.annotations(nodes, groups, cross, skipped, found.where("kind = 'folder'"))
        mine = self.read("nodes").join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("id").alias("node_id"))
        self.write("dup_annot", self.read("dup_annot").join(mine, "node_id", "left_anti").unionByName(with_missing_columns(fresh, "dup_annot")))
        marks = hashes.select(node_key(F.col("source_id"), F.col("dir_path")).alias("id"), F.col("listing_hash").alias("listed"))
        self.write("nodes", self.read("nodes").join(marks, "id", "left").withColumn("listing_hash", F.coalesce("listed", "listing_hash")).drop("listed"))
        self.state_set("dedup_stale", "0", workspace_id)
        progress("done", 4, 4)
        return rows.count()

    # Export and import

    def export_to(self, folder: str) -> None:
        other = Catalog(self.spark, folder)
        for table in CARRIED:
            other.write(table, self.read(table))

    def import_merge(self, folder: str) -> list[int]:
        """Another catalogue's workspaces as new ones here; returns their ids.

        A name that is taken gets ` (imported N)`, N from 2. Ids of workspaces, sources, plans and plan rows are
        shifted past those here; node ids are digests of source and path, so they are made anew. Members are kept when both group
        and node come along; renames of source nodes are kept and those of plan rows dropped.
        """
        from treeledger.functions.scalars import node_key

        other = Catalog(self.spark, folder)
        shift = {t: self._next_id(t) - 1 for t in ("workspaces", "sources", "consolidations", "consolidation_nodes", "pathfix_state")}
        taken = {r["name"] for r in self.read("workspaces").select("name").collect()}
        fresh, ids = [], []
        for r in other.read("workspaces").orderBy("id").collect():
            name, n = r["name"], 2
            while name in taken:
                name, n = f"{r['name']} (imported {n})", n + 1
            taken.add(name)
            ids.append(r["id"] + shift["workspaces"])
            fresh.append((ids[-1], name, r["created_at"], now()))
        moved = lambda c, t: (F.col(c) + shift[t]).alias(c)
        keep = lambda df, *out: df.select(*[c for c in df.columns if c not in {o._jc.toString().split(" AS ")[-1].strip("`") for o in out}], *out)
        nodes = other.read("nodes")
        node_map = nodes.select(F.col("id").alias("old"), node_key(F.col("source_id") + shift["sources"], F.col("rel_path")).alias("new"))

        def renumbered(df: DataFrame, column: str) -> DataFrame:
            joined = df.join(node_map.withColumnRenamed("old", column), column, "left")
            return joined.withColumn(column, F.col("new")).drop("new").select(*df.columns)

        for c in ("id", "parent_id", "alias_of"):
            nodes = renumbered(nodes, c)
        self.append("nodes", keep(nodes, moved("source_id", "sources")))
        self.append("sources", keep(other.read("sources"), moved("id", "sources"), moved("workspace_id", "workspaces")))
        tag = uuid.uuid4().hex[:8]
        name = lambda c: F.concat(F.col(c), F.lit(f"@{tag}")).alias(c)
        groups = other.read("match_groups")
        self.append("match_groups", keep(groups, name("id"), moved("workspace_id", "workspaces")))
        members = other.read("match_members").join(groups.select(F.col("id").alias("group_id")), "group_id", "left_semi")
        self.append("match_members", keep(renumbered(members, "node_id").where("node_id IS NOT NULL"), name("group_id")))
        self.append("consolidations", keep(other.read("consolidations"), moved("id", "consolidations"), moved("workspace_id", "workspaces")))
        plan = renumbered(other.read("consolidation_nodes"), "source_node_id")
        self.append("consolidation_nodes", keep(plan, moved("id", "consolidation_nodes"), moved("parent_id", "consolidation_nodes"), moved("consolidation_id", "consolidations")))
        renames = renumbered(other.read("pathfix_state").where("kind = 'source'"), "ref_id").where("ref_id IS NOT NULL")
        self.append("pathfix_state", keep(renames, moved("id", "pathfix_state"), moved("workspace_id", "workspaces")))
        self.append("dup_annot", renumbered(other.read("dup_annot"), "node_id").where("node_id IS NOT NULL"))
        if fresh:
            self.append("workspaces", self.spark.createDataFrame(fresh, SCHEMAS["workspaces"]))
        return ids

    def copy_source(self, source_id: int, workspace_id: int) -> int:
        """A source and its nodes in another workspace, without groups and annotations."""
        from treeledger.functions.scalars import node_key

        at = self._next_id("sources")
        nodes = self.read("nodes").where(F.col("source_id") == source_id)
        ids = nodes.select(F.col("id").alias("old"), node_key(F.lit(at), F.col("rel_path")).alias("new"))
        for c in ("id", "parent_id", "alias_of"):
            nodes = nodes.join(ids.withColumnRenamed("old", c), c, "left").withColumn(c, F.col("new")).drop("new")
        self.append("nodes", nodes.withColumn("source_id", F.lit(at).cast("long")))
        self.append("sources", self.read("sources").where(F.col("id") == source_id).withColumns({"id": F.lit(at).cast("long"), "workspace_id": F.lit(workspace_id).cast("long")}))
        self._stale(workspace_id)
        return at
