"""Table schemas of the catalogue, and reading tables that lack later columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DDL = {
    "workspaces": "id long, name string, created_at string, updated_at string",
    "sources": """id long, workspace_id long, kind string, label string, device_label string, orig_root_path string, dev_id long, imported_at string,
        total_size long, file_count long, excluded boolean, physical_size long, alias_bytes long, medium_kind string, filesystem string, hash_min_size long,
        hash_spec string, hash_coverage_files long, hash_coverage_bytes long, volume_id string, hashing_enabled boolean, color string""",
    "nodes": """id long, source_id long, parent_id long, name string, rel_path string, type string, size long, mtime string, inode long, dev long, depth int,
        subtree_size long, subtree_file_count long, alias_of long, inode_trusted boolean, inode_high long, content_hash string, hash_kind string,
        hash_spec string, hash_bytes_read long, hashed_at string, listing_hash string, link_target string""",
    "match_groups": "id string, workspace_id long, kind string, confidence double, primary_signal string, size long",
    "match_members": "group_id string, node_id long, role string",
    "consolidations": "id long, workspace_id long, name string",
    "consolidation_nodes": "id long, consolidation_id long, parent_id long, name string, type string, source_node_id long, sort_order long, done boolean, struck boolean",
    "pathfix_state": "id long, workspace_id long, kind string, ref_id long, new_name string, original_name string, resolved boolean",
    "app_state": "key string, value string",
    "workspace_state": "workspace_id long, key string, value string",
    "dup_annot": "node_id long, has_dup boolean, dup_pct double, cross_dup boolean, cross_dup_size long, cross_dup_file_count long, in_folder_group boolean, skipped boolean, skipped_count long",
    "hash_cache": "volume_id string, file_id long, size long, mtime string, hash_spec string, content_hash string, hash_kind string, computed_at string",
    "scan_progress": "source_id long, phase string, last_cursor long, updated_at string",
}
SCHEMAS: dict[str, str] = {name: " ".join(ddl.split()) for name, ddl in _DDL.items()}

#: What a missing or null column of an older table means.
DEFAULTS = {
    "sources": {"total_size": 0, "file_count": 0, "excluded": False, "physical_size": 0, "alias_bytes": 0, "hash_min_size": 65536, "hash_coverage_files": 0, "hash_coverage_bytes": 0, "hashing_enabled": True},
    "nodes": {"size": 0, "depth": 0, "subtree_size": 0, "subtree_file_count": 0, "inode_trusted": False},
    "consolidation_nodes": {"sort_order": 0, "done": False, "struck": False},
    "match_members": {"role": "member"},
}


def columns(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in " ".join(_DDL[table].split()).split(", ")]


def with_missing_columns(df: DataFrame, table: str) -> DataFrame:
    """`df` with exactly the table's columns: missing ones get their default, and those there keep their values."""
    default = DEFAULTS.get(table, {})
    return df.select(*[(F.col(c) if c in df.columns else F.lit(default.get(c))).cast(t).alias(c) for c, t in columns(table)])
