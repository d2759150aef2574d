import json
import os

import pytest
from pyspark.sql import functions as F

from treeledger.catalog import Catalog
from treeledger.functions.regions import HashSpec
from treeledger.operators.hashing import hash_candidates, run_hash_scan
from treeledger.sources import scan, tree_json
from treeledger.streaming.arrivals import follow_listings

LISTING = [{"type": "directory", "name": ".", "dev": 10, "contents": [{"type": "directory", "name": "scores", "contents": [{"type": "file", "name": "aria.mid", "size": 412300, "inode": 5, "dev": 10}, {"type": "file", "name": "bolero.mid", "size": 731900, "inode": 5, "dev": 10}]}, {"type": "report"}]}, {"type": "report", "files": 2}]


def test_tree_json():
    rows = list(tree_json.walk(json.dumps(LISTING)))
    assert [(r[0], r[2], r[3], r[7], r[8]) for r in rows] == [("scores", "directory", 0, 0, 10), ("scores/aria.mid", "file", 412300, 1, 10), ("scores/bolero.mid", "file", 731900, 1, 10)]
    with pytest.raises(ValueError, match="Invalid tree JSON"):
        list(tree_json.walk("{"))


def test_streamed_listings(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in/one.json").write_text(json.dumps(LISTING))
    for _ in range(2):
        follow_listings(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 3


def test_scan_and_digests(spark, tmp_path):
    root = tmp_path / "root"
    os.makedirs(root / "sub")
    (root / "sub/a.bin").write_bytes(b"x" * 5000)
    (root / "b.bin").write_bytes(b"x" * 5000)
    os.symlink("b.bin", root / "l")
    rows = scan.scan_folder(spark, str(root))
    assert {(r.rel_path, r.type, r.depth) for r in rows.collect()} == {("sub", "directory", 0), ("sub/a.bin", "file", 1), ("b.bin", "file", 0), ("l", "link", 0)}
    assert tuple(scan.preview(rows, 5000).first()) == (2, 10000, 2, 10000)
    files = hash_candidates(rows.withColumns({"alias_of": F.lit(None), "content_hash": F.lit(None).cast("string"), "node_id": F.xxhash64("rel_path")}), 1)
    out = f"file://{tmp_path}/digests"
    assert run_hash_scan(spark, files, str(root), out, HashSpec(None), cancelled=lambda: True) == "hashing"
    for _ in range(2):
        assert run_hash_scan(spark, files, str(root), out, HashSpec(None)) == "done"
    assert [r.n for r in spark.read.parquet(out).groupBy("content_hash").agg(F.count("*").alias("n")).collect()] == [2]
    assert scan.medium_of(str(root))[0] in ("hdd", "ssd", "network", "optical", "unknown")


def test_catalog_round_trip(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    w = c.workspace_create("home")
    node = [r[:9] for r in tree_json.walk(json.dumps(LISTING))]
    rows = spark.createDataFrame([(p, n, k, z, d, i, v) for p, n, k, z, _, i, v, d, _ in node], "rel_path string, name string, type string, size long, depth int, inode long, dev long")
    a = c.source_add(w, rows, kind="scan", label="one", filesystem="ext4", excluded=False)
    b = c.source_add(w, rows, kind="json", label="two", excluded=False)
    totals = {r.id: (r.total_size, r.file_count, r.alias_bytes) for r in c.read("sources").collect()}
    assert totals == {a: (1144200, 2, 731900), b: (1144200, 2, 0)}
    assert c.run_matching(w) >= 1
    assert c.read("dup_annot").where("cross_dup").count() >= 1
    members = lambda: c.read("match_members").count()
    n = members()
    other = c.workspace_create("away")
    c.source_add(other, rows, kind="scan", label="x", filesystem="ext4", excluded=False)
    c.source_add(other, rows, kind="json", label="y", excluded=False)
    for k in (other, w):
        c.run_matching(k)
        assert members() == 2 * n
    c.workspace_delete(other)
    assert members() == n
    c.state_set("theme", "dark")
    c.state_set("theme", "light")
    assert c.state_get("theme") == "light" and c.state_get("theme", w) is None
    c.export_to(f"file://{tmp_path}/copy")
    new = c.import_merge(f"file://{tmp_path}/copy")
    assert [r.name for r in c.workspaces().collect()] == ["home", "home (imported 2)"] and new == [w + 1]
    nodes = c.read("nodes")
    assert nodes.count() == 12 and nodes.select("id").distinct().count() == 12
    assert nodes.where("parent_id IS NOT NULL").join(nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").isEmpty()
    assert c.read("match_members").join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").isEmpty()
    c.source_delete(b)
    assert [r.kind for r in c.read("match_groups").where(F.col("workspace_id") == w).collect()] == ["hardlink"]
    c.workspace_delete(w)
    assert [r.id for r in c.workspaces().collect()] == new


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    c.state_set("k", "1")
    broken = c.read("app_state").withColumn("value", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        c.write("app_state", broken)
    assert c.state_get("k") == "1"
    c.state_set("k", "2")
    assert Catalog(spark, f"file://{tmp_path}/cat").state_get("k") == "2"


def _scanned(spark, c, w, root, label, **facts):
    return c.source_add(w, scan.scan_folder(spark, str(root)), kind="scan", label=label, device_label=label, filesystem="ext4", excluded=False, orig_root_path=str(root), hash_min_size=1, hash_spec=None, volume_id="vol", **facts)


def test_digests_reach_matching(spark, tmp_path):
    roots = [tmp_path / n for n in ("drum", "harp")]
    for r in roots:
        os.makedirs(r / "takes")
        (r / f"takes/{r.name}.wav").write_bytes(b"tone" * 20_000)
        (r / f"{r.name}.txt").write_bytes(r.name.encode() * 9_000)
    os.link(roots[0] / "takes/drum.wav", roots[0] / "again.wav")
    c = Catalog(spark, f"file://{tmp_path}/cat")
    w = c.workspace_create("music")
    a, b = (_scanned(spark, c, w, r, r.name) for r in roots)
    assert c.read("nodes").where("inode_trusted").count() == c.read("nodes").count() == 7
    linked = c.read("match_groups").join(c.read("match_members").withColumnRenamed("group_id", "id"), "id").collect()
    assert len(linked) == 2 and {(r.kind, r.confidence, r.primary_signal, r.size) for r in linked} == {("hardlink", 100.0, "inode", 80_000)}
    assert c.state_get("dedup_stale", w) == "1"
    assert c.hash_source(a, cancelled=lambda: True) == {"hashed": 0, "cached": 0, "errors": 0, "cancelled": True}
    assert c.scan_progress(a) == ("hashing", 0)
    (roots[1] / "harp.txt").unlink()
    assert [c.hash_source(s) for s in (a, b)] == [{"hashed": 2, "cached": 0, "errors": 0, "cancelled": False}, {"hashed": 1, "cached": 0, "errors": 1, "cancelled": False}]
    assert c.scan_progress(a) == ("done", 2)
    assert {r.id: (r.hash_coverage_files, r.hash_coverage_bytes) for r in c.read("sources").collect()} == {a: (2, 116_000), b: (1, 80_000)}
    with pytest.raises(ValueError, match="another specification"):
        c.set_hash_spec(w, HashSpec(None) if c.hash_spec(w) != HashSpec(None) else HashSpec())
    phases = []
    c.run_matching(w, progress=lambda phase, done, all_: phases.append(phase))
    assert phases == ["loading", "matching", "folders", "writing", "done"] and c.state_get("dedup_stale", w) == "0"
    found = c.read("match_groups").where("kind = 'file'").collect()
    assert [(r.size, r.confidence) for r in found] == [(80_000, 100.0)]
    assert c.read("nodes").where("type = 'directory' AND listing_hash IS NOT NULL").count() == 2
    again = _scanned(spark, c, w, roots[0], "drum again")
    assert c.hash_source(again) == {"hashed": 0, "cached": 2, "errors": 0, "cancelled": False}
    copy = c.copy_source(a, c.workspace_create("other"))
    assert c.read("nodes").where(F.col("source_id") == copy).count() == 4
    assert c.state_get("dedup_stale", w + 1) == "1"


def test_consolidation_and_paths(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    w = c.workspace_create("plan")
    rows = [("kit", "directory", 0), ("kit/snare", "directory", 0), ("kit/snare/roll.wav", "file", 700), ("kit/tom.wav", "file", 300), ("kitten.wav", "file", 5)]
    nodes = spark.createDataFrame([(p, p.split("/")[-1], k, z, p.count("/")) for p, k, z in rows], "rel_path string, name string, type string, size long, depth int")
    c.source_add(w, nodes, kind="json", label="s", device_label="disk", excluded=False)
    ids = {r.rel_path: r.id for r in c.read("nodes").collect()}
    c.write("dup_annot", spark.createDataFrame([(ids["kit/snare"], True), (ids["kit/snare/roll.wav"], True)], "node_id long, cross_dup boolean"))
    plan, shown = c.consolidation_get(w)
    assert shown.isEmpty() and c.consolidation_get(w)[0] == plan
    top = c.consolidation_add_node(plan, None, "target", "directory")
    assert c.consolidation_add_node(plan, top, "notes", "directory") == top + 1
    new = c.consolidation_add_source_subtree(plan, top, ids["kit"], True)
    assert sorted(r.id for r in new.collect()) == [top + 2, top + 3, top + 4, top + 5]
    assert c.consolidation_add_source_subtree(plan, top, -1).isEmpty()
    rows = {r.name: r for r in c.consolidation_get(w)[1].collect()}
    assert rows["kit"].parent_id == top and rows["kit"].sort_order == 2 and rows["kit"].size is None
    assert (rows["roll.wav"].size, rows["roll.wav"].origin_device, rows["roll.wav"].origin_path, rows["roll.wav"].parent_id) == (700, "disk", "kit/snare/roll.wav", rows["snare"].id)
    assert {n for n, r in rows.items() if r.struck} == {"snare"}
    assert (rows["snare"].sort_order, rows["tom.wav"].sort_order) == (1, 2)
    paths = {r.path: (r.length, r.measured, r.over_limit) for r in c.path_tree(w, 15).collect()}
    assert paths == {"target": (6, False, True), "target\\notes": (12, True, False), "target\\kit": (10, False, True), "target\\kit\\tom.wav": (18, True, True), "target\\kit\\snare": (16, False, False), "target\\kit\\snare\\roll.wav": (25, False, False)}
    tom = rows["tom.wav"].id
    assert c.path_rename(w, tom, "t") == ("t", "tom.wav") and c.path_rename(w, tom, "tt") == ("tt", "tom.wav")
    assert {r.name: r.original_name for r in c.consolidation_get(w)[1].collect()}["tt"] == "tom.wav"
    assert c.path_tree(w, 15).where("over_limit").isEmpty()
    assert c.path_rename(w, tom, "") == ("tom.wav", None) and c.read("pathfix_state").isEmpty()
    with pytest.raises(ValueError, match="into itself"):
        c.consolidation_move_node(rows["kit"].id, rows["snare"].id, 1)
    c.consolidation_move_node(tom, top + 1, 1)
    c.consolidation_set_done([tom], True)
    c.consolidation_set_struck([top + 1], True)
    moved = {r.name: (r.parent_id, r.done, r.struck) for r in c.consolidation_get(w)[1].collect()}
    assert moved["tom.wav"] == (top + 1, True, False) and moved["notes"] == (top, False, True)
    c.consolidation_delete_nodes([rows["kit"].id])
    assert {r.name for r in c.consolidation_get(w)[1].collect()} == {"target", "notes", "tom.wav"}
