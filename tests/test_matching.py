import itertools
import random
import time

from pyspark.sql import functions as F

from treeledger.functions.scalars import node_key, parent_path
from treeledger.operators import matching, plan_tree, rollup, tree

SHAPE = "source_id long, rel_path string, type string, size long, mtime string, content_hash string, hash_kind string, hash_spec string, link_target string, dev long, inode long, inode_high long"
T = "2020-01-01_10:00:0"


def nodes(spark, rows, alias=None):
    """Rows of (source, path, size, mtime, digest); directories are added."""
    full = [(r[0], r[1], "file", r[2], r[3], r[4] if len(r) > 4 else None, "full" if len(r) > 4 and r[4] else None, "s" if len(r) > 4 and r[4] else None, None, None, None, None) for r in rows]
    dirs = {(r[0], "/".join(r[1].split("/")[:k])) for r in rows for k in range(1, r[1].count("/") + 1)}
    full += [(a, p, "directory", 0, None, None, None, None, None, None, None, None) for a, p in sorted(dirs)]
    df = spark.createDataFrame(full, SHAPE).withColumn("node_id", node_key(F.col("source_id"), F.col("rel_path"))).withColumn("name", F.regexp_extract("rel_path", "([^/]*)$", 1))
    up = parent_path(F.col("rel_path"))
    return df.withColumns({"parent_id": F.when(up != "", node_key(F.col("source_id"), up)), "alias_of": F.lit(None).cast("long")})


def grouped(spark, rows, **params):
    n = nodes(spark, rows)
    groups, skipped = matching.match(spark, n, matching.MatchParams(**params))
    paths = {r.node_id: (r.source_id, r.rel_path) for r in n.collect()}
    found = {}
    for r in groups.collect():
        found.setdefault((r.confidence, r.group_key), set()).add(paths[r.node_id])
    return sorted((c, sorted(m)) for (c, _), m in found.items()), sorted(paths[r.node_id] for r in skipped.collect())


def test_hash_and_name_tiers(spark):
    found, skipped = grouped(spark, [(1, "a/x.jpg", 500_000, T + "0", "h"), (2, "b/y.jpg", 500_000, None, "h"), (1, "a/n.jpg", 70_000, T + "0"), (2, "b/n.jpg", 70_000, T + "2"), (1, "a/d.jpg", 80_000, T + "0"), (2, "b/d.jpg", 80_000, T + "5")])
    assert found == [(55.0, [(1, "a/d.jpg"), (2, "b/d.jpg")]), (70.0, [(1, "a/n.jpg"), (2, "b/n.jpg")]), (100.0, [(1, "a/x.jpg"), (2, "b/y.jpg")])] and skipped == []


def test_conflict_declines_and_redundant_vanishes(spark):
    found, skipped = grouped(spark, [(1, "a/x.jpg", 70_000, T + "0", "h"), (2, "b/x.jpg", 70_000, T + "0", "g")])
    assert found == [] and len(skipped) == 2
    found, skipped = grouped(spark, [(1, "a/x.jpg", 70_000, T + "0", "h"), (2, "b/x.jpg", 70_000, T + "0", "h")])
    assert [c for c, _ in found] == [100.0] and skipped == []


def test_clique_chain(spark):
    found, _ = grouped(spark, [(1, "north/twin.tif", 500_000, T + "0"), (2, "south/twin.tif", 500_000, T + "1"), (3, "south/odd.tif", 500_000, "2020-01-01_13:00:01")])
    assert [c for c, _ in found] == [45.0, 70.0]


def test_caps_skip_whole_groups(spark):
    found, skipped = grouped(spark, [(1, f"d{i}/stamp.dat", 500_000, None) for i in range(35)])
    assert found == [] and len(skipped) == 35
    found, skipped = grouped(spark, [(1, f"ROLL/scan{i}.tif", 98_304, T + "0") for i in range(320)])
    assert found == [] and len(skipped) == 320


def test_cliques_of_dense_clusters_are_counted_without_listing_them():
    """Files without digests that match each other and, each by itself, every file with one: 2^u * (h + 1) cliques, of which h are maximal."""
    began = time.process_time()
    for u, h in ((10, 20), (13, 23), (13, 24), (15, 30), (40, 60), (150, 150)):
        for shift in range(10):
            edges = [(a + shift, b + shift) for a, b in itertools.combinations(range(u + h), 2) if a < u]
            count = 2**u * (h + 1)
            found = matching.cliques(edges, 3, 200_000)
            if count + 3 > 200_000:
                assert found is None
            else:
                assert sorted(found) == [[*range(shift, u + shift), u + k + shift] for k in range(h)]
                assert matching.cliques(edges, 3, count + 3) is not None and matching.cliques(edges, 3, count + 2) is None
    assert time.process_time() - began < 10


def test_cliques_against_brute_force():
    r = random.Random(3)
    for _ in range(150):
        n = r.randint(2, 8)
        edges = [(a, b) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]
        near = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
        every = [c for k in range(1, n + 1) for c in itertools.combinations(range(n), k) if all((a, b) in near for a, b in itertools.combinations(c, 2))]
        want = sorted(c for c in every if len(c) > 1 and not any(set(c) < set(d) for d in every))
        alone = n - len({v for e in edges for v in e})
        assert sorted(tuple(sorted(c)) for c in matching.cliques(edges, alone, 10**6)) == want
        assert matching.cliques(edges, alone, len(every) + 1) is not None
        assert not edges or matching.cliques(edges, alone, len(every)) is None


def test_folder_confidence(spark):
    n = nodes(spark, [(s, f"{r}/trip/{f}", z, None) for s, r in ((1, "p"), (2, "q")) for f, z in (("big.raw", 900), ("small.jpg", 100))])
    cross = n.where("type = 'file'").select("node_id", F.when(F.col("name") == "big.raw", 100.0).otherwise(45.0).alias("confidence"))
    found = rollup.overlap_folders(n, cross).collect()
    assert not found  # p and q qualify too and are above, and their names differ
    n = nodes(spark, [(s, f"trip/{f}", z, None) for s in (1, 2) for f, z in (("big.raw", 900), ("small.jpg", 100))])
    cross = n.where("type = 'file'").select("node_id", F.when(F.col("name") == "big.raw", 100.0).otherwise(45.0).alias("confidence"))
    assert {(round(r.confidence, 6), r.size) for r in rollup.overlap_folders(n, cross).collect()} == {(94.5, 1000)}


def test_listing_finds_renamed_folders(spark):
    n = nodes(spark, [(s, f"{d}/in/{f}", 200, T + "0") for s, d in ((1, "old"), (2, "new")) for f in ("a", "b")])
    h = rollup.listing_hashes(spark, n)
    assert len({r.listing_hash for r in h.collect()}) == 2
    assert rollup.listing_folders(n, h, 400).count() == 2 and rollup.listing_folders(n, h, 401).count() == 0


def test_closures_agree_and_sums_hold(spark):
    n = nodes(spark, [(1, "a/b/c/f", 5, None), (1, "a/b/g", 7, None), (2, "h", 1, None)])
    a = {tuple(r) for r in tree.closure_by_path(n).collect()}
    assert a == {tuple(r) for r in tree.closure_by_parent(spark, n).select("node_id", "ancestor_id", "distance").collect()}
    totals = {r.rel_path: (r.subtree_size, r.subtree_file_count) for r in tree.subtree_totals(n).join(n, "node_id").collect()}
    assert totals["a"] == (12, 2) and totals["a/b/c"] == (5, 1) and totals["h"] == (1, 1)


def test_path_lengths_and_renames(spark):
    rows = spark.createDataFrame([(1, None, "root", "directory", False), (2, 1, "long-folder-name", "directory", False), (3, 2, "file.txt", "file", False), (4, 2, "struck.txt", "file", True)], "id long, parent_id long, name string, type string, struck boolean")
    none = spark.createDataFrame([], "workspace_id long, kind string, ref_id long, new_name string, original_name string")
    over = {r.id for r in plan_tree.path_lengths(spark, rows, none, limit=29).where("over_limit").collect()}
    assert over == {1, 2, 3}
    renamed = plan_tree.rename(none, 1, "cons", 2, "long-folder-name", "x")
    assert not plan_tree.path_lengths(spark, rows, renamed, limit=29).where("over_limit").collect()
    assert plan_tree.rename(renamed, 1, "cons", 2, "x", "long-folder-name").isEmpty()
