"""Registered queries of the catalogue and the DuckDB statement each is checked against.

Every query runs over whole derived corpora (see corpora.py). Match caps are production values, but for `m6_skipped`,
which lowers them so that the rule shows on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions import scalars as s
from treeledger.operators import browse, matching, plan_tree, rollup, tree
from treeledger.plans import corpora
from treeledger.plans.corpora import DOCS_SQL, SHELF_SQL
from treeledger.scratch import materialize

QUERIES = {}
ORACLE_SQL = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(spark, corpora.shelf(spark, sf_dir), "shelf")


def _matched(spark: SparkSession, nodes: DataFrame, p: matching.MatchParams = matching.MatchParams()):
    groups, skipped = matching.match(spark, nodes, p)
    return groups, skipped, materialize(spark, rollup.cross_source(groups, nodes), "cross")


# Scalars


@query("f1_ext", "SELECT DISTINCT p_name AS name, lower(regexp_extract(p_name, '^(?s:.+)\\.([^.]*)$', 1)) AS ext FROM (SELECT url AS p_name FROM pages UNION SELECT '.bashrc' UNION SELECT 'a.' UNION SELECT 'a.B.Txt' UNION SELECT 'none')")
def f1_ext(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("name")).union(spark.createDataFrame([(".bashrc",), ("a.",), ("a.B.Txt",), ("none",)], "name string")).distinct()
    return names.select("name", s.ext(F.col("name")).alias("ext"))


_TIMES = """
    t AS (SELECT o_orderkey AS k, strftime(o_orderdate + to_seconds(o_orderkey % 5), '%Y-%m-%d_%H:%M:%S') AS a,
        CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'junk' ELSE strftime(o_orderdate + to_hours(o_orderkey % 17), '%Y-%m-%d_%H:%M:%S') END AS b FROM orders),
    p AS (SELECT *, epoch(try_strptime(a, '%Y-%m-%d_%H:%M:%S'))::BIGINT AS sa, epoch(try_strptime(b, '%Y-%m-%d_%H:%M:%S'))::BIGINT AS sb FROM t)"""


def _times(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    stamp = lambda ts: F.date_format(ts, "yyyy-MM-dd_HH:mm:ss")
    a = stamp(day + F.make_dt_interval(secs=(key % 5).cast("decimal(18,6)")))
    b = F.when(key % 7 == 0, F.lit(None)).when(key % 7 == 1, "junk").otherwise(stamp(day + F.make_dt_interval(hours=(key % 17).cast("int"))))
    return o.select(key.alias("k"), a.alias("a"), b.alias("b"))


@query("f3_mtime_match", f"""WITH {_TIMES} SELECT k, CASE WHEN a = b OR abs(sa - sb) <= 2 THEN 'strong' WHEN abs(sa - sb) > 0 AND abs(sa - sb) % 3600 = 0 AND abs(sa - sb) <= 50400 THEN 'moderate' END AS match FROM p""")
def f3_mtime_match(spark, sf_dir):
    return _times(spark, sf_dir).select("k", s.mtime_match(F.col("a"), F.col("b")).alias("match"))


@query("f4_mtime_norm", f"""WITH {_TIMES} SELECT k, CASE WHEN b IS NULL THEN -9223372036854775808 WHEN sb IS NULL THEN -9223372036854775807 ELSE sb - (sb % 2 + 2) % 2 END AS norm, sb AS seconds FROM p""")
def f4_mtime_norm(spark, sf_dir):
    return _times(spark, sf_dir).select("k", s.mtime_norm(F.col("b")).alias("norm"), s.mtime_seconds(F.col("b")).alias("seconds"))


@query("f5_search_match", """SELECT doc_id, contains(lower(text), 'éa') AS folded, contains(text, 'Th') AS exact,
    regexp_matches(lower(text), '(?s)th.*on.e') AS glob, regexp_matches(text, '(?s)T.e ') AS glob_exact FROM documents""")
def f5_search_match(spark, sf_dir):
    name = F.col("text")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", s.search_match(name, "éA").alias("folded"), s.search_match(name, "Th", True).alias("exact"), s.search_match(name, "th*on?e").alias("glob"), s.search_match(name, "T?e ", True).alias("glob_exact"))


@query("f_labels", SHELF_SQL + """SELECT node_id, CASE WHEN size < 65536 THEN 'full' ELSE 'sampled' END AS kind, CASE WHEN type = 'directory' THEN 'directory' ELSE 'file' END AS norm_type,
    coalesce(dev::VARCHAR, NULL) AS volume, CASE WHEN size < 1 THEN '00. empty' WHEN size < 1024 THEN '01. <1K' WHEN size < 4096 THEN '02. 1K-4K' WHEN size < 16384 THEN '03. 4K-16K'
    WHEN size < 65536 THEN '04. 16K-64K' ELSE '05. 64K-256K' END AS bucket, CASE WHEN size < 1024 THEN size || ' B' WHEN size >= 10240 THEN floor(size / 1024.0 + 0.5)::BIGINT || ' KB' ELSE printf('%.1f', floor(size / 1024.0 * 10 + 0.5) / 10) || ' KB' END AS human,
    source_id % 8 AS color, depth FROM nodes""")
def f_labels(spark, sf_dir):
    size = F.col("size")
    return corpora.shelf(spark, sf_dir).select("node_id", s.hash_kind_for(size, 65536).alias("kind"), s.normalize_type(F.col("type")).alias("norm_type"), s.cache_volume_id(F.lit(""), F.col("dev")).alias("volume"), s.size_bucket(size).alias("bucket"), s.format_bytes(size).alias("human"), s.source_color(F.col("source_id")).alias("color"), F.col("depth").cast("long").alias("depth"))


@query("f17_tiers", """SELECT l_orderkey, l_linenumber, l_quantity * 2 AS c, CASE WHEN c >= 100 THEN 'A' WHEN c >= 99 THEN 'B' WHEN c >= 70 THEN 'C' WHEN c >= 55 THEN 'D' WHEN c >= 45 THEN 'E' END AS tier,
    CASE WHEN c >= 95 THEN 'strong' WHEN c >= 75 THEN 'medium' ELSE 'weak' END AS tone, floor(greatest(0, least(100, c / 3.0)) * 100 + 0.5) / 100 AS pct2 FROM lineitem""")
def f17_tiers(spark, sf_dir):
    c = F.col("l_quantity") * 2
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", c.alias("c"), s.match_tier(c).alias("tier"), s.confidence_tone(c).alias("tone"), s.pct(c / 3.0, 2).alias("pct2"))


# Trees and totals


@query("c_closure", SHELF_SQL + "SELECT node_id, ancestor_id, distance FROM closure")
def c_closure(spark, sf_dir):
    return tree.closure_by_path(corpora.shelf(spark, sf_dir)).withColumn("distance", F.col("distance").cast("long"))


@query("c_closure_by_parent", SHELF_SQL + f"""SELECT node_id, {corpora._key("source_id", "array_to_string(list_slice(string_split(rel_path, '/'), 1, n.n), '/')")} AS ancestor_id, depth + 1 - n.n AS distance
    FROM nodes, (SELECT unnest(range(1, 10)) AS n) n WHERE n.n <= depth""")
def c_closure_by_parent(spark, sf_dir):
    return tree.closure_by_parent(spark, _shelf(spark, sf_dir)).withColumn("distance", F.col("distance").cast("long"))


@query("p1_live", SHELF_SQL + "SELECT node_id FROM nodes WHERE source_id <> 3")
def p1_live(spark, sf_dir):
    return tree.live(corpora.shelf(spark, sf_dir), corpora.sources(spark, (3,))).select("node_id")


@query("p2_candidates", SHELF_SQL + "SELECT node_id, lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) AS ext, regexp_extract(parent_path, '[^/]*$') AS parent_name FROM nodes WHERE type IN ('file', 'link') AND alias_of IS NULL")
def p2_candidates(spark, sf_dir):
    return matching.candidates(corpora.shelf(spark, sf_dir)).select("node_id", "ext", "parent_name")


@query("p3_hash_candidates", SHELF_SQL + "SELECT node_id, size FROM nodes WHERE type = 'file' AND alias_of IS NULL AND size >= 65536 AND size > 0 AND content_hash IS NULL")
def p3_hash_candidates(spark, sf_dir):
    from treeledger.operators.hashing import hash_candidates

    return hash_candidates(corpora.shelf(spark, sf_dir), 65536).select("node_id", "size")


@query("a1_size_histogram", SHELF_SQL + """, b AS (SELECT source_id, CASE WHEN size < 4096 THEN '02. 1K-4K' WHEN size < 16384 THEN '03. 4K-16K' WHEN size < 65536 THEN '04. 16K-64K' ELSE '05. 64K-256K' END AS bucket, size FROM nodes WHERE type = 'file' AND alias_of IS NULL)
    SELECT source_id, bucket, count(*) AS files, sum(size)::BIGINT AS bytes, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY source_id), 6) AS pct_files, round(sum(size) * 100.0 / sum(sum(size)) OVER (PARTITION BY source_id), 6) AS pct_bytes FROM b GROUP BY source_id, bucket""")
def a1_size_histogram(spark, sf_dir):
    out = rollup.size_histogram(corpora.shelf(spark, sf_dir), s.size_bucket(F.col("size")))
    return out.withColumns({c: F.round(c, 6) for c in ("pct_files", "pct_bytes")})


@query("a2_threshold_preview", SHELF_SQL + "SELECT source_id, count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (size >= 65536) AS hashed_files, coalesce(sum(size) FILTER (size >= 65536), 0)::BIGINT AS hashed_bytes FROM nodes WHERE type = 'file' AND alias_of IS NULL GROUP BY source_id")
def a2_threshold_preview(spark, sf_dir):
    return rollup.threshold_preview(corpora.shelf(spark, sf_dir), 65536)


@query("a3_hardlinks", SHELF_SQL + "SELECT node_id, coalesce(alias_of, node_id) AS canonical_id, count(*) OVER (PARTITION BY coalesce(alias_of, node_id)) AS set_size FROM nodes n WHERE alias_of IS NOT NULL OR EXISTS (SELECT 1 FROM nodes a WHERE a.alias_of = n.node_id)")
def a3_hardlinks(spark, sf_dir):
    return tree.hardlinks(corpora.shelf(spark, sf_dir), corpora.sources(spark))


@query("a4_subtree_totals", SHELF_SQL + """SELECT n.node_id, CASE WHEN n.type = 'file' THEN n.size WHEN n.type = 'link' THEN 0 ELSE coalesce(t.size, 0) END AS subtree_size, CASE WHEN n.type <> 'directory' THEN 1 ELSE coalesce(t.names, 0) END AS subtree_file_count
    FROM nodes n LEFT JOIN (SELECT ancestor_id, sum(CASE WHEN type = 'file' AND alias_of IS NULL THEN size ELSE 0 END)::BIGINT AS size, count(*) AS names FROM nodes JOIN closure USING (node_id) WHERE type <> 'directory' GROUP BY ancestor_id) t ON t.ancestor_id = n.node_id""")
def a4_subtree_totals(spark, sf_dir):
    return tree.subtree_totals(corpora.shelf(spark, sf_dir))


@query("a5_source_totals", SHELF_SQL + "SELECT source_id, sum(size) FILTER (type = 'file')::BIGINT AS total_size, count(*) FILTER (type <> 'directory') AS file_count, coalesce(sum(size) FILTER (alias_of IS NOT NULL), 0)::BIGINT AS alias_bytes, (sum(size) FILTER (type = 'file') - coalesce(sum(size) FILTER (alias_of IS NOT NULL), 0))::BIGINT AS physical_size FROM nodes GROUP BY source_id")
def a5_source_totals(spark, sf_dir):
    return tree.source_totals(corpora.shelf(spark, sf_dir))


# Matching

_FILES = """,
    cand AS (
        SELECT node_id, source_id, type, name, size, mtime, content_hash, hash_kind, hash_spec, link_target, lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) AS ext,
               lower(regexp_extract(parent_path, '[^/]*$')) AS parent, epoch(try_strptime(mtime, '%Y-%m-%d_%H:%M:%S'))::BIGINT AS secs
        FROM nodes WHERE type IN ('file', 'link') AND alias_of IS NULL),
    hg AS (
        SELECT size, hash_spec, content_hash, bool_and(hash_kind = 'full') AS a FROM cand WHERE type = 'file' AND content_hash IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
    hm AS (
        SELECT 'hash|' || size || '|' || hash_spec || '|' || content_hash AS group_key, CASE WHEN a THEN 'hash-full' ELSE 'hash-sampled' END AS signal,
               CASE WHEN a THEN 100.0 ELSE 99.0 END AS confidence, size, node_id FROM cand JOIN hg USING (size, hash_spec, content_hash)),
    lm AS (
        SELECT 'link|' || name || '|' || link_target AS group_key, 'symlink-target' AS signal, 100.0 AS confidence, size, node_id
        FROM cand WHERE type = 'link' AND size >= 65536 QUALIFY count(*) OVER (PARTITION BY name, link_target) > 1),
    pool AS (
        SELECT c.*, hm.group_key AS hash_group, count(*) OVER (PARTITION BY c.size, c.ext) AS cohort FROM cand c LEFT JOIN hm USING (node_id) WHERE c.type = 'file' AND c.size >= 65536),
    ng AS (
        SELECT size, ext, name, count(*) AS n,
               bool_or(conflict) AS conflict, count(mtime) = n AND (min(mtime) = max(mtime) OR (count(secs) = n AND max(secs) - min(secs) <= 2)) AS strong,
               count(hash_group) = n AND count(DISTINCT hash_group) = 1 AS redundant
        FROM (SELECT *, hash_spec IS NOT NULL AND min(content_hash) OVER w <> max(content_hash) OVER w AS conflict FROM pool WHERE cohort BETWEEN 2 AND {cohort}
              WINDOW w AS (PARTITION BY size, ext, name, hash_spec))
        GROUP BY size, ext, name HAVING n > 1),
    nm AS (
        SELECT 'name|' || p.size || '|' || p.name AS group_key, CASE WHEN strong THEN 'name+mtime' ELSE 'name' END AS signal, CASE WHEN strong THEN 70.0 ELSE 55.0 END AS confidence, p.size, node_id
        FROM pool p JOIN ng USING (size, ext, name) WHERE n <= {name} AND NOT coalesce(conflict, false) AND NOT redundant),
    cl AS (SELECT *, count(*) OVER (PARTITION BY size, ext, parent) AS cluster FROM pool WHERE cohort BETWEEN 2 AND {cohort} AND parent <> '' AND size <> 0),
    e AS (
        SELECT a.size, a.node_id AS a, b.node_id AS b FROM cl a JOIN cl b ON a.size = b.size AND a.ext = b.ext AND a.parent = b.parent AND a.node_id < b.node_id AND a.name <> b.name
        WHERE a.cluster <= {cluster} AND NOT coalesce(a.hash_spec = b.hash_spec AND a.content_hash <> b.content_hash, false)
          AND (a.mtime = b.mtime OR abs(a.secs - b.secs) <= 2 OR (abs(a.secs - b.secs) % 3600 = 0 AND abs(a.secs - b.secs) <= 50400))),
    nb AS (SELECT a AS id, list(b) AS ns, any_value(size) AS size FROM (SELECT size, a, b FROM e UNION ALL SELECT size, b, a FROM e) GROUP BY a),
    k AS (
        SELECT [id] AS members, ns AS cand, id AS last, size FROM nb
        UNION ALL SELECT list_append(k.members, n.id), list_intersect(k.cand, n.ns), n.id, k.size FROM k, unnest(k.cand) u(x) JOIN nb n ON n.id = u.x WHERE u.x > k.last),
    ck AS (SELECT 'clique|' || array_to_string(list_sort(members), ',') AS group_key, size, unnest(members) AS node_id FROM k WHERE len(cand) = 0 AND len(members) >= 2),
    em AS (
        SELECT ck.group_key, 'parent+mtime' AS signal, 45.0 AS confidence, ck.size, ck.node_id FROM ck LEFT JOIN hm ON hm.node_id = ck.node_id
        WINDOW g AS (PARTITION BY ck.group_key) QUALIFY NOT (count(hm.group_key) OVER g = count(*) OVER g AND min(hm.group_key) OVER g = max(hm.group_key) OVER g) OR count(hm.group_key) OVER g = 0),
    members AS (SELECT * FROM hm UNION ALL SELECT * FROM lm UNION ALL SELECT * FROM nm UNION ALL SELECT * FROM em)
"""


def _match_sql(cohort: int = 2000, name: int = 32, cluster: int = 300) -> str:
    return SHELF_SQL + _FILES.replace("{cohort}", str(cohort)).replace("{name}", str(name)).replace("{cluster}", str(cluster))


MATCH_SQL = _match_sql()
_MEMBER = "SELECT group_key, signal, confidence::DOUBLE AS confidence, size, node_id FROM "


@query("m1_hash_groups", MATCH_SQL + _MEMBER + "hm")
def m1_hash_groups(spark, sf_dir):
    return matching.hash_groups(matching.candidates(corpora.shelf(spark, sf_dir))).drop("kind")


@query("m1_text_copies", DOCS_SQL + "SELECT content_hash, size, node_id, source_id FROM nodes WHERE type = 'file' QUALIFY count(*) OVER (PARTITION BY size, content_hash) > 1")
def m1_text_copies(spark, sf_dir):
    nodes = corpora.docs(spark, sf_dir)
    found = matching.hash_groups(matching.candidates(nodes)).select("node_id")
    return nodes.join(found, "node_id", "left_semi").select("content_hash", "size", "node_id", "source_id")


@query("m2_symlink_groups", MATCH_SQL + _MEMBER + "lm")
def m2_symlink_groups(spark, sf_dir):
    return matching.symlink_groups(matching.candidates(corpora.shelf(spark, sf_dir)), matching.MatchParams()).drop("kind")


def _tiers(spark, sf_dir, p):
    files = materialize(spark, matching.candidates(corpora.shelf(spark, sf_dir)), "candidates")
    return materialize(spark, matching._pool(files, matching.hash_groups(files), p), "pool")


@query("m3_name_groups", MATCH_SQL + _MEMBER + "nm")
def m3_name_groups(spark, sf_dir):
    p = matching.MatchParams()
    return matching.name_groups(_tiers(spark, sf_dir, p), p)[0].drop("kind")


@query("m4_clique_edges", MATCH_SQL + "SELECT size, a, b FROM e")
def m4_clique_edges(spark, sf_dir):
    p = matching.MatchParams()
    return matching.clique_edges(_tiers(spark, sf_dir, p), p)[1].select("size", "a", "b")


@query("m4_clique_groups", MATCH_SQL + _MEMBER + "em")
def m4_clique_groups(spark, sf_dir):
    p = matching.MatchParams()
    return matching.clique_groups(_tiers(spark, sf_dir, p), p)[0].drop("kind")


@query("m5_all_groups", MATCH_SQL + _MEMBER + "members WHERE confidence >= 40")
def m5_all_groups(spark, sf_dir):
    return matching.match(spark, corpora.shelf(spark, sf_dir))[0].drop("kind")


@query("m6_skipped", _match_sql(60, 5, 6) + """, declined AS (
        SELECT node_id FROM pool WHERE cohort > 60 UNION SELECT p.node_id FROM pool p JOIN ng USING (size, ext, name) WHERE p.cohort BETWEEN 2 AND 60 AND (n > 5 OR conflict)
        UNION SELECT node_id FROM cl WHERE cluster > 6)
    SELECT node_id FROM declined WHERE node_id NOT IN (SELECT node_id FROM members)""")
def m6_skipped(spark, sf_dir):
    return matching.match(spark, corpora.shelf(spark, sf_dir), matching.MatchParams(cohort_cap=60, name_cap=5, cluster_cap=6))[1]


# Rollups

_CROSS = """,
    gx AS (SELECT group_key FROM members JOIN nodes USING (node_id) GROUP BY group_key HAVING count(DISTINCT source_id) > 1),
    own AS (SELECT node_id, max(confidence)::DOUBLE AS confidence FROM members JOIN gx USING (group_key) GROUP BY node_id),
    crossed AS (SELECT * FROM own UNION ALL SELECT n.node_id, own.confidence FROM nodes n JOIN own ON own.node_id = n.alias_of),
    dirsum AS (
        SELECT source_id, ancestor_id, sum(size) FILTER (canon)::BIGINT AS total, coalesce(sum(size) FILTER (canon AND confidence IS NOT NULL), 0)::BIGINT AS dup, coalesce(sum(size * confidence) FILTER (canon), 0) AS weighted,
               count(*) AS names, count(confidence) AS cross_names
        FROM (SELECT n.*, c.confidence, n.type = 'file' AND n.alias_of IS NULL AS canon FROM nodes n LEFT JOIN crossed c USING (node_id) WHERE n.type <> 'directory') JOIN closure USING (node_id) GROUP BY source_id, ancestor_id),
    fq AS (SELECT d.*, n.parent_id, lower(n.name) AS name FROM dirsum d JOIN nodes n ON n.node_id = d.ancestor_id WHERE total > 0 AND dup >= 0.8 * total),
    ft AS (SELECT * FROM fq WHERE parent_id IS NULL OR parent_id NOT IN (SELECT ancestor_id FROM fq)),
    folder AS (
        SELECT 'folder|' || name AS group_key, sum(weighted) OVER w / sum(dup) OVER w AS confidence, max(total) OVER w AS size, ancestor_id AS node_id FROM ft
        WINDOW w AS (PARTITION BY name) QUALIFY min(source_id) OVER w <> max(source_id) OVER w)
"""
CROSS_SQL = MATCH_SQL + _CROSS


@query("a6_cross_source", CROSS_SQL + "SELECT node_id, confidence FROM crossed")
def a6_cross_source(spark, sf_dir):
    return _matched(spark, _shelf(spark, sf_dir))[2]


@query("a7_overlap_folders", CROSS_SQL.replace("0.8 * total", "0.35 * total") + "SELECT group_key, round(confidence, 6)::DOUBLE AS confidence, size, node_id FROM folder")
def a7_overlap_folders(spark, sf_dir):
    nodes = _shelf(spark, sf_dir)
    # On this corpus few folders reach the usual share of 0.8.
    return rollup.overlap_folders(nodes, _matched(spark, nodes)[2], 0.35).select("group_key", F.round("confidence", 6).alias("confidence"), "size", "node_id")


#: Every file also under a second root on the next source, with months of odd numbers renamed, so that folders repeat across sources.
_MIRROR = SHELF_SQL.replace("leaves AS (", "leaves0 AS (", 1).replace("    dirs AS (", """    leaves AS (SELECT * FROM leaves0 UNION ALL SELECT source_id % 4 + 1, 'mirror/' || regexp_replace(rel_path, '/m([13579])/', '/moved\\1/'), * EXCLUDE (source_id, rel_path) FROM leaves0),
    dirs AS (""", 1)


def _mirror(spark, sf_dir):
    base = corpora.shelf(spark, sf_dir).where("type <> 'directory'").select("source_id", "rel_path", "name", "type", "size", "mtime", "content_hash", "hash_kind", "hash_spec", "link_target", "dev", "inode", "inode_high")
    moved = F.concat(F.lit("mirror/"), F.regexp_replace("rel_path", "/m([13579])/", "/moved$1/"))
    return materialize(spark, corpora._with_directories(base.unionByName(base.withColumns({"source_id": F.col("source_id") % 4 + 1, "rel_path": moved})), corpora.sources(spark)), "mirror")


_LISTING = _MIRROR + """,
    line AS (SELECT parent_id, CASE WHEN type = 'file' THEN concat_ws(chr(31), 'file', name, size, epoch(strptime(mtime, '%Y-%m-%d_%H:%M:%S'))::BIGINT // 2 * 2) ELSE concat_ws(chr(31), 'link', name, link_target) END AS t FROM nodes WHERE type <> 'directory' AND alias_of IS NULL),
    l3 AS (SELECT d.node_id, d.parent_id, d.name, coalesce(sha256(string_agg(t, chr(30) ORDER BY t)), '') AS h FROM nodes d LEFT JOIN line ON line.parent_id = d.node_id WHERE d.type = 'directory' AND d.depth = 3 GROUP BY ALL),
    e2 AS (SELECT parent_id, t FROM line UNION ALL SELECT parent_id, concat_ws(chr(31), 'dir', name, h) FROM l3),
    l2 AS (SELECT d.node_id, d.parent_id, d.name, coalesce(sha256(string_agg(t, chr(30) ORDER BY t)), '') AS h FROM nodes d LEFT JOIN e2 ON e2.parent_id = d.node_id WHERE d.type = 'directory' AND d.depth = 2 GROUP BY ALL),
    e1 AS (SELECT parent_id, t FROM line UNION ALL SELECT parent_id, concat_ws(chr(31), 'dir', name, h) FROM l2),
    l1 AS (SELECT d.node_id, d.parent_id, d.name, coalesce(sha256(string_agg(t, chr(30) ORDER BY t)), '') AS h FROM nodes d LEFT JOIN e1 ON e1.parent_id = d.node_id WHERE d.type = 'directory' AND d.depth = 1 GROUP BY ALL),
    e0 AS (SELECT parent_id, t FROM line UNION ALL SELECT parent_id, concat_ws(chr(31), 'dir', name, h) FROM l1),
    l0 AS (SELECT d.node_id, d.parent_id, d.name, coalesce(sha256(string_agg(t, chr(30) ORDER BY t)), '') AS h FROM nodes d LEFT JOIN e0 ON e0.parent_id = d.node_id WHERE d.type = 'directory' AND d.depth = 0 GROUP BY ALL),
    prints AS (SELECT node_id, parent_id, h FROM l0 UNION ALL SELECT node_id, parent_id, h FROM l1 UNION ALL SELECT node_id, parent_id, h FROM l2 UNION ALL SELECT node_id, parent_id, h FROM l3),
    sums AS (SELECT ancestor_id, source_id, count(*) AS names, sum(CASE WHEN type = 'file' THEN size ELSE 0 END)::BIGINT AS bytes FROM nodes JOIN closure USING (node_id) WHERE type <> 'directory' AND alias_of IS NULL GROUP BY ALL),
    seeds AS (SELECT p.*, s.source_id, s.bytes FROM prints p JOIN sums s ON s.ancestor_id = p.node_id WHERE names >= 2 AND bytes >= 65536),
    clustered AS (SELECT * FROM seeds QUALIFY min(source_id) OVER (PARTITION BY h) <> max(source_id) OVER (PARTITION BY h)),
    topmost AS (SELECT * FROM clustered WHERE parent_id IS NULL OR parent_id NOT IN (SELECT node_id FROM clustered)),
    listed AS (SELECT h, node_id, min(node_id) OVER (PARTITION BY h) AS group_first, max(bytes) OVER (PARTITION BY h) AS size FROM topmost QUALIFY min(source_id) OVER (PARTITION BY h) <> max(source_id) OVER (PARTITION BY h))
"""


@query("a8_listing_classes", _LISTING + "SELECT node_id, min(node_id) OVER (PARTITION BY h) AS class FROM prints")
def a8_listing_classes(spark, sf_dir):
    h = rollup.listing_hashes(spark, _mirror(spark, sf_dir)).select("listing_hash", s.node_key(F.col("source_id"), F.col("dir_path")).alias("node_id"))
    return h.join(h.groupBy("listing_hash").agg(F.min("node_id").alias("class")), "listing_hash").select("node_id", "class")


@query("a8_listing_folders", _LISTING + "SELECT group_first, size, node_id FROM listed")
def a8_listing_folders(spark, sf_dir):
    nodes = _mirror(spark, sf_dir)
    found = rollup.listing_folders(nodes, rollup.listing_hashes(spark, nodes))
    return found.join(found.groupBy("group_key").agg(F.min("node_id").alias("group_first")), "group_key").select("group_first", "size", "node_id")


@query("a9_duplicated_bytes", CROSS_SQL + """,
    mm AS (SELECT group_key, node_id, source_id, CASE WHEN type = 'file' THEN nodes.size ELSE 0 END AS bytes FROM members JOIN nodes USING (node_id)),
    su AS (SELECT *, min(source_id) OVER g <> max(source_id) OVER g AS spans FROM mm WINDOW g AS (PARTITION BY group_key) QUALIFY spans OR node_id <> min(node_id) OVER g),
    once AS (SELECT * FROM su QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY group_key) = 1)
    SELECT source_id, sum(CASE WHEN spans THEN 0 ELSE bytes END)::BIGINT AS internal, sum(CASE WHEN spans THEN bytes ELSE 0 END)::BIGINT AS "cross" FROM once GROUP BY source_id""")
def a9_duplicated_bytes(spark, sf_dir):
    nodes = _shelf(spark, sf_dir)
    return rollup.duplicated_bytes(_matched(spark, nodes)[0], nodes)


@query("a10_cross_totals", CROSS_SQL + """SELECT source_id, count(*) AS cross_names, sum(CASE WHEN alias_of IS NULL AND type = 'file' THEN size ELSE 0 END)::BIGINT AS cross_size,
    sum(CASE WHEN alias_of IS NOT NULL THEN size ELSE 0 END)::BIGINT AS cross_alias_bytes FROM nodes JOIN crossed USING (node_id) WHERE type <> 'directory' GROUP BY source_id""")
def a10_cross_totals(spark, sf_dir):
    nodes = _shelf(spark, sf_dir)
    return rollup.cross_totals(_matched(spark, nodes)[2], nodes)


_ANNOT = CROSS_SQL + """,
    skipped AS (SELECT DISTINCT p.node_id FROM pool p LEFT JOIN ng USING (size, ext, name) WHERE (p.cohort > 2000 OR (p.cohort >= 2 AND (n > 32 OR conflict))) AND p.node_id NOT IN (SELECT node_id FROM members)),
    dupf AS (SELECT node_id FROM members UNION SELECT node_id FROM nodes WHERE alias_of IN (SELECT node_id FROM members)),
    lf AS (SELECT n.*, n.node_id IN (SELECT node_id FROM dupf) AS dup, n.node_id IN (SELECT node_id FROM crossed) AS crossed, n.node_id IN (SELECT node_id FROM skipped) AS skip FROM nodes n WHERE type <> 'directory'),
    dx AS (SELECT ancestor_id, sum(size) FILTER (type = 'file' AND alias_of IS NULL) AS bytes, sum(size) FILTER (type = 'file' AND alias_of IS NULL AND dup) AS dup_bytes, sum(size) FILTER (type = 'file' AND alias_of IS NULL AND crossed) AS cross_bytes,
        count(*) AS names, count(*) FILTER (crossed) AS cross_names, count(*) FILTER (skip AND alias_of IS NULL) AS skips FROM lf JOIN closure USING (node_id) GROUP BY ancestor_id),
    annot AS (
        SELECT node_id, dup AS has_dup, 0.0::DOUBLE AS dup_pct, crossed AS cross_dup, CASE WHEN crossed AND alias_of IS NULL AND type = 'file' THEN size ELSE 0 END AS cross_dup_size, crossed::BIGINT AS cross_dup_file_count, false AS in_folder_group, skip AS skipped, 0::BIGINT AS skipped_count FROM lf WHERE dup OR skip
        UNION ALL
        SELECT n.node_id, coalesce(dup_bytes, 0) > 0, round(CASE WHEN bytes > 0 THEN coalesce(dup_bytes, 0) * 100.0 / bytes ELSE 0 END, 6)::DOUBLE, coalesce(cross_names, 0) = coalesce(names, 0), coalesce(cross_bytes, 0)::BIGINT, coalesce(cross_names, 0), n.node_id IN (SELECT node_id FROM folder), false, coalesce(skips, 0)
        FROM nodes n LEFT JOIN dx ON dx.ancestor_id = n.node_id WHERE n.type = 'directory')
"""


def _annotated(spark, sf_dir):
    nodes = _shelf(spark, sf_dir)
    groups, skipped, cross = _matched(spark, nodes)
    folders = rollup.overlap_folders(nodes, cross)
    return nodes, groups, materialize(spark, rollup.annotations(nodes, groups, cross, skipped, folders), "annotations")


@query("a11_annotations", _ANNOT + "SELECT * FROM annot")
def a11_annotations(spark, sf_dir):
    return _annotated(spark, sf_dir)[2].withColumn("dup_pct", F.round("dup_pct", 6))


@query("a15_hash_coverage", SHELF_SQL + "SELECT source_id, count(content_hash) AS hash_coverage_files, coalesce(sum(size) FILTER (content_hash IS NOT NULL), 0)::BIGINT AS hash_coverage_bytes, bool_or(content_hash IS NULL) AS waiting FROM nodes WHERE type = 'file' AND alias_of IS NULL AND size > 0 GROUP BY source_id")
def a15_hash_coverage(spark, sf_dir):
    from treeledger.operators.hashing import coverage

    return coverage(corpora.shelf(spark, sf_dir))


@query("p8_source_list", CROSS_SQL + """,
    mm AS (SELECT group_key, node_id, source_id, CASE WHEN type = 'file' THEN nodes.size ELSE 0 END AS bytes FROM members JOIN nodes USING (node_id)),
    su AS (SELECT *, min(source_id) OVER g <> max(source_id) OVER g AS spans FROM mm WINDOW g AS (PARTITION BY group_key) QUALIFY spans OR node_id <> min(node_id) OVER g),
    once AS (SELECT * FROM su QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY group_key) = 1),
    d AS (SELECT source_id, sum(bytes)::BIGINT AS bytes FROM once GROUP BY source_id),
    t AS (SELECT source_id, sum(size) FILTER (type = 'file') - coalesce(sum(size) FILTER (alias_of IS NOT NULL), 0) AS physical, count(*) FILTER (type <> 'directory') AS file_count FROM nodes GROUP BY source_id)
    SELECT t.source_id, s.label, t.file_count, t.physical::BIGINT AS physical_size, round(d.bytes * 100.0 / t.physical, 6)::DOUBLE AS duplicated_pct FROM t JOIN d USING (source_id) JOIN sources s ON s.id = t.source_id""")
def p8_source_list(spark, sf_dir):
    nodes = _shelf(spark, sf_dir)
    groups, _, cross = _matched(spark, nodes)
    out = browse.source_list(corpora.sources(spark), tree.source_totals(nodes), rollup.duplicated_bytes(groups, nodes), rollup.cross_totals(cross, nodes))
    return out.select("source_id", "label", "file_count", "physical_size", F.round("duplicated_pct", 6).alias("duplicated_pct"))


# Browsing and target trees


def _node_id(source: int, path: str) -> int:
    import hashlib

    return int(hashlib.md5(f"{source}:{path}".encode()).hexdigest()[:15], 16)


ROOT = _node_id(1, "R/y1996")


def _marks(nodes: DataFrame) -> DataFrame:
    """Annotations that a small rule gives, for queries on what reads them."""
    return nodes.where("node_id % 3 <> 1").select("node_id", (F.col("node_id") % 2 == 0).alias("has_dup"), (F.col("node_id") % 100).cast("double").alias("dup_pct"), (F.col("node_id") % 3 == 0).alias("cross_dup"), F.lit(False).alias("in_folder_group"), (F.col("node_id") % 5 == 0).alias("skipped"))


@query("p4_tree_level", SHELF_SQL + f"""SELECT n.node_id, name, type, size, CASE WHEN node_id % 3 <> 1 THEN node_id % 2 = 0 ELSE false END AS has_dup, CASE WHEN node_id % 3 <> 1 THEN node_id % 100 ELSE 0 END::DOUBLE AS dup_pct,
    node_id % 3 = 0 AS cross_dup, false AS in_folder_group, CASE WHEN node_id % 3 <> 1 THEN node_id % 5 = 0 ELSE false END AS skipped, alias_of IS NOT NULL OR node_id IN (SELECT alias_of FROM nodes WHERE alias_of IS NOT NULL) AS is_hardlink
    FROM nodes n WHERE source_id = 1 AND parent_id = {_node_id(1, "R/y1996/m5")}""")
def p4_tree_level(spark, sf_dir):
    nodes = _shelf(spark, sf_dir)
    return browse.tree_level(nodes, _marks(nodes), _node_id(1, "R/y1996/m5"), 1)


_GROUPS = """, grouped AS (SELECT group_key, 'file' AS kind, any_value(signal) AS signal, any_value(confidence)::DOUBLE AS confidence, min(size) AS size FROM members GROUP BY group_key),
    lm2 AS (SELECT m.group_key, m.node_id, n.name FROM members m JOIN nodes n USING (node_id) WHERE n.source_id <> 3)"""


def _paged(spark, sf_dir):
    nodes = _shelf(spark, sf_dir)
    members = materialize(spark, matching.match(spark, nodes)[0], "members")
    groups = members.groupBy("group_key", "kind", "signal", "confidence").agg(F.min("size").alias("size"))
    return nodes, members, groups, corpora.sources(spark, (3,))


@query("p6_group_filter", MATCH_SQL + _GROUPS + """ SELECT group_key, confidence, size FROM grouped WHERE confidence >= 50 AND size >= 100000 AND ((confidence >= 99 AND confidence < 100) OR (confidence >= 55 AND confidence < 70))
    AND group_key IN (SELECT group_key FROM lm2 GROUP BY group_key HAVING count(*) > 1) AND group_key IN (SELECT group_key FROM members JOIN nodes USING (node_id) WHERE contains(name, 'f1'))""")
def p6_group_filter(spark, sf_dir):
    nodes, members, groups, srcs = _paged(spark, sf_dir)
    r = browse.PageRequest(min_confidence=50, min_size=100_000, kinds=("file",), tiers=((99, 100), (55, 70)), search="F1")
    return browse.filtered_groups(groups, members, nodes, srcs, r).select("group_key", "confidence", "size")


@query("p6_group_page", MATCH_SQL + _GROUPS + """, page AS (SELECT * FROM grouped WHERE group_key IN (SELECT group_key FROM lm2 GROUP BY group_key HAVING count(*) > 1) ORDER BY size DESC, confidence DESC, group_key LIMIT 50 OFFSET 100)
    SELECT group_key, kind, signal, confidence, size, (SELECT string_agg(node_id, ',' ORDER BY node_id) FROM lm2 WHERE lm2.group_key = page.group_key) AS members FROM page""")
def p6_group_page(spark, sf_dir):
    nodes, members, groups, srcs = _paged(spark, sf_dir)
    page = browse.group_page(groups, members, nodes, srcs, browse.PageRequest(order="size-desc", limit=50, offset=100))
    return page.select("group_key", "kind", "signal", "confidence", "size", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("p7_best_group", MATCH_SQL + _GROUPS + """ SELECT node_id, group_key, confidence FROM lm2 JOIN grouped USING (group_key) WHERE group_key IN (SELECT group_key FROM lm2 GROUP BY group_key HAVING count(*) > 1)
    QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY confidence DESC, group_key) = 1""")
def p7_best_group(spark, sf_dir):
    nodes, members, groups, srcs = _paged(spark, sf_dir)
    return browse.best_groups(groups, members, nodes, srcs)


_HITS = SHELF_SQL + ", hit AS (SELECT node_id FROM nodes WHERE regexp_matches(lower(name), '(?s)f1.*7.x')), up AS (SELECT DISTINCT ancestor_id AS node_id FROM closure JOIN hit USING (node_id)) "


@query("t1_search_nodes", _HITS + "SELECT node_id, node_id IN (SELECT node_id FROM hit) AS matched, node_id IN (SELECT node_id FROM up) AS is_ancestor FROM (SELECT node_id FROM hit UNION SELECT node_id FROM up)")
def t1_search_nodes(spark, sf_dir):
    nodes = _shelf(spark, sf_dir)
    return browse.search_nodes(nodes, None, "F1*7?x")


@query("p11_visible", _HITS + "SELECT node_id FROM (SELECT node_id FROM hit UNION SELECT node_id FROM up) WHERE node_id % 3 <> 0")
def p11_visible(spark, sf_dir):
    nodes = _shelf(spark, sf_dir)
    return browse.visible(nodes, None, _marks(nodes), "F1*7?x", True)


@query("t2_node_location", SHELF_SQL + """SELECT n.node_id, coalesce(string_agg(ancestor_id, ',' ORDER BY distance DESC), '') AS ancestors, n.node_id % 3 = 0 OR coalesce(bool_or(ancestor_id % 3 = 0), false) AS hidden_by_filter
    FROM nodes n LEFT JOIN closure USING (node_id) WHERE type = 'link' GROUP BY n.node_id""")
def t2_node_location(spark, sf_dir):
    nodes = _shelf(spark, sf_dir)
    found = browse.locations(nodes, None, _marks(nodes), nodes.where("type = 'link'"))
    return found.select("node_id", F.array_join(F.transform("ancestors", lambda x: x.cast("string")), ",").alias("ancestors"), "hidden_by_filter")


@query("t3_materialize_subtree", SHELF_SQL + f""", below AS (SELECT node_id FROM closure WHERE ancestor_id = {ROOT} UNION SELECT {ROOT}),
    under AS (SELECT DISTINCT c.node_id FROM closure c JOIN below USING (node_id) WHERE ancestor_id IN (SELECT node_id FROM below) AND ancestor_id <> {ROOT} AND ancestor_id % 3 = 0)
    , ids AS (SELECT node_id, row_number() OVER (ORDER BY node_id) + 999 AS id FROM below)
    SELECT i.id, 7::BIGINT AS consolidation_id, CASE WHEN n.node_id = {ROOT} THEN 5 ELSE p.id END AS parent_id, name, CASE WHEN type = 'directory' THEN 'directory' ELSE 'file' END AS type,
    n.node_id AS source_node_id, CASE WHEN n.node_id = {ROOT} THEN 3 ELSE row_number() OVER (PARTITION BY n.parent_id ORDER BY type <> 'directory', lower(name), n.node_id) END AS sort_order, false AS done,
    n.node_id % 3 = 0 AND n.node_id <> {ROOT} AND n.node_id NOT IN (SELECT node_id FROM under) AS struck FROM nodes n JOIN ids i USING (node_id) LEFT JOIN ids p ON p.node_id = n.parent_id""")
def t3_materialize_subtree(spark, sf_dir):
    nodes = _shelf(spark, sf_dir)
    return plan_tree.materialize_subtree(nodes, tree.closure_by_path(nodes), _marks(nodes), ROOT, 7, 5, 3, 1000, True)


def _plan_rows(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("id"), "parent_id", "name", s.normalize_type(F.col("type")).alias("type"), F.col("node_id").alias("source_node_id"), (F.col("node_id") % 2 == 0).alias("done"), (F.col("node_id") % 7 == 0).alias("struck"))


def _renames(rows: DataFrame) -> DataFrame:
    return rows.where("id % 5 = 0").select(F.lit("cons").alias("kind"), F.col("id").alias("ref_id"), F.concat(F.lit("renamed-"), (F.col("id") % 1000).cast("string")).alias("new_name"))


_PLAN = SHELF_SQL + """, r AS (SELECT node_id AS id, parent_id, CASE WHEN node_id % 5 = 0 THEN 'renamed-' || (node_id % 1000) ELSE name END AS name, type <> 'directory' AS is_file, node_id % 2 = 0 AS done, node_id % 7 = 0 AS struck, CASE WHEN type = 'file' AND alias_of IS NOT NULL THEN 0 ELSE size END AS size FROM nodes),
    cl2 AS (SELECT c.* FROM closure c JOIN r ON r.id = c.node_id),
    ra AS (SELECT r.*, struck OR id IN (SELECT node_id FROM cl2 WHERE ancestor_id % 7 = 0) AS struck_all FROM r)
"""


@query("t4_path_lengths", _PLAN + """, path AS (SELECT r.id, 'D:\\' || coalesce((SELECT string_agg(a.name, '\\' ORDER BY distance DESC) || '\\' FROM cl2 JOIN r a ON a.id = cl2.ancestor_id WHERE cl2.node_id = r.id), '') || r.name AS path FROM r),
    m AS (SELECT ra.id, path, length(path) AS length, NOT struck_all AND NOT (NOT is_file AND ra.id IN (SELECT parent_id FROM r WHERE NOT struck AND parent_id IS NOT NULL)) AS measured FROM ra JOIN path USING (id))
    SELECT id, path, length, measured, (measured AND length > 26) OR id IN (SELECT ancestor_id FROM cl2 JOIN m ON m.id = cl2.node_id WHERE measured AND length > 26) AS over_limit FROM m""")
def t4_path_lengths(spark, sf_dir):
    nodes = _shelf(spark, sf_dir)
    rows = _plan_rows(nodes)
    closure = tree.closure_by_path(nodes.where("type = 'directory'"))
    return plan_tree.path_lengths(spark, rows, _renames(rows), closure, "D:\\", 26).withColumn("length", F.col("length").cast("long"))


@query("a12_consolidated_stats", _PLAN + """SELECT f.id, count(*) FILTER (d.is_file AND NOT d.struck_all) AS live_files, coalesce(sum(d.size) FILTER (d.is_file AND NOT d.struck_all), 0)::BIGINT AS live_bytes,
    count(*) FILTER (d.is_file AND d.struck_all AND f.struck_all) AS struck_files, coalesce(sum(d.size) FILTER (d.is_file AND d.struck_all AND f.struck_all), 0)::BIGINT AS struck_bytes, coalesce(bool_and(d.done), false) AS all_done
    FROM ra f LEFT JOIN cl2 ON cl2.ancestor_id = f.id LEFT JOIN ra d ON d.id = cl2.node_id WHERE NOT f.is_file GROUP BY f.id""")
def a12_consolidated_stats(spark, sf_dir):
    nodes = _shelf(spark, sf_dir)
    sizes = nodes.select(F.col("node_id").alias("source_node_id"), F.when(F.col("alias_of").isNotNull(), 0).otherwise(F.col("size")).alias("size"))
    return plan_tree.consolidated_stats(_plan_rows(nodes), tree.closure_by_path(nodes.where("type = 'directory'")), sizes)


@query("a13_sources_below", SHELF_SQL + "SELECT dir_path, count(DISTINCT leaf) AS n_sources FROM (SELECT a.rel_path AS dir_path, n.source_id AS leaf FROM nodes n JOIN closure c ON c.node_id = n.node_id JOIN nodes a ON a.node_id = c.ancestor_id WHERE n.type <> 'directory') GROUP BY dir_path")
def a13_sources_below(spark, sf_dir):
    return rollup.sources_below(corpora.shelf(spark, sf_dir), F.col("source_id"))


@query("t8_delete_nodes", SHELF_SQL + "SELECT node_id AS id FROM nodes WHERE source_id <> 1 OR NOT (rel_path = 'R/y1996' OR starts_with(rel_path, 'R/y1996/'))")
def t8_delete_nodes(spark, sf_dir):
    nodes = corpora.shelf(spark, sf_dir)
    return plan_tree.delete_nodes(nodes.select(F.col("node_id").alias("id")), tree.closure_by_path(nodes), [ROOT])


@query("p10_purge_source", SHELF_SQL + "SELECT node_id AS id, CASE WHEN source_id <> 2 THEN node_id END AS source_node_id, CASE WHEN type = 'directory' THEN 'directory' ELSE 'file' END AS type FROM nodes WHERE source_id <> 2 OR type = 'directory'")
def p10_purge_source(spark, sf_dir):
    nodes = _shelf(spark, sf_dir)
    rows = nodes.select(F.col("node_id").alias("id"), F.col("node_id").alias("source_node_id"), s.normalize_type(F.col("type")).alias("type"))
    return plan_tree.purge_source_files(rows, nodes, 2)


@query("s1_tree_json", """SELECT source AS document, 'top/' || lang || '/' || doc_id AS rel_path, doc_id::VARCHAR AS name, 'file' AS type, n_chars AS size, 2::BIGINT AS depth FROM documents
    UNION ALL SELECT DISTINCT source, 'top/' || lang, lang, 'directory', 0, 1 FROM documents UNION ALL SELECT DISTINCT source, 'top', 'top', 'directory', 0, 0 FROM documents""")
def s1_tree_json(spark, sf_dir):
    from treeledger.sources.tree_json import flatten

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = d.groupBy("source", "lang").agg(F.collect_list(F.struct(F.lit("file").alias("type"), F.col("doc_id").cast("string").alias("name"), F.col("n_chars").alias("size"))).alias("contents"))
    langs = files.groupBy("source").agg(F.collect_list(F.struct(F.lit("directory").alias("type"), F.col("lang").alias("name"), "contents")).alias("contents"))
    texts = langs.select("source", F.to_json(F.array(F.struct(F.lit("directory").alias("type"), F.lit(".").alias("name"), F.array(F.struct(F.lit("directory").alias("type"), F.lit("top").alias("name"), "contents")).alias("contents")))).alias("json"))
    return flatten(texts, "source", "json").select(F.col("document"), "rel_path", "name", "type", "size", "depth")


@query("t7_count_below", SHELF_SQL + "SELECT ancestor_id AS node_id, count(*) AS n_below FROM closure JOIN nodes USING (node_id) WHERE type = 'link' GROUP BY ancestor_id")
def t7_count_below(spark, sf_dir):
    nodes = _shelf(spark, sf_dir)
    return browse.count_below(nodes, tree.closure_by_path(nodes.where("type = 'directory'")), F.col("type") == "link")


@query("t7_selection_roots", SHELF_SQL + ", chosen AS (SELECT node_id FROM nodes WHERE contains(name, '7')) SELECT node_id FROM chosen WHERE node_id NOT IN (SELECT c.node_id FROM closure c JOIN chosen a ON a.node_id = c.ancestor_id)")
def t7_selection_roots(spark, sf_dir):
    nodes = _shelf(spark, sf_dir)
    chosen = nodes.where(F.col("name").contains("7"))
    return browse.selection_roots(chosen.select("node_id"), tree.closure_by_path(chosen))


@query("f16_times", SHELF_SQL + "SELECT node_id, CASE WHEN mtime IS NULL THEN '—' ELSE replace(mtime, '_', ' ') END AS shown FROM nodes")
def f16_times(spark, sf_dir):
    return corpora.shelf(spark, sf_dir).select("node_id", s.format_time(F.col("mtime")).alias("shown"))


@query("f18_paths", "SELECT page_id, array_to_string(list_filter(string_split(replace(url, '\\', '/'), '/'), lambda x: x <> ''), '/') AS joined, len(list_filter(string_split(replace(url, '\\', '/'), '/'), lambda x: x <> '')) AS n_segments FROM pages")
def f18_paths(spark, sf_dir):
    parts = s.path_segments(F.col("url"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", s.join_path(parts).alias("joined"), F.size(parts).cast("long").alias("n_segments"))
