"""File trees derived from the test tables, in Spark and as DuckDB text, so that both engines see the same rows.

`shelf`: one file for each (source, path) of lineitem, with directories, hardlinks, symlinks and digests.
`docs`: one file for each document, by language, with the digest of its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions.scalars import base_name, node_key, parent_path
from treeledger.operators.tree import hardlinks, prefixes

SOURCES = [(1, "scan", "one", False, "ext4"), (2, "scan", "two", False, "NTFS"), (3, "scan", "three", False, "vfat"), (4, "json", "four", False, "ext4")]
SHAPE = "id long, kind string, label string, excluded boolean, filesystem string"


def sources(spark: SparkSession, excluded: tuple[int, ...] = ()) -> DataFrame:
    return spark.createDataFrame([(i, k, n, i in excluded, f) for i, k, n, _, f in SOURCES], SHAPE)


def _with_directories(leaves: DataFrame, srcs: DataFrame) -> DataFrame:
    dirs = leaves.select("source_id", parent_path(F.col("rel_path")).alias("own")).distinct().select("source_id", F.explode(prefixes(F.col("own"), True)).alias("up")).select("source_id", F.col("up.path").alias("rel_path")).distinct()
    dirs = dirs.select("source_id", "rel_path", base_name(F.col("rel_path")).alias("name"), F.lit("directory").alias("type"), F.lit(0).cast("long").alias("size"))
    nodes = leaves.unionByName(dirs, allowMissingColumns=True).withColumn("node_id", node_key(F.col("source_id"), F.col("rel_path")))
    up = parent_path(F.col("rel_path"))
    nodes = nodes.withColumns({"parent_id": F.when(up != "", node_key(F.col("source_id"), up)), "depth": F.size(F.split("rel_path", "/")) - 1})
    sets = hardlinks(nodes, srcs).where("node_id <> canonical_id").select("node_id", F.col("canonical_id").alias("alias_of"))
    return nodes.join(sets, "node_id", "left")


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = lambda c: F.col(c).cast("string")
    name = F.concat(F.lit("f"), text("l_partkey"), F.lit(".x"), (F.col("l_partkey") % 30).cast("string"))
    path = F.concat(F.col("l_returnflag"), F.lit("/y"), F.year("l_shipdate").cast("string"), F.lit("/m"), F.month("l_shipdate").cast("string"), F.lit("/"), name)
    first = li.select((F.col("l_suppkey") % 4 + 1).alias("source_id"), path.alias("rel_path"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate").alias("r")).groupBy("source_id", "rel_path").agg(F.min("r").alias("r")).select("source_id", "rel_path", "r.*")
    link = (F.col("l_linenumber") == 6) & (F.col("l_partkey") % 4 == 0)
    hashed = ~link & (F.col("l_linenumber") <= 3)
    linked = ~link & (F.col("l_linenumber") == 7)
    digest = F.sha2(F.concat_ws("|", text("l_partkey"), F.col("l_quantity").cast("long").cast("string"), "l_returnflag"), 256)
    leaves = first.select(
        "source_id", "rel_path", name.alias("name"), F.when(link, "link").otherwise("file").alias("type"), (F.col("l_quantity") * 4096).cast("long").alias("size"),
        F.concat(F.date_format("l_shipdate", "yyyy-MM"), F.lit("-01_0"), text("l_linenumber"), F.lit(":00:00")).alias("mtime"),
        F.when(hashed, digest).alias("content_hash"), F.when(hashed, F.when(F.col("l_quantity") < 40, "full").otherwise("sampled")).alias("hash_kind"), F.when(hashed, "sha256/v1/test").alias("hash_spec"),
        F.when(link, F.concat(F.lit("t"), (F.col("l_partkey") % 50).cast("string"))).alias("link_target"),
        F.when(linked, F.col("source_id")).alias("dev"), F.when(linked, F.col("l_partkey") % 300).alias("inode"), F.lit(None).cast("long").alias("inode_high"),
    )
    return _with_directories(leaves, sources(spark))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    src = F.regexp_extract("source", r"(\d+)$", 1).cast("long") % 4 + 1
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    leaves = d.select(
        src.alias("source_id"), F.concat_ws("/", "lang", name).alias("rel_path"), name.alias("name"), F.lit("file").alias("type"), F.length("text").cast("long").alias("size"), F.lit(None).cast("string").alias("mtime"),
        F.sha2("text", 256).alias("content_hash"), F.lit("full").alias("hash_kind"), F.lit("sha256/v1/full").alias("hash_spec"), F.lit(None).cast("string").alias("link_target"), *[F.lit(None).cast("long").alias(c) for c in ("dev", "inode", "inode_high")],
    )
    return _with_directories(leaves, sources(spark))


def _key(source: str, path: str) -> str:
    return f"('0x' || substr(md5({source} || ':' || {path}), 1, 15))::BIGINT"


SOURCES_SQL = "sources(id, kind, label, excluded, filesystem) AS (VALUES " + ", ".join(f"({i}, '{k}', '{n}', {e}, '{f}')" for i, k, n, e, f in SOURCES) + ")"

_NODES_SQL = f"""
    dirs AS (
        SELECT DISTINCT source_id, array_to_string(list_slice(string_split(rel_path, '/'), 1, n.n), '/') AS rel_path
        FROM leaves, (SELECT unnest(range(1, 10)) AS n) n WHERE n.n < len(string_split(rel_path, '/'))),
    flat AS (
        SELECT * FROM leaves UNION ALL BY NAME
        SELECT source_id, rel_path, regexp_extract(rel_path, '[^/]*$') AS name, 'directory' AS type, 0::BIGINT AS size FROM dirs),
    keyed AS (
        SELECT *, {_key("source_id", "rel_path")} AS node_id, len(string_split(rel_path, '/')) - 1 AS depth,
               CASE WHEN contains(rel_path, '/') THEN {_key("source_id", "regexp_replace(rel_path, '/[^/]*$', '')")} END AS parent_id,
               CASE WHEN contains(rel_path, '/') THEN regexp_replace(rel_path, '/[^/]*$', '') ELSE '' END AS parent_path
        FROM flat),
    nodes AS (
        SELECT *, CASE WHEN linkable AND count(*) OVER sets > 1 AND node_id <> first_value(node_id) OVER (sets ORDER BY rel_path)
                       THEN first_value(node_id) OVER (sets ORDER BY rel_path) END AS alias_of
        FROM (SELECT keyed.*, coalesce(keyed.type = 'file' AND inode IS NOT NULL AND s.kind = 'scan' AND lower(s.filesystem) IN ('ext4', 'ntfs'), false) AS linkable
              FROM keyed JOIN sources s ON s.id = source_id)
        WINDOW sets AS (PARTITION BY source_id, linkable, dev, inode)),
    closure AS (
        SELECT node_id, {_key("source_id", "array_to_string(list_slice(string_split(rel_path, '/'), 1, n.n), '/')")} AS ancestor_id, depth + 1 - n.n AS distance
        FROM nodes, (SELECT unnest(range(1, 10)) AS n) n WHERE n.n <= depth)"""

SHELF_SQL = f"""WITH RECURSIVE {SOURCES_SQL},
    leaves AS (
        SELECT source_id, rel_path, name, CASE WHEN link THEN 'link' ELSE 'file' END AS type, (l_quantity * 4096)::BIGINT AS size,
               strftime(l_shipdate, '%Y-%m-01_0') || l_linenumber || ':00:00' AS mtime,
               CASE WHEN hashed THEN sha256(l_partkey || '|' || l_quantity::BIGINT || '|' || l_returnflag) END AS content_hash,
               CASE WHEN hashed THEN CASE WHEN l_quantity < 40 THEN 'full' ELSE 'sampled' END END AS hash_kind,
               CASE WHEN hashed THEN 'sha256/v1/test' END AS hash_spec, CASE WHEN link THEN 't' || (l_partkey % 50) END AS link_target,
               CASE WHEN linked THEN source_id END AS dev, CASE WHEN linked THEN l_partkey % 300 END AS inode
        FROM (SELECT *, l_linenumber = 6 AND l_partkey % 4 = 0 AS link, l_linenumber <= 3 AS hashed, l_linenumber = 7 AS linked
              FROM (SELECT *, l_suppkey % 4 + 1 AS source_id, 'f' || l_partkey || '.x' || (l_partkey % 30) AS name,
                           l_returnflag || '/y' || year(l_shipdate) || '/m' || month(l_shipdate) || '/' || 'f' || l_partkey || '.x' || (l_partkey % 30) AS rel_path
                    FROM lineitem)
              QUALIFY row_number() OVER (PARTITION BY source_id, rel_path ORDER BY l_orderkey, l_linenumber) = 1)),{_NODES_SQL}
"""

DOCS_SQL = f"""WITH RECURSIVE {SOURCES_SQL},
    leaves AS (
        SELECT regexp_extract(source, '[0-9]+$')::BIGINT % 4 + 1 AS source_id, lang || '/' || doc_id || '.txt' AS rel_path, doc_id || '.txt' AS name, 'file' AS type,
               length(text)::BIGINT AS size, NULL::VARCHAR AS mtime, sha256(text) AS content_hash, 'full' AS hash_kind, 'sha256/v1/full' AS hash_spec,
               NULL::VARCHAR AS link_target, NULL::BIGINT AS dev, NULL::BIGINT AS inode
        FROM documents),{_NODES_SQL}
"""
