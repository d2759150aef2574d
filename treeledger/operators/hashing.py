"""Content digests: which files need one, reading them, resuming, and the cache of earlier digests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions.regions import HashSpec, plan_regions
from treeledger.functions.scalars import cache_volume_id

BATCH = 2_000
ROUNDS = 200


def hash_candidates(nodes: DataFrame, min_size: int | Column) -> DataFrame:
    """Canonical files with bytes, from the least size on, that have no digest."""
    return nodes.where("type = 'file' AND alias_of IS NULL AND size > 0 AND content_hash IS NULL").where(F.col("size") >= min_size)


def hash_file(path: str, size: int, spec: HashSpec) -> tuple[str, int]:
    """Digest of a file under a spec (the spec's name, the size and the regions' bytes go in), and the bytes read."""
    h = hashlib.sha256(str(spec).encode() + size.to_bytes(8, "little"))
    read = 0
    with open(path, "rb") as f:
        for a, b in plan_regions(size, spec):
            f.seek(a)
            left = b - a
            while left and (part := f.read(min(left, 1 << 20))):
                h.update(part)
                left -= len(part)
                read += len(part)
            if left:
                raise OSError(f"{path} is shorter than its recorded size")
    return h.hexdigest(), read


def read_digests(files: DataFrame, root: str, spec: HashSpec, tasks: int = 32) -> DataFrame:
    """node_id, content_hash, hash_kind, hash_spec, hash_bytes_read, error for files below a folder that executors can read.

    Small and large files are dealt to tasks apart, so that few large ones do not hold up many small ones.
    """
    large = F.col("size") >= (spec.threshold or 1 << 62)

    def run(batches):
        for b in batches:
            out = []
            for node, path, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                kind = "full" if spec.threshold is None or size < spec.threshold else "sampled"
                try:
                    digest, read = hash_file(f"{root}/{path}", size, spec)
                    out.append((node, digest, kind, str(spec), read, None))
                except OSError as e:
                    out.append((node, None, None, None, 0, str(e)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["node_id", "content_hash", "hash_kind", "hash_spec", "hash_bytes_read", "error"])

    return files.select("node_id", "rel_path", "size").repartition(tasks, large, "node_id").mapInArrow(run, "node_id long, content_hash string, hash_kind string, hash_spec string, hash_bytes_read long, error string")


def from_cache(files: DataFrame, cache: DataFrame, volume_id: str | None, spec: HashSpec) -> DataFrame:
    """Digests that an earlier session read: same volume, file id, size, time and spec. A missing time is the empty one; a missing device or inode never hits."""
    held = cache.where(F.col("hash_spec") == str(spec)).select("volume_id", F.col("file_id").alias("inode"), "size", F.coalesce("mtime", F.lit("")).alias("at"), "content_hash", "hash_kind", "hash_spec")
    volume = cache_volume_id(F.lit(volume_id).cast("string"), F.col("dev"))
    want = files.where("dev IS NOT NULL AND inode IS NOT NULL").select("node_id", volume.alias("volume_id"), "inode", "size", F.coalesce("mtime", F.lit("")).alias("at"))
    return want.join(held, ["volume_id", "inode", "size", "at"]).select("node_id", "content_hash", "hash_kind", "hash_spec").dropDuplicates(["node_id"])


def run_hash_scan(spark: SparkSession, files: DataFrame, root: str, folder: str, spec: HashSpec, cancelled: Callable[[], bool] = lambda: False, progress: Callable[[int, int], None] = lambda done, all_: None, batch: int = BATCH) -> str:
    """Digest files in committed batches under `folder`; returns `done`, or `hashing` when cancelled in between.

    A batch holds `batch` files at least and a 200th of all where that is more, so that the number of rounds is bounded. What
    `folder` has from runs before is left out; a run's own batches share no file.
    """
    total = files.count()
    number = max(1, min(-(-total // batch), ROUNDS))
    dealt = files.withColumn("batch", F.pmod(F.xxhash64("node_id"), F.lit(number)))
    try:
        dealt = dealt.join(spark.read.parquet(folder).select("node_id"), "node_id", "left_anti")
    except AnalysisException as e:  # no batch is committed yet
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    tasks = max(1, min(-(-total // number), max(32, -(-total // (number * BATCH)))))
    for i in range(number):
        if cancelled():
            return "hashing"
        read_digests(dealt.where(F.col("batch") == i), root, spec, tasks).where("error IS NULL").drop("error").write.mode("append").parquet(folder)
        progress(i + 1, number)
    return "done"


def coverage(nodes: DataFrame) -> DataFrame:
    """source_id with the files and bytes that have digests, and whether any file still waits for one."""
    has = F.col("content_hash").isNotNull()
    rows = nodes.where("type = 'file' AND alias_of IS NULL AND size > 0")
    return rows.groupBy("source_id").agg(F.count_if(has).alias("hash_coverage_files"), F.sum(F.when(has, F.col("size")).otherwise(0)).alias("hash_coverage_bytes"), F.bool_or(~has).alias("waiting"))
