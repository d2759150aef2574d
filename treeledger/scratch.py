"""Tables that cut a plan's lineage, in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Scratch tables of each application, oldest first.
_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. Where it is unset, a folder that ends with the process if all runs on this machine, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="treeledger-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/treeledger/{app}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(app, []).append(path)
    return path


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write and read back, so that no later stage depends on what an executor holds."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, p: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that materialize returned, once nothing reads it any more."""
    _delete(spark, df._scratch_path)
    _made[spark.sparkContext.applicationId].remove(df._scratch_path)


def mark(spark: SparkSession) -> int:
    """How many scratch tables there are; see release."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete this application's scratch tables made after a mark, but for one. Results that read them and are not read yet become unreadable."""
    held = _made.get(spark.sparkContext.applicationId, [])
    stay = getattr(keep, "_scratch_path", None)
    for p in held[since:]:
        if p != stay:
            _delete(spark, p)
    held[since:] = [p for p in held[since:] if p == stay]
