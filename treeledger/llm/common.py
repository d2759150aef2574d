"""What the corpus operators share: table access, scratch tables, exact keys of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.scratch import discard, mark, materialize, release, scratch_path

__all__ = ["DOCUMENT", "at_work", "by_bytes", "discard", "document_key", "mark", "materialize", "release", "scratch_path", "table", "text_key"]

#: Columns that tell documents apart: id and text. Rows that agree in both are one document several times.
DOCUMENT = ["nameless", "id", "text_key"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory. Spark opens the path, so any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """128-bit digest of a text that stands for the text itself in grouping; null counts as its own value."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def document_key() -> list[Column]:
    """DOCUMENT, none of them null, in an order that puts ids before their lack."""
    return [F.col("doc_id").isNull().alias("nameless"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), text_key(F.col("text")).alias("text_key")]


BATCH_BYTES = "4m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def by_bytes(df: DataFrame) -> DataFrame:
    """Rows on their way to Python: Arrow batches end at BATCH_BYTES, as rows with whole texts are of any size, unless the session has a bound of its own."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING, None) is None:
        conf.set(_BATCH_SETTING, BATCH_BYTES)
    return df


_caches: dict[str, Callable[[], None]] = {}


def at_work(name: str, clear: Callable[[], None]) -> None:
    """For tasks, as they begin: a Python worker that serves several operators keeps the cache of the one that it works for, and `clear` drops it when another comes."""
    for other in [n for n in _caches if n != name]:
        _caches.pop(other)()
    _caches[name] = clear
