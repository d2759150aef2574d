"""Structured Streaming over listings that arrive in a folder: each batch's nodes are appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treeledger.sources.tree_json import flatten


def follow_listings(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Flatten every new listing of `folder` into Parquet under `out`, in a folder for each batch, so that a batch that runs again replaces itself."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.input_file_name().alias("document"), F.col("value").alias("json"))

    def commit(batch: DataFrame, number: int) -> None:
        flatten(batch, "document", "json").write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = files.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
