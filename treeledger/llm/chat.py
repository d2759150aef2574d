"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation several times, once after each exchange. A conversation that is a turn prefix of a
longer one, or a copy of another, is dropped before rendering; what remains is maximal.

The hash of a turn prefix is the running XOR of one keyed hash for each turn (position, role, text), twice with
different keys: a rolling hash that a window function can carry. Whole-conversation hashes are looked up among the
proper-prefix hashes of all others by an anti-join. Both sides are made distinct before they meet, so a first
turn or a conversation that a third of the log shares is one row on each side.

Turns are hashed where they are read, and only their digests are shuffled to find what is maximal; texts are shuffled once, those of
the conversations that stay. Turns without a conversation are conversations of one turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeledger.llm.common import materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: The order of a conversation's turns. Turns of one number go by role and by a digest of the text.
ORDER = ["turn", "role", "mark"]


def keys() -> list[Column]:
    """conv_id, turn, role and mark (a digest of role and text) of a turn; roles and texts that are null count as empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return [F.col("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(F.concat(role, F.lit("\n"), text)).alias("mark")]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 1), n_turns and the two hashes of the prefix that ends at each turn; of turns' keys."""
    order = Window.partitionBy("conv_id").orderBy(*ORDER)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = turns.withColumn("position", F.row_number().over(order))
    one = lambda seed: F.xxhash64(F.lit(seed), F.col("position"), F.col("mark"))
    return numbered.select("conv_id", "position", F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n_turns"), F.bit_xor(one(11)).over(so_far).alias("h1"), F.bit_xor(one(29)).over(so_far).alias("h2"))


def maximal(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """conv_id, mark, n_turns and n_copies of the conversations that are no proper prefix of another; of equal ones the smallest conv_id stays.

    `mark` is of the only turn where no conversation of the kind has an id, else null.
    """
    hashed = prefix_hashes(turns.where("conv_id IS NOT NULL"))
    one = lambda seed: F.xxhash64(F.lit(seed), F.lit(1), F.col("mark"))
    alone = turns.where("conv_id IS NULL").select("conv_id", F.lit(1).alias("position"), F.lit(1).cast("long").alias("n_turns"), one(11).alias("h1"), one(29).alias("h2"), "mark")
    hashed = materialize(spark, hashed.unionByName(alone, allowMissingColumns=True), "prefixes")
    ends = hashed.where(F.col("position") == F.col("n_turns"))
    full = ends.groupBy("h1", "h2", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.max("mark").alias("mark"), F.count("*").alias("n_copies"))
    proper = hashed.where(F.col("position") < F.col("n_turns")).select("h1", "h2", F.col("position").cast("long").alias("n_turns")).distinct()
    stay = full.join(proper, ["h1", "h2", "n_turns"], "left_anti")
    return stay.select("conv_id", F.when(F.col("conv_id").isNull(), F.col("mark")).alias("mark"), "n_turns", "n_copies")


def format_conversations(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Collapse snapshots and render; returns conv_id, n_turns, n_copies, n_chars, rendered.

    Turns are ordered by turn number, then role and a digest of the text, so ties and repeated rows have one order (a repeated row is
    a turn of its own). Null roles and texts count as empty; a null turn number sorts first. A row with a null conv_id belongs to no
    other and is a conversation by itself, which collapses like any other. An empty table gives no rows. Other columns are ignored.
    """
    stay = materialize(spark, maximal(spark, turns.select(*keys())), "maximal")
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    lines = turns.select(*keys(), line.alias("line"))
    own = lines.where("conv_id IS NOT NULL").join(stay.where("conv_id IS NOT NULL").drop("mark"), "conv_id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("placed"), *ORDER, "line"))), lambda x: x["line"]), "")
    rendered = own.groupBy("conv_id", "n_turns", "n_copies").agg(joined.alias("rendered")).select("conv_id", "n_turns", "n_copies", "rendered")
    single = lines.where("conv_id IS NULL").groupBy("mark").agg(F.first("line").alias("rendered")).join(stay.where("conv_id IS NULL").drop("conv_id"), "mark")
    rendered = rendered.unionByName(single.select(F.lit(None).cast(dict(turns.dtypes)["conv_id"]).alias("conv_id"), "n_turns", "n_copies", "rendered"))
    return rendered.select("conv_id", "n_turns", "n_copies", F.length("rendered").cast("long").alias("n_chars"), "rendered")

