"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A text's tokens are its runs of letters and digits in lower case, and single characters in scripts that are written without spaces. A
document is contaminated by an item when, aligned at some offset, a window of WINDOW tokens of the item agrees with the document in all
but two places; an item shorter than that must agree over its whole length, in all but one place from SOME tokens on, else in every place. Fixed masks
hash the tokens at selected positions and ignore the others:

* the two MASKS together hit every window that has two substitutions, wherever they are;
* of an item of SOME to WINDOW - 1 tokens one substitution leaves the first END tokens or the last as they are;
* a shorter item is one seed by itself.

So no such overlap is missed. Every seed hit gives an alignment, and each distinct alignment is compared token by token. What is broadcast are
seeds, each a hash, an item's number and a place, and an item may be dealt over several broadcasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm.common import DOCUMENT, document_key, materialize

WINDOW, NEEDED = 13, 11
SOME, END = 8, 4
LEAST_TOKENS = 5
MASKS = ((0, 1, 2, 5, 7, 8), (0, 2, 3, 4, 7, 8))
SPAN = 9
#: Seeds are broadcast in chunks of about so many rows of 20 bytes; each chunk reads the documents once.
SEEDS_A_CHUNK = 1_000_000
#: Items and the keys of documents that were hit are broadcast up to so many bytes, and joined beyond.
MOST_SENT = 64 << 20
#: Scripts written without spaces, by their blocks (scripts as such are slow to tell): Thai and Lao, Myanmar, Khmer, kana, Han.
UNSPACED = r"[\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{323af}]"


def tokens(text: Column) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    parted = F.when(lower.rlike(UNSPACED), F.regexp_replace(lower, f"({UNSPACED})", " $1 ")).otherwise(lower)
    return F.transform(F.regexp_extract_all(parted, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.xxhash64(w))


def _at(position: Column, offset) -> Column:
    return F.get(F.col("tokens"), position + offset)


def masked(position: Column) -> list[Column]:
    """The hashes of MASKS at a position, null where they do not fit."""
    fits = F.size("tokens") - position >= SPAN
    return [F.when(fits, F.xxhash64(F.lit(i), *[_at(position, k) for k in mask])) for i, mask in enumerate(MASKS)]


def run_of(position: Column, n: int, tag: int) -> Column:
    """The hash of `n` tokens from a position on, null where they do not fit."""
    return F.when(F.size("tokens") - position >= n, F.xxhash64(F.lit(-tag), *[_at(position, k) for k in range(n)]))


def item_seeds(items: DataFrame, short: list[int]) -> DataFrame:
    """seed, item and place in the item, from item and tokens."""
    n, place = F.size("tokens"), F.col("place")
    long = items.where(n >= WINDOW).select("*", F.explode(F.sequence(F.lit(0), n - SPAN)).alias("place")).select("item", "place", F.explode(F.array(*masked(place))).alias("seed"))
    some = items.where((n >= SOME) & (n < WINDOW)).select("*", F.explode(F.array(F.lit(0), n - END)).alias("place")).select("item", "place", run_of(place, END, WINDOW).alias("seed"))
    out = long.unionByName(some)
    for k in short:
        out = out.unionByName(items.where(n == k).select("item", F.lit(0).alias("place"), run_of(F.lit(0), k, k).alias("seed")))
    return out


def document_seeds(docs: DataFrame, long: bool, some: bool, short: list[int]) -> DataFrame:
    """DOCUMENT, position and seed of every seed of a document that an item could have."""
    position = F.col("position")
    kinds = [*(masked(position) if long else []), *([run_of(position, END, WINDOW)] if some else []), *[run_of(position, k, k) for k in short]]
    least = min([*([SPAN] if long else []), *([END] if some else []), *short])
    placed = docs.where(F.size("tokens") >= least).select("*", F.explode(F.sequence(F.lit(0), F.size("tokens") - least)).alias("position"))
    return placed.select(*DOCUMENT, "position", F.explode(F.array(*kinds)).alias("seed")).where(F.col("seed").isNotNull())


def _sent(df: DataFrame, bytes_: int, most: int) -> DataFrame:
    return F.broadcast(df) if bytes_ <= most else df


def _found(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, chunk: int, least_tokens: int, most_sent: int) -> DataFrame:
    """Verified overlaps, one row for each document and item: DOCUMENT, item_id, doc_start, matched, item_tokens, best_window."""
    items = benchmark.select(F.col("item_id").cast("long"), tokens(F.col("text")).alias("tokens")).where(F.size("tokens") >= least_tokens).distinct()
    # Numbered in a written table, as numbers depend on how it is dealt.
    items = materialize(spark, items.withColumn("item", F.monotonically_increasing_id()), "items")
    n = F.size("tokens")
    facts = items.select(F.coalesce(F.sum(n.cast("long")), F.lit(0)).alias("all"), F.coalesce(F.max(n) >= WINDOW, F.lit(False)).alias("long"), F.coalesce(F.bool_or((n >= SOME) & (n < WINDOW)), F.lit(False)).alias("some"), F.collect_set(F.when(n < SOME, n)).alias("short")).first()
    shape = "doc_id long, item_id long, doc_start long, matched long, item_tokens long, best_window long"
    if not facts["all"]:
        return spark.createDataFrame([], "nameless boolean, id long, text_key binary, " + shape).drop("doc_id")
    short = sorted(facts["short"])
    seeds = materialize(spark, item_seeds(items, short), "seeds")
    chunks = max(1, -(-seeds.count() // chunk))
    # The row number keeps the projection apart from the filter above it, which would else cut each text into tokens again.
    held = docs.select(*document_key(), tokens(F.col("text")).alias("tokens"), F.monotonically_increasing_id().alias("row")).where("row >= 0")
    placed = document_seeds(held, facts["long"], facts["some"], short)
    hits = None
    for i in range(chunks):
        part = seeds.where(F.pmod(F.xxhash64("seed", "item", "place"), F.lit(chunks)) == i)
        met = placed.join(F.broadcast(part), "seed").select(*DOCUMENT, "item", (F.col("position") - F.col("place")).alias("start"))
        hits = met if hits is None else hits.unionByName(met)
    hits = materialize(spark, hits.distinct(), "hits")

    hit = materialize(spark, hits.select(*DOCUMENT).distinct(), "hit-documents")
    texts = docs.select(*document_key(), "text").join(_sent(hit, 40 * hit.count(), most_sent), DOCUMENT, "left_semi")
    texts = texts.groupBy(*DOCUMENT).agg(F.first("text").alias("text")).select(*DOCUMENT, tokens(F.col("text")).alias("held"))
    pairs = hits.join(_sent(items.withColumnRenamed("tokens", "own"), 8 * facts["all"], most_sent), "item").join(texts, DOCUMENT)
    start, size = F.col("start"), F.size("own")
    part = F.slice("held", F.greatest(start, F.lit(0)) + 1, size + F.least(start, F.lit(0)))
    agree = lambda held: F.transform("own", lambda x, i: F.coalesce(x == F.get(held, i + F.least(start, F.lit(0))), F.lit(False)).cast("int"))
    window = F.least(size, F.lit(WINDOW))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    best = lambda a: F.array_max(F.transform(F.sequence(F.lit(0), F.size(a) - window), lambda i: total(F.slice(a, i + 1, window))))
    # In arrays of one, so that slice and comparison are made once and not for each token and window.
    told = F.transform(F.transform(F.array(part), agree), lambda a: F.struct(best(a).alias("best_window"), total(a).alias("matched"), (-start).alias("early")))
    rank = told[0]
    top = pairs.select(*DOCUMENT, "item", "item_id", size.alias("item_tokens"), rank.alias("rank")).groupBy(*DOCUMENT, "item", "item_id", "item_tokens").agg(F.max("rank").alias("top"))
    needed = F.when(F.col("item_tokens") >= WINDOW, NEEDED).when(F.col("item_tokens") >= SOME, F.col("item_tokens") - 1).otherwise(F.col("item_tokens"))
    top = top.where(F.col("top.best_window") >= needed)
    return top.select(*DOCUMENT, "item_id", (-F.col("top.early")).cast("long").alias("doc_start"), *[F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("top.matched", "item_tokens", "top.best_window")])


def overlaps(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, chunk: int = SEEDS_A_CHUNK, least_tokens: int = LEAST_TOKENS, most_sent: int = MOST_SENT) -> DataFrame:
    """Verified overlaps; returns doc_id, item_id, doc_start, matched, item_tokens, best_window.

    One row for each document and item: the alignment with the best window, then the most matching tokens, then
    the earliest start (in tokens, negative when the item's begin is cut off). Rows that agree in id and text are one document or item, and
    give one result; null ids are ids like others. Null texts and texts without tokens overlap with nothing;
    items under `least_tokens` tokens say too little and are not looked for. Either table may be empty. Other columns are ignored.
    """
    found = _found(spark, docs, benchmark, chunk, least_tokens, most_sent)
    return found.select(F.when(~F.col("nameless"), F.col("id")).alias("doc_id"), *found.columns[len(DOCUMENT) :])


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """The documents that overlap with no item, with all their columns and as often as they occur, with or without an id."""
    own = [f"_{c}" for c in DOCUMENT]
    gone = _found(spark, docs, benchmark, SEEDS_A_CHUNK, least_tokens, MOST_SENT).select(*DOCUMENT).distinct()
    gone = materialize(spark, gone.toDF(*own), "contaminated")
    keyed = docs.withColumns(dict(zip(own, document_key(), strict=True)))
    return keyed.join(_sent(gone, 40 * gone.count(), MOST_SENT), own, "left_anti").select(*docs.columns)
