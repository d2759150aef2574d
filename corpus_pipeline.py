"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeledger.llm import decontam, ngram_join, packing, pii, toxicity
from treeledger.llm.common import discard, mark, materialize, release, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. The lexicon is weighted on the labelled rows of what comes in.

    Null and empty texts hold nothing toxic and stay; rows that repeat or have no id are judged like others; of an empty table nothing stays.
    """
    return toxicity.reject(spark, docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more, the smallest doc_id stays.

    Documents without words are linked with nothing and stay. Rows of one doc_id with different texts are different documents, equal rows
    are one; a document without an id comes after those with one. An empty table stays empty.
    """
    return ngram_join.keep_one(spark, docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go, with or without an id. Null and empty texts overlap with nothing; either table may be empty."""
    return decontam.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, as often as it occurs; personal data in its text is replaced by its kind. Null texts stay null."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 4096 tokens; a null or empty text is one piece that holds the end id."""
    import public_tokenizers

    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack),
]

#: No SQL: tokenizer, trained models and packing are outside what SQL can express. tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`. A stage's scratch tables and its input are deleted once its output is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = mark(spark)
        held, docs = docs, materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, before, keep=docs)
        if name != STAGES[0][0]:
            discard(spark, held)
    return docs
