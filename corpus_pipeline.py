"""From documents to packed sequences: toxicity, near-duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir); docs are what the stage before it kept, as written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strataq.llm import common, decontam, minhash, packing, secret_scan, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine doesn't call toxic; it learns from their labels. Each row is judged, with or without an id."""
    return toxicity.reject(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by the sets and the threshold of op4; rows without an id stay."""
    return minhash.deduplicate(docs, width=4)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; a single one is enough to go."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a secret; each row is judged, with or without an id."""
    return secret_scan.remove(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of sequences."""
    return packing.sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secret_scan", drop_secrets),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again by the next.

    Null and empty texts pass all filters and are packed as the end mark alone; repeated rows are judged and, but for
    near-duplicates, kept each for itself; an empty table gives an empty one. What a stage wrote goes when the next has written.
    """
    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, common.settle(stage(spark, docs, sf_dir))
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
