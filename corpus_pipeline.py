"""The corpus pipeline: toxicity, exact dedup, near-dedup, benchmark decontamination and packing, one stage after another.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of `documents`. Stages are meant to be written as Parquet and read again as the next one's docs; `run` does so
below the shared folder, and deletes what earlier stages have put there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from neargrid.llm import exact_dedup, order_minhash, packing, tiling, toxicity
from neargrid.llm.common import stage
from neargrid.sources.staging import clear, mark


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted to be toxic by their nearest labelled neighbours among docs."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that differ in white space only."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return order_minhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item leaks into."""
    return tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Toxicity, near-dedup and packing cannot be written in SQL; a test holds `run` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begun = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
        clear(spark, begun, keep=1)  # all but the stage's result
    return STAGES[-1][1](spark, docs, sf_dir)
