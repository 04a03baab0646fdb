"""The corpus pipeline: documents without toxic ones, near copies and benchmark leaks, mixed by source and dealt into shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkfrontier.llm import chosen_path, decontamination, mixing, sharding, toxicity
from sparkfrontier.llm.common import stage_out, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score toxicity.PASS or more go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return chosen_path.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their shard and slot."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", join_near_copies),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix),
    ("sharding", shard),
]

#: Random rounding and learned scores have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_out(stage(spark, docs, sf_dir), f"pipeline-{name}", rebalance=False)
    return STAGES[-1][1](spark, docs, sf_dir)
