"""A corpus pipeline of five stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracebeam.llm import decontam, mixing, near_dup, quality, sharding
from tracebeam.llm.common import table
from tracebeam.session import configure, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents outside the fences of their language and source."""
    configure(spark)
    return quality.quality_stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each near-duplicate component (five words, 0.8)."""
    configure(spark)
    return near_dup.near_dup_stage(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold too much of the benchmark."""
    return decontam.decontaminate_stage(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Use each source as often as the temperature mix wants it."""
    configure(spark)
    return mixing.mixing_stage(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put every row into a shard and slot."""
    configure(spark)
    return sharding.shard(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
    ("sharding", shards),
]

#: no SQL: signatures, a learned order and iterations; compared with a brute-force run in the tests
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
