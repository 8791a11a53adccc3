"""Registered queries of the corpus operators: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebeam.llm import (
    decontam, fim, html_text, lm_score, mixing, near_dup, ngram_join, pii, quality, sharding, tokens, toxicity,
    vafile,
)
from tracebeam.llm.common import table

CONTRACT_SHINGLE = 4
# share of the highest entropy that op10 asks for: above what the tables have by themselves
MIX_ENTROPY = 0.998


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"
    )
    return toxicity.toxicity(documents(spark, sf_dir), labels, ("low_quality", "toxic"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), CONTRACT_SHINGLE)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir), order=lm_score.ORDER)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir), MIX_ENTROPY)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.clustered(table(spark, sf_dir, "embeddings"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(documents(spark, sf_dir))


OPERATORS = (
    op1_sharding, op2_personal_data, op3_html_text, op4_decontamination, op5_toxicity,
    op6_quality_rules, op7_near_duplicates, op8_token_counts, op9_lm_score, op10_mixing,
    op11_centroids, op12_ngram_join, op13_fill_in_middle,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: partial(f) for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    from tracebeam.llm.oracle import SQL

    return dict(SQL)
