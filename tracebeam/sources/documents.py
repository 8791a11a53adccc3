"""Whole-document and line readers shared by the sources.

A *document* row is ``path, value`` with the text of one file; a *line* row adds the dense position
of the line in its file. Parsers take such frames, so they work on any table that has them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebeam.operators.skew import running_total

LIST_OR_EVENTS = "events"


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file; YAML files are turned into JSON text in the tasks."""
    docs = (
        spark.read.text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    is_yaml = F.col("path").rlike(r"\.ya?ml$")
    return docs.where(~is_yaml).unionByName(yaml_to_json(docs.where(is_yaml)))


def yaml_to_json(docs: DataFrame) -> DataFrame:
    """YAML document rows as JSON document rows."""

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("reading YAML files needs the yaml package; use JSON") from missing
        for batch in batches:
            yield batch.assign(
                value=batch["value"].map(lambda t: json.dumps(yaml.safe_load(t), default=str))
            )

    return docs.mapInPandas(convert, schema=docs.schema)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files with their position; large files are split over tasks.

    Line numbers are counted per file block and carried from block to block, so order holds
    whatever task read the block.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
        F.monotonically_increasing_id().alias("line_id"),
    )
    return running_total(
        lines, ["path"], ["line_id"], F.lit(1).cast("bigint"), "pos", block=F.col("start")
    ).select("path", "modified_at", "pos", "value")


def file_stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def record_array(value: Column, record: str, key: str) -> Column:
    """Array of records from a JSON list, or from an object holding the list under ``key``."""
    is_list = F.regexp_like(value, F.lit(r"^\s*\["))
    return F.when(is_list, F.from_json(value, f"array<{record}>")).otherwise(
        F.from_json(value, f"struct<{key}: array<{record}>>")[key]
    )
