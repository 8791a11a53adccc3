"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebeam.plans.views import Tables, with_views
from tracebeam.session import configure

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under the function's name; ``sql`` may use the views of ``views.py``."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[build.__name__] = build
        if sql is not None:
            SQL[build.__name__] = with_views(sql)
        return build

    return register


def zoneless(df: DataFrame) -> DataFrame:
    """UTC instants as zone-less times, the form the benchmark tables use."""
    stamps = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in stamps})


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return zoneless(QUERIES[name](Tables(configure(spark), sf_dir)))


def load() -> None:
    """Import every module that registers queries."""
    from tracebeam.plans import causality, code, files, finance, memory, stored, streams, texts  # noqa: F401
