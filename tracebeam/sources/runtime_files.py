"""Runtime-event files and postmortems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebeam import schemas
from tracebeam.functions.texts import signature_hash
from tracebeam.functions.times import parse_iso
from tracebeam.operators.skew import first_per_key
from tracebeam.sources.documents import file_name, read_documents, record_array

# Fields a record of each kind must have.
REQUIRED = {
    "service": ("name",),
    "deployment": ("deployment_id", "service_name"),
    "metric_shift": ("service_name", "metric"),
    "log_signature": ("service_name", "signature"),
    "incident": ("id", "title"),
}
TIME_FIELD = {
    "deployment": "at",
    "metric_shift": "started_at",
    "log_signature": "first_seen_at",
    "incident": "detected_at",
}
OPTIONAL_TIMES = ("ended_at", "last_seen_at", "resolved_at")


def _kind_table(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind with the columns and types of its table."""
    text = F.col
    number = lambda name: F.col(name).try_cast("double")
    columns: dict[str, list[Column]] = {
        "service": [text("name"), text("repo_key"),
                    F.coalesce("file_paths", F.array().cast("array<string>")).alias("file_paths")],
        "deployment": [text("deployment_id"), text("service_name"), parse_iso(text("at")).alias("at"),
                       text("commit_sha"), text("description")],
        "metric_shift": [text("service_name"), text("metric"),
                         parse_iso(text("started_at")).alias("started_at"),
                         parse_iso(text("ended_at")).alias("ended_at"),
                         number("before").alias("before"), number("after").alias("after"),
                         text("unit"), text("description")],
        "log_signature": [text("service_name"), text("signature"),
                          signature_hash(text("signature")).alias("signature_hash"),
                          parse_iso(text("first_seen_at")).alias("first_seen_at"),
                          parse_iso(text("last_seen_at")).alias("last_seen_at"),
                          F.coalesce(text("count").try_cast("bigint"), F.lit(1)).alias("count"),
                          text("level")],
        "incident": [text("id"), text("title"),
                     F.coalesce("severity", F.lit("unknown")).alias("severity"),
                     parse_iso(text("detected_at")).alias("detected_at"),
                     parse_iso(text("resolved_at")).alias("resolved_at"), text("summary"),
                     F.coalesce("affected_services", F.array().cast("array<string>")).alias("affected_services")],
    }
    return rows.where(F.col("kind") == kind).select(
        "env_key", "source", F.coalesce(number("confidence"), F.lit(1.0)).alias("confidence"),
        *columns[kind],
    )


def _is_valid() -> Column:
    """Known kind, required fields there, times and numbers readable, confidence in [0, 1]."""
    filled = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    readable = lambda name, good: F.col(name).isNull() | good.isNotNull()
    per_kind = F.lit(False)
    for kind, names in REQUIRED.items():
        ok = F.col("kind") == kind
        for name in names:
            ok = ok & filled(name)
        if kind in TIME_FIELD:
            ok = ok & parse_iso(F.col(TIME_FIELD[kind])).isNotNull()
        per_kind = per_kind | ok
    for name in OPTIONAL_TIMES:
        per_kind = per_kind & readable(name, parse_iso(F.col(name)))
    for name in ("before", "after", "confidence"):
        per_kind = per_kind & readable(name, F.col(name).try_cast("double"))
    per_kind = per_kind & readable("count", F.col("count").try_cast("bigint"))
    in_range = F.coalesce(F.col("confidence").try_cast("double"), F.lit(1.0)).between(0.0, 1.0)
    return F.coalesce(per_kind & in_range, F.lit(False))


def parse_runtime_events(
    docs: DataFrame, env_key: str | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables by kind, rejected records) of event documents.

    ``docs`` has path, value and, unless ``env_key`` is given, env_key. Bad records are set aside
    and the rest goes on.
    """
    env = F.lit(env_key) if env_key is not None else F.col("env_key")
    records = docs.select(
        env.alias("env_key"),
        F.concat(F.lit("file:"), file_name(F.col("path"))).alias("source"),
        F.explode(record_array(F.col("value"), schemas.EVENT_RECORD, "events")).alias("r"),
    ).select("env_key", "source", "r.*")
    checked = records.withColumn("_ok", _is_valid())
    good = checked.where("_ok").drop("_ok")
    return {k: _kind_table(good, k) for k in REQUIRED}, checked.where("NOT _ok").drop("_ok")


def read_runtime_events(spark: SparkSession, path: str, env_key: str) -> dict[str, DataFrame]:
    """Typed tables of the event files under ``path`` (JSON or YAML)."""
    return parse_runtime_events(read_documents(spark, path), env_key)[0]


def parse_postmortems(docs: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(incidents, timeline records) of postmortem documents.

    With ``strict`` the first bad timeline row fails the job and names its index; otherwise bad
    rows are left out. Unreadable before/after values become null.
    """
    schema = f"struct<incident: {schemas.INCIDENT_BLOCK}, timeline: array<{schemas.EVENT_RECORD}>>"
    parsed = docs.select("path", F.from_json("value", schema).alias("d")).select(
        "path", F.concat(F.lit("postmortem:"), file_name(F.col("path"))).alias("source"),
        F.col("d.incident").alias("i"), F.col("d.timeline").alias("timeline"),
    )
    incidents = parsed.select(
        F.col("i.env").alias("env_key"), "source", F.lit(1.0).alias("confidence"), "i.id", "i.title",
        F.coalesce("i.severity", F.lit("unknown")).alias("severity"),
        parse_iso(F.col("i.detected_at")).alias("detected_at"),
        parse_iso(F.col("i.resolved_at")).alias("resolved_at"), "i.summary",
        F.coalesce("i.affected_services", F.array().cast("array<string>")).alias("affected_services"),
    )
    rows = parsed.select(
        F.col("i.env").alias("env_key"), "source", "path", F.posexplode("timeline").alias("idx", "r")
    ).select("env_key", "source", "path", "idx", "r.*")
    # a timeline row names its service and time as ``service`` / ``at`` whatever its kind
    rows = rows.withColumn("service_name", F.coalesce("service", "service_name"))
    for name in ("started_at", "first_seen_at", "detected_at"):
        rows = rows.withColumn(name, F.coalesce("at", name))
    for name in ("before", "after"):
        rows = rows.withColumn(name, F.col(name).try_cast("double").cast("string"))
    ok = _is_valid()
    if strict:
        message = F.concat(
            F.col("path"), F.lit(": timeline["), F.col("idx").cast("string"), F.lit("] ("),
            F.coalesce("kind", F.lit("no kind")), F.lit(") is not valid"),
        )
        rows = rows.withColumn("kind", F.when(ok, F.col("kind")).otherwise(F.raise_error(message)))
    else:
        rows = rows.where(ok)
    return incidents, rows.drop("path", "service")


def timeline_to_tables(incidents: DataFrame, timeline: DataFrame) -> dict[str, DataFrame]:
    """Typed tables by kind; every service mentioned anywhere gets a row, a typed one if given."""
    tables = {k: _kind_table(timeline, k) for k in REQUIRED}
    all_incidents = incidents.unionByName(tables["incident"], allowMissingColumns=True)
    mentioned = (
        incidents.select("env_key", "source", F.explode("affected_services").alias("name"))
        .unionByName(
            timeline.where(F.col("service_name").isNotNull()).select(
                "env_key", "source", F.col("service_name").alias("name")
            )
        )
        .withColumn("confidence", F.lit(1.0))
    )
    stub = mentioned.withColumn("_typed", F.lit(0))
    typed = tables["service"].withColumn("_typed", F.lit(1))
    services = first_per_key(
        typed.unionByName(stub, allowMissingColumns=True),
        ["env_key", "name"], [F.desc("_typed"), F.asc("source")], 1,
    ).drop("_typed")
    return {**tables, "incident": all_incidents, "service": services}


def read_postmortems(
    spark: SparkSession, path: str, strict: bool = True
) -> tuple[DataFrame, DataFrame]:
    return parse_postmortems(read_documents(spark, path), strict)


def parse_metric_samples(docs: DataFrame) -> DataFrame:
    """Instant-query replies (service_name, metric, env_key, value JSON) to metric samples."""
    reply = (
        "struct<status: string, data: struct<result: array<struct<value: array<string>>>>>"
    )
    first = F.from_json("value", reply)
    point = F.try_element_at(first["data"]["result"], F.lit(1))["value"]
    epoch = F.try_element_at(point, F.lit(1)).try_cast("double")
    return docs.where(first["status"] == "success").select(
        "env_key", "service_name", "metric",
        F.timestamp_micros(F.round(epoch * 1_000_000).cast("bigint")).alias("ts"),
        F.try_element_at(point, F.lit(2)).try_cast("double").alias("value"),
    ).where(F.col("value").isNotNull())


def parse_log_streams(docs: DataFrame, service_label: str = "job") -> DataFrame:
    """Range-query replies (env_key, value JSON) to log lines; times are epoch nanoseconds."""
    reply = (
        "struct<status: string, data: struct<result: array<struct<stream: map<string,string>, "
        "values: array<array<string>>>>>>"
    )
    body = F.from_json("value", reply)
    streams = docs.where(body["status"] == "success").select(
        "env_key", F.explode(body["data"]["result"]).alias("s")
    )
    return streams.select(
        "env_key",
        F.coalesce(F.try_element_at("s.stream", F.lit(service_label)), F.lit("unknown")).alias("service_name"),
        F.explode("s.values").alias("v"),
    ).select(
        "env_key", "service_name",
        F.timestamp_micros(F.expr("CAST(v[0] AS BIGINT) DIV 1000")).alias("ts"),
        F.col("v")[1].alias("message"),
    )
