"""Runtime tables: union of event kinds, per-service events, counts, incident lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracebeam.functions.scores import is_shift, shift_confidence, shift_ratio
from tracebeam.functions.texts import log_signature, signature_hash
from tracebeam.functions.times import between_times, instant, shift
from tracebeam.operators.skew import asof_join, first_per_key

RUNTIME_LABELS = ("Service", "Deployment", "MetricShift", "LogSignature", "Incident")
CODE_LABELS = ("Repo", "File", "Function", "Class", "Symbol")


def scope(df: DataFrame, **keys: str | None) -> DataFrame:
    """Filter by the given keys; a key that is None does not filter."""
    for name, value in keys.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def resolve_id(df: DataFrame, key: str, wanted: str) -> DataFrame:
    """The row whose id is, or starts with, ``wanted`` (an id or its first characters)."""
    return df.where(F.startswith(F.col(key), F.lit(wanted))).orderBy(key).limit(1)


def all_events(
    deployments: DataFrame, metric_shifts: DataFrame, log_signatures: DataFrame
) -> DataFrame:
    """The three kinds of possible causes as one table with the fields each kind has."""
    deploys = deployments.select(
        F.lit("Deployment").alias("kind"), "env_key", F.col("deployment_id").alias("event_key"),
        "at", "service_name", "deployment_id", "commit_sha",
    )
    shifts = metric_shifts.select(
        F.lit("MetricShift").alias("kind"), "env_key",
        F.concat_ws(
            "/", "service_name", "metric", F.unix_micros("started_at").cast("string")
        ).alias("event_key"),
        F.col("started_at").alias("at"), "service_name", "metric", "before", "after", "unit",
    )
    logs = log_signatures.select(
        F.lit("LogSignature").alias("kind"), "env_key",
        F.concat_ws("/", "service_name", "signature_hash").alias("event_key"),
        F.col("first_seen_at").alias("at"), "service_name", "signature", "signature_hash",
        "count", "level",
    )
    return deploys.unionByName(shifts, allowMissingColumns=True).unionByName(
        logs, allowMissingColumns=True
    )


def number_text(name: str) -> Column:
    return F.col(name).cast("string")


def describe_event() -> Column:
    """One-line description of a service event."""
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    sha = F.when(text("commit_sha") != "", F.concat(F.lit(" (sha: "), "commit_sha", F.lit(")")))
    note = F.when(text("description") != "", F.concat(F.lit(" - "), "description"))
    blank = F.lit("")
    change = F.when(
        F.col("before").isNotNull() & F.col("after").isNotNull(),
        F.concat(
            text("metric"), F.lit(": "), number_text("before"), text("unit"), F.lit(" -> "),
            number_text("after"), text("unit"),
        ),
    ).otherwise(F.concat(text("metric"), F.lit(" shifted")))
    return (
        F.when(
            F.col("kind") == "deployment",
            F.concat(
                F.lit("Deployment "), text("id"), F.coalesce(sha, blank), F.coalesce(note, blank)
            ),
        )
        .when(
            F.col("kind") == "metric_shift",
            F.coalesce(F.nullif(F.col("description"), blank), change),
        )
        .when(
            F.col("kind") == "log_signature",
            F.concat(
                F.lit('Log: "'), text("signature"), F.lit('" (count='),
                F.coalesce(F.nullif(number_text("count"), F.lit("0")), blank), F.lit(")"),
            ),
        )
        .when(
            F.col("kind") == "incident",
            F.coalesce(F.nullif(F.col("title"), blank), F.col("id"), F.lit("incident")),
        )
    )


def event_detail() -> Column:
    """Table-cell detail of a service event, parts joined by a middle dot."""
    shown = lambda name: F.nullif(F.col(name), F.lit(""))
    unit = F.coalesce("unit", F.lit(""))
    signature = F.coalesce("signature", F.lit(""))
    clipped = F.when(F.length(signature) < 80, signature).otherwise(
        F.concat(F.substring(signature, 1, 77), F.lit("…"))
    )
    change = F.concat(number_text("before"), unit, F.lit(" → "), number_text("after"), unit)
    tag = lambda left, name, right="": F.concat(F.lit(left), shown(name), F.lit(right))
    return (
        F.when(
            F.col("kind") == "deployment",
            F.concat_ws(
                " · ", F.concat(F.lit("deploy_id="), "id"),
                F.concat(F.lit("commit="), F.substring(shown("commit_sha"), 1, 12)),
                shown("description"),
            ),
        )
        .when(
            F.col("kind") == "metric_shift",
            F.concat_ws(" · ", F.coalesce(shown("metric"), F.lit("?")), change, shown("description")),
        )
        .when(
            F.col("kind") == "log_signature",
            F.concat_ws(
                " · ", clipped,
                F.when(F.col("count") > 0, F.concat(F.lit("x"), number_text("count"))),
                tag("[", "level", "]"),
            ),
        )
        .when(
            F.col("kind") == "incident",
            F.concat_ws(
                " · ", F.concat(F.lit("id="), "id"), F.coalesce("title", F.lit("")),
                tag("sev=", "severity"),
            ),
        )
    )


EVENT_FIELDS = (
    "id", "description", "commit_sha", "metric", "before", "after", "unit", "signature", "count",
    "level", "title", "severity",
)


def service_events(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every runtime event with the service it belongs to, in one shape.

    ``tables`` has deployments, metric_shifts, log_signatures and incidents. ``kind_order`` and
    ``sort_id`` break ties between events of the same instant.
    """
    incidents = tables["incidents"].withColumn(
        "service_name", F.explode(F.array_distinct("affected_services"))
    )
    parts = [
        tables["deployments"].select(
            F.lit("deployment").alias("kind"), F.lit(1).alias("kind_order"), "env_key",
            "service_name", "at", F.col("deployment_id").alias("id"), "description", "commit_sha",
            F.col("deployment_id").alias("sort_id"),
        ),
        tables["metric_shifts"].select(
            F.lit("metric_shift").alias("kind"), F.lit(2).alias("kind_order"), "env_key",
            "service_name", F.col("started_at").alias("at"), "metric", "before", "after", "unit",
            "description", F.col("metric").alias("sort_id"),
        ),
        tables["log_signatures"].select(
            F.lit("log_signature").alias("kind"), F.lit(3).alias("kind_order"), "env_key",
            "service_name", F.col("first_seen_at").alias("at"), "signature", "count", "level",
            F.col("signature_hash").alias("sort_id"),
        ),
        incidents.select(
            F.lit("incident").alias("kind"), F.lit(4).alias("kind_order"), "env_key",
            "service_name", F.col("detected_at").alias("at"), "id", "title", "severity",
            F.col("id").alias("sort_id"),
        ),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union.where(F.col("at").isNotNull())


TIME_ORDER = ("at", "kind_order", "sort_id")


def events_for_service(
    tables: Mapping[str, DataFrame],
    env_key: str | None = None,
    service: str | None = None,
    since=None,
    until=None,
    limit: int | None = None,
) -> DataFrame:
    """Events of one service, or of each; with ``limit`` the first so many per service, ranked in
    time order.
    """
    events = scope(service_events(tables), env_key=env_key, service_name=service)
    events = between_times(events, "at", since, until)
    if limit is None:
        return events
    order = [F.asc(c) for c in TIME_ORDER]
    return first_per_key(events, ["env_key", "service_name"], order, limit, rank="rank")


def _label_counts(frames: Mapping[str, DataFrame], key: str, value: str | None) -> DataFrame:
    """Rows per label; a label without rows counts zero."""
    parts = []
    for label, df in frames.items():
        kept = scope(df, **{key if key in df.columns else "key": value})
        parts.append(kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def runtime_stats(frames: Mapping[str, DataFrame], env_key: str | None = None) -> DataFrame:
    return _label_counts(frames, "env_key", env_key)


def code_stats(frames: Mapping[str, DataFrame], repo_key: str | None = None) -> DataFrame:
    return _label_counts(frames, "repo_key", repo_key)


def list_envs(*frames: DataFrame) -> DataFrame:
    """Distinct environment keys in order."""
    union = frames[0].select("env_key")
    for df in frames[1:]:
        union = union.unionByName(df.select("env_key"))
    return union.distinct().orderBy("env_key")


def list_repos(repos: DataFrame, files: DataFrame) -> DataFrame:
    """Repositories with their file counts, newest index first."""
    counts = files.groupBy("repo_key").agg(F.count("path").alias("files"))
    return (
        repos.join(counts, repos["key"] == counts["repo_key"], "left")
        .drop("repo_key")
        .na.fill(0, ["files"])
        .orderBy(F.desc("indexed_at"), F.asc("key"))
    )


def list_incidents(incidents: DataFrame, env_key: str | None = None) -> DataFrame:
    """Incidents newest first with the services they affected."""
    return (
        scope(incidents, env_key=env_key)
        .select(
            "id", "env_key", "title", "severity", "detected_at", "resolved_at",
            F.array_sort(F.array_distinct("affected_services")).alias("services"),
        )
        .orderBy(F.desc("detected_at"), F.asc("id"))
    )


def link_runs(services: DataFrame, files: DataFrame) -> DataFrame:
    """Service -> file edges for the listed paths that exist in the service's repository."""
    listed = services.select("env_key", "name", "repo_key", F.explode("file_paths").alias("path"))
    return listed.distinct().join(files.select("repo_key", "path"), ["repo_key", "path"], "left_semi")


def link_shipped(deployments: DataFrame, commits: DataFrame) -> DataFrame:
    """Deployment -> commit edges where the commit is known."""
    wanted = deployments.select(
        "env_key", "deployment_id", F.col("commit_sha").alias("sha")
    ).where(F.col("sha").isNotNull())
    return wanted.join(commits.select("sha").distinct(), "sha", "left_semi")


def metric_as_of(samples: DataFrame, as_of, offsets: Mapping[str, float]) -> DataFrame:
    """Last sample value at or before several instants, per service and metric, in one pass.

    ``offsets`` maps an output column to the seconds before ``as_of`` it looks at.
    """
    def last_value(seconds: float) -> Column:
        seen = F.col("ts") <= shift(instant(as_of), -seconds)
        return F.max_by(F.when(seen, F.col("value")), F.when(seen, F.col("ts")))

    return samples.groupBy("env_key", "service_name", "metric").agg(
        *[last_value(seconds).alias(name) for name, seconds in offsets.items()]
    )


def metrics_at_incidents(
    incidents: DataFrame, samples: DataFrame, offsets: Mapping[str, float]
) -> DataFrame:
    """Per incident, affected service and metric the last sample at or before instants of its own.

    ``offsets`` maps an output column to the seconds before the detection it looks at. Metrics of a
    service without a sample early enough give null.
    """
    hit = incidents.select(
        F.col("id").alias("incident_id"), "env_key", "detected_at",
        F.explode(F.array_distinct("affected_services")).alias("service_name"),
    )
    series = samples.select("env_key", "service_name", "metric").distinct()
    at = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), shift(F.col("detected_at"), -seconds).alias("wanted_at"))
        for name, seconds in offsets.items()
    ]))
    keys = ["env_key", "service_name", "metric"]
    probes = hit.join(series, ["env_key", "service_name"]).select(*keys, "incident_id", at.alias("e")).select(
        *keys, "incident_id", "e.name", "e.wanted_at"
    )
    found = asof_join(probes, samples, keys, "wanted_at", "ts", ["value"])
    return found.groupBy("incident_id", *keys).agg(
        *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in offsets]
    )


def metric_shifts(
    samples: DataFrame,
    as_of,
    threshold: float = 1.5,
    baseline_seconds: float = 300,
    current_seconds: float = 60,
) -> DataFrame:
    """Metrics whose value left the band around the value ``baseline_seconds`` earlier."""
    points = metric_as_of(samples, as_of, {"before": baseline_seconds, "after": 0.0})
    ratio = shift_ratio(F.col("before"), F.col("after"))
    return (
        points.withColumn("ratio", ratio)
        .where(is_shift(F.col("ratio"), threshold))
        .withColumn("started_at", shift(instant(as_of), -current_seconds))
        .withColumn("ended_at", instant(as_of))
        .withColumn("confidence", shift_confidence(F.col("ratio")))
        .withColumn(
            "description",
            F.format_string(
                f"%s shifted %.2fx (%.3f -> %.3f) over {current_seconds:g}s window",
                "metric", "ratio", "before", "after",
            ),
        )
    )


def cluster_logs(
    lines: DataFrame,
    level: str = "error",
    lookback: float = 300,
    limit: int | None = None,
    as_of=None,
) -> DataFrame:
    """Log lines of the look-back grouped by redacted signature per service.

    With ``limit`` only the newest so many matching lines of each service take part.
    """
    matching = lines.where(F.col("message").rlike(f"(?i){level}"))
    if as_of is not None:
        since = shift(instant(as_of), -lookback)
        matching = matching.where(F.col("ts").between(since, instant(as_of)))
    if limit is not None:
        matching = first_per_key(
            matching, ["env_key", "service_name"], [F.desc("ts"), F.asc("message")], limit
        )
    grouped = matching.groupBy(
        "env_key", "service_name", log_signature(F.col("message")).alias("signature")
    ).agg(
        F.count(F.lit(1)).alias("count"),
        F.min("ts").alias("first_seen_at"),
        F.max("ts").alias("last_seen_at"),
    )
    return (
        grouped.withColumn("signature_hash", signature_hash(F.col("signature")))
        .withColumn("level", F.lit(level))
        .withColumn("confidence", F.least(F.lit(1.0), F.col("count") / 10.0))
    )
