"""Evaluation corpora, baselines, snapshots and finding reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracebeam import schemas
from tracebeam.operators.drift import SEVERITY_RANK, severity_rank
from tracebeam.operators.skew import numbered
from tracebeam.operators.tables import read_stored, replace_scopes
from tracebeam.sources.documents import file_stem, read_documents

# Report levels, headings and icons per severity.
SARIF_LEVEL = {"critical": "error", "error": "error", "warning": "warning", "note": "note"}
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
SARIF_VERSION = "2.1.0"
TIERS = {
    "critical": ("🚨", "Critical"),
    "error": ("❌", "Errors"),
    "warning": ("⚠️", "Warnings"),
    "note": ("ℹ️", "Notes"),
}
FINDINGS_PER_PART = 5000
TOOL_NAME = "tracebeam"


def parse_eval_corpus(docs: DataFrame) -> DataFrame:
    """Cases of corpus documents (path, value)."""
    schema = (
        "struct<name: string, repo_key: string, cases: array<struct<question: string, "
        "expected_any: array<string>, notes: string>>>"
    )
    d = F.from_json("value", schema)
    return docs.select(
        F.coalesce(d["name"], file_stem(F.col("path"))).alias("corpus"),
        d["repo_key"].alias("repo_key"), F.posexplode(d["cases"]).alias("query_id", "c"),
    ).select(
        "corpus", "repo_key", F.col("query_id").cast("bigint").alias("query_id"), "c.question",
        "c.expected_any", F.coalesce("c.notes", F.lit("")).alias("notes"),
    )


def read_eval_corpus(spark: SparkSession, path: str) -> DataFrame:
    return parse_eval_corpus(read_documents(spark, path))


BASELINE = (
    "captured_at timestamp, caller string, callee string, file_path string, line int, "
    "repo_key string"
)


def write_baseline(edges: DataFrame, path: str, repos: DataFrame | None = None) -> None:
    """Replace the stored baseline of ``repos`` (repo_key); those of other repositories stay.

    A repository listed without edges ends up with an empty baseline; without the list only the
    repositories present in ``edges`` are replaced.
    """
    captured = edges if repos is None else repos
    replace_scopes(edges, path, captured.select("repo_key"), ["repo_key"])


def read_baseline(spark: SparkSession, path: str, repo_key: str | None = None) -> DataFrame:
    """Stored baseline; a missing one is empty, so every edge then counts as new."""
    stored = read_stored(spark, path, StructType.fromDDL(BASELINE))
    return stored if repo_key is None else stored.where(F.col("repo_key") == repo_key)


def write_snapshots(
    df: DataFrame, path: str, by: str = "incident_id", entities: DataFrame | None = None
) -> None:
    """JSON results, one folder per entity.

    ``df`` is the whole snapshot: folders of entities it no longer has go. With ``entities`` (column
    ``by``) only theirs are replaced, also by nothing, and those of others stay as they are.
    """
    if entities is not None:
        replace_scopes(df, path, entities.select(by), [by], "json")
        return
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(by).json(path)


def _in_parts(findings: DataFrame, per_part: int) -> DataFrame:
    """Number the findings by severity, rule and message and cut them into parts."""
    ranked = findings.withColumn("_rank", -severity_rank(F.col("severity"))).withColumn(
        "_extra", F.concat_ws("|", "file_path", "caller", "callee", "incident_id")
    )
    placed = numbered(ranked, ["_rank", "rule_id", "message", "_extra"], "position")
    return placed.withColumn("part", F.floor((F.col("position") - 1) / per_part))


def _extra() -> Column:
    """Properties of a finding besides its message; absent ones are left out."""
    return F.struct(
        F.when(F.size("derivation") > 0, F.col("derivation")).alias("derivation"),
        "caller", "callee", "boundary_name", "raw_severity", "incident_id",
    )


#: rule id -> what the rule reports, in short and at length
RULES = {
    "drift/boundary_violation": (
        "Declared boundary broken",
        "Code on one side of a declared boundary now depends on the other side. The boundary is a rule of the team.",
    ),
    "drift/new_dependency": (
        "Dependency added", "A call that the stored baseline does not know. Compare it with the purpose of the change.",
    ),
    "drift/removed_dependency": (
        "Dependency gone", "A call of the stored baseline is no longer there. Make sure that nothing was lost with it.",
    ),
    "incident/recent-cause": (
        "Probable cause of a recent incident", "The event that explains an incident of the last days best, with its score.",
    ),
}


def rule_descriptor(rule: Column) -> Column:
    """Descriptor of a rule; one without an entry has its id alone."""
    text = lambda k: F.create_map(*[F.lit(x) for r, texts in RULES.items() for x in (r, texts[k])])
    described = lambda k: F.when(
        F.try_element_at(text(k), rule).isNotNull(), F.struct(F.try_element_at(text(k), rule).alias("text"))
    )
    return F.struct(
        rule.alias("id"), described(0).alias("shortDescription"), described(1).alias("fullDescription")
    )


def findings_to_sarif(
    findings: DataFrame, report: DataFrame, per_part: int = FINDINGS_PER_PART
) -> DataFrame:
    """SARIF documents of at most ``per_part`` results each (part, sarif).

    ``report`` is the one-row result of ``quality_gate`` with repo_key and started_at added. A
    report of any size is written as several complete documents, never gathered in one task.
    """
    level = F.coalesce(
        *[F.when(F.col("severity") == s, F.lit(v)) for s, v in SARIF_LEVEL.items()]
    )
    place = F.array(
        F.struct(
            F.struct(
                F.struct(F.coalesce("file_path", F.lit(".")).alias("uri")).alias("artifactLocation"),
                F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine"))).alias("region"),
            ).alias("physicalLocation")
        )
    )
    result = F.struct(
        F.col("rule_id").alias("ruleId"), level.alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"),
        _extra().alias("properties"),
    )
    parts = _in_parts(findings, per_part).groupBy("part").agg(
        F.array_sort(F.collect_list(F.struct("position", result.alias("r")))).alias("rows"),
        F.array_sort(F.collect_set("rule_id")).alias("rules"),
    )
    # the report is a single row, so it goes into the documents as literals
    row = report.select("passed", "gate", "repo_key", "started_at", *SEVERITY_RANK).first()
    counts = F.struct(*[F.lit(row[s]).alias(s) for s in SEVERITY_RANK])
    started = F.date_format(F.lit(row["started_at"]).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    run = F.struct(
        F.struct(
            F.struct(
                F.lit(TOOL_NAME).alias("name"),
                F.transform("rules", rule_descriptor).alias("rules"),
            ).alias("driver")
        ).alias("tool"),
        F.array(
            F.struct(
                F.lit(row["passed"]).alias("executionSuccessful"),
                started.alias("startTimeUtc"),
                F.lit(0 if row["passed"] else 1).alias("exitCode"),
                F.struct(
                    F.lit(row["gate"]).alias("gate"), F.lit(row["repo_key"]).alias("repo_key")
                ).alias("properties"),
            )
        ).alias("invocations"),
        F.transform("rows", lambda x: x["r"]).alias("results"),
        counts.alias("properties"),
    )
    document = F.struct(
        F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version"),
        F.array(run).alias("runs"),
    )
    return parts.select("part", F.to_json(document).alias("sarif"))


def findings_to_markdown(
    findings: DataFrame, report: DataFrame, per_part: int = FINDINGS_PER_PART
) -> DataFrame:
    """Markdown digest by severity tier (part, markdown); each part repeats the header."""
    icon = F.create_map(*[F.lit(x) for s, (i, _) in TIERS.items() for x in (s, i)])
    title = F.create_map(*[F.lit(x) for s, (_, t) in TIERS.items() for x in (s, t)])
    anchor = F.when(F.col("line") > 0, F.concat(F.lit("#L"), F.col("line").cast("string"))).otherwise("")
    bullet = F.concat(
        F.lit("- **`"), "rule_id", F.lit("`** — "), "message",
        F.when(
            F.col("file_path").isNotNull(),
            F.concat(F.lit("  (`"), "file_path", anchor, F.lit("`)")),
        ).otherwise(""),
    )
    detail = lambda name: F.when(
        F.col(name) != "", F.concat(F.lit(f"  - **{name}**: `"), F.col(name), F.lit("`"))
    )
    trail = F.when(
        F.size("derivation") > 0,
        F.concat(F.lit("  - _derivation:_ "), F.array_join(F.filter("derivation", lambda d: d != ""), "; ")),
    )
    text = F.concat_ws(
        "\n", bullet, trail, *[detail(n) for n in ("caller", "callee", "boundary_name", "incident_id")]
    )
    tiers = _in_parts(findings, per_part).groupBy("part", "severity").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("position", text.alias("text")))).alias("rows"),
    )
    block = F.concat(
        F.lit("<details><summary>"), icon[F.col("severity")], F.lit(" "), F.col("n").cast("string"),
        F.lit(" "), title[F.col("severity")], F.lit("</summary>\n\n"),
        F.array_join(F.transform("rows", lambda r: r["text"]), "\n"), F.lit("\n</details>\n"),
    )
    parts = tiers.groupBy("part").agg(
        F.array_sort(
            F.collect_list(F.struct((-severity_rank(F.col("severity"))).alias("o"), block.alias("b")))
        ).alias("blocks")
    )
    row = report.select("passed", "gate", "repo_key", "total", *SEVERITY_RANK).first()
    counts = " · ".join(f"{mark} {row[s]} {name.lower()}" for s, (mark, name) in TIERS.items())
    badge = "✅ **passed**" if row["passed"] else "❌ **failed**"
    head = (
        f"## Scan report\n\nGate `{row['gate']}` — {badge}\n\n{counts}\n\n"
        f"Repo: `{row['repo_key']}` · {row['total']} finding(s)\n\n"
    )
    body = F.array_join(F.transform("blocks", lambda b: b["b"]), "\n")
    return parts.select("part", F.concat(F.lit(head), body).alias("markdown"))
