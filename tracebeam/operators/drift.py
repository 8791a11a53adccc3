"""Dependency drift against a baseline, scan findings and the quality gate."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracebeam.functions.texts import glob_match, glob_regexes, literal_prefix
from tracebeam.functions.times import instant
from tracebeam.operators.runtime import scope
from tracebeam.operators.skew import ROWS_PER_TASK, salted_join
from tracebeam.session import materialize

# Severities, ranks, gates and texts of findings.
SEVERITY_RANK = {"note": 0, "warning": 1, "error": 2, "critical": 3}
GATE_FLOOR = {"strict": "warning", "normal": "error", "lenient": "critical"}
DRIFT_TO_FINDING = {"critical": "error", "warning": "warning", "info": "note"}
DRIFT_ORDER = {"critical": 0, "warning": 1, "info": 2}


class Boundary(NamedTuple):
    """Callers matching ``source_pattern`` must not depend on ``forbidden_pattern`` (globs)."""

    name: str
    source_pattern: str
    forbidden_pattern: str
    description: str = ""


EDGE = ("repo_key", "caller", "callee")


def capture_baseline(
    calls: DataFrame, files: DataFrame, functions: DataFrame, as_of, repo_key: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(edges, counts): the call edges of the repositories as they are, and their sizes."""
    edges = scope(calls, repo_key=repo_key).select(
        "repo_key", instant(as_of).alias("captured_at"), "caller", "callee",
        F.coalesce("file_path", F.lit("")).alias("file_path"),
        F.coalesce("line", F.lit(0)).alias("line"),
    )
    modules = scope(files, repo_key=repo_key).groupBy("repo_key").agg(
        F.count(F.lit(1)).alias("module_count")
    )
    sizes = scope(functions, repo_key=repo_key).groupBy("repo_key").agg(
        F.count(F.lit(1)).alias("function_count")
    )
    counts = modules.join(sizes, "repo_key", "full").na.fill(0)
    return edges, counts


def edge_changes(calls: DataFrame, baseline: DataFrame) -> DataFrame:
    """Edges present on one side only, as rows of the drift report.

    Both sides go through one aggregate, which merges repeated edges before the only shuffle.
    """
    side = lambda df, current: df.select(*EDGE, F.lit(current).alias("current"))
    counted = (
        side(calls, True).unionByName(side(baseline, False)).groupBy(*EDGE)
        .agg(F.bool_or("current").alias("is_now"), F.bool_and("current").alias("is_only_now"))
        .where(F.col("is_only_now") | ~F.col("is_now"))
    )
    captured = baseline.groupBy("repo_key").agg(F.max("captured_at").alias("captured_at"))
    when = F.coalesce(F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("never"))
    is_new = F.col("is_now")
    added = F.concat(
        F.lit("New dependency: "), "caller", F.lit(" → "), "callee",
        F.lit(". This edge was absent in the baseline captured at "), when,
    )
    gone = F.concat(
        F.lit("Dependency removed: "), "caller", F.lit(" → "), "callee",
        F.lit(". This edge existed in the baseline but is no longer present."),
    )
    return counted.join(captured, "repo_key", "left").select(
        *EDGE,
        F.when(is_new, "new_dependency").otherwise("removed_dependency").alias("kind"),
        F.when(is_new, "warning").otherwise("info").alias("severity"),
        F.when(is_new, added).otherwise(gone).alias("description"),
        F.lit(None).cast("string").alias("boundary_name"),
    )


def drift_new(calls: DataFrame, baseline: DataFrame) -> DataFrame:
    """Distinct edges of now that the baseline does not have."""
    return edge_changes(calls, baseline).where(F.col("kind") == "new_dependency")


def drift_removed(calls: DataFrame, baseline: DataFrame) -> DataFrame:
    """Distinct edges of the baseline that are gone."""
    return edge_changes(calls, baseline).where(F.col("kind") == "removed_dependency")


def boundary_violations(calls: DataFrame, boundaries: Sequence[Boundary]) -> DataFrame:
    """Edges (every row) that break a rule; the first matching rule in declared order counts.

    Rules become compiled regex tests inside the scan stage: no join, no shuffle.
    """
    broken: list[Column] = [
        F.when(
            glob_match(F.col("caller"), rule.source_pattern)
            & glob_match(F.col("callee"), rule.forbidden_pattern),
            F.struct(
                F.lit(rule.name).alias("name"), F.lit(rule.description).alias("description")
            ),
        )
        for rule in boundaries
    ]
    nothing = F.lit(None).cast("struct<name: string, description: string>")
    hit = F.coalesce(*broken, nothing) if broken else nothing
    return _violations(calls.withColumn("_rule", hit).where(F.col("_rule").isNotNull()))


def _violations(broken: DataFrame) -> DataFrame:
    """Rows of the drift report for edges with the ``_rule`` they break."""
    return broken.select(
        *EDGE,
        F.lit("boundary_violation").alias("kind"),
        F.lit("critical").alias("severity"),
        F.concat(
            F.lit("Boundary violation ("), F.col("_rule.name"), F.lit("): "), "caller",
            F.lit(" depends on "), "callee", F.lit(". "), F.col("_rule.description"),
        ).alias("description"),
        F.col("_rule.name").alias("boundary_name"),
    )


# (name, pattern, rule) rows that are sent to every task
BROADCAST_ROWS = 1_000_000
# lengths to which literal prefixes of rules are cut
PREFIX_LENGTHS = (*range(25), 32, 48, 64)


def boundary_violations_by_table(
    calls: DataFrame, rules: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Edges (every row) that break a rule of a table; the first matching rule by ``position`` counts.

    ``rules`` has position, name, source_pattern, forbidden_pattern, description. A rule is filed under
    the longer of its two literal prefixes, cut to one of a few lengths; a distinct caller or callee looks
    under the same cuts of its name, so it only meets rules that share one of its prefixes. Rules without
    any literal prefix meet every caller. Of rules with the same two patterns only the first is filed; of those
    that fit a name on this side, only the first for each pattern of the other side goes on to the calls. Up to
    ``BROADCAST_ROWS`` (counted) they are sent out, so no call is shuffled; beyond, distinct (caller, callee) pairs
    meet them, which are not unfolded. A null pattern matches nothing, a null description is empty.
    """
    source, forbidden = literal_prefix(F.col("source_pattern")), literal_prefix(F.col("forbidden_pattern"))
    from_source = F.length(source) >= F.length(forbidden)
    one_of = lambda x, y: F.when(from_source, x).otherwise(y)
    lengths = F.array(*[F.lit(n) for n in PREFIX_LENGTHS])
    filed = rules.where("source_pattern is not null and forbidden_pattern is not null").select(
        F.struct("position", "name", F.coalesce("description", F.lit("")).alias("description")).alias("rule"),
        one_of(F.lit("caller"), F.lit("callee")).alias("side"), one_of(source, forbidden).alias("prefix"),
        glob_regexes(one_of(F.col("source_pattern"), F.col("forbidden_pattern"))).alias("own"),
        glob_regexes(one_of(F.col("forbidden_pattern"), F.col("source_pattern"))).alias("other"),
    ).withColumn("size", F.array_max(F.filter(lengths, lambda n: n <= F.length("prefix")))).withColumn(
        "prefix", F.expr("substring(prefix, 1, size)")
    ).groupBy("side", "size", "prefix", "own", "other").agg(F.min("rule").alias("rule"))
    known = calls.where("caller is not null and callee is not null")
    named = lambda side: known.select(F.lit(side).alias("side"), F.col(side).alias("text")).distinct()
    looked_up = named("caller").union(named("callee")).select(
        "side", "text", F.explode(F.filter(lengths, lambda n: n <= F.length("text"))).alias("size")
    ).withColumn("prefix", F.expr("substring(text, 1, size)"))
    met = salted_join(looked_up, filed, ["side", "size", "prefix"], ["text"], rows_per_task=rows_per_task)
    fits = materialize(
        met.where(F.regexp_like("text", F.col("own"))).groupBy("side", "text", "other").agg(F.min("rule").alias("rule")),
        "rules-of-names",
    )
    mine = lambda side: fits.where(F.col("side") == side).select(F.col("text").alias(side), "other", "rule")
    if fits.count() <= BROADCAST_ROWS:
        return _violations(_first_of_lists(known, mine))
    pairs = materialize(known.select("caller", "callee").distinct(), "edge-pairs")

    def hits(side: str, far: str) -> DataFrame:
        both = salted_join(pairs, mine(side), [side], [far], rows_per_task=rows_per_task)
        return both.where(F.regexp_like(far, F.col("other"))).select("caller", "callee", "rule")

    first = hits("caller", "callee").union(hits("callee", "caller")).groupBy("caller", "callee").agg(
        F.min("rule").alias("_rule")
    )
    # counting hot pairs would shuffle all calls once more; adaptive execution splits them in the join
    return _violations(calls.join(first, ["caller", "callee"]))


def _first_of_lists(calls: DataFrame, mine: Callable[[str], DataFrame]) -> DataFrame:
    """``calls`` with the first ``_rule`` they break, where the rules of all names are few enough to be sent out."""

    def ruled(df: DataFrame, side: str, far: str) -> DataFrame:
        listed = mine(side).groupBy(side).agg(F.collect_list(F.struct("other", "rule")).alias("_fits"))
        hits = F.filter("_fits", lambda x: F.regexp_like(F.col(far), x["other"]))
        return df.join(F.broadcast(listed), side, "left").withColumn(
            f"_{side}_rule", F.array_min(F.transform(hits, lambda x: x["rule"]))
        ).drop("_fits")

    both = ruled(ruled(calls, "caller", "callee"), "callee", "caller")
    return both.withColumn("_rule", F.least("_caller_rule", "_callee_rule")).where("_rule is not null")


def detect_drift(
    calls: DataFrame, baseline: DataFrame, boundaries: Sequence[Boundary] | None = None
) -> DataFrame:
    """New edges, broken boundaries and removed edges; ``severity_order`` sorts them for display."""
    report = edge_changes(calls, baseline)
    if boundaries:
        report = report.unionByName(boundary_violations(calls, boundaries))
    order = F.coalesce(*[F.when(F.col("severity") == s, F.lit(n)) for s, n in DRIFT_ORDER.items()])
    return report.withColumn("severity_order", order)


def drift_findings(drift: DataFrame) -> DataFrame:
    """Drift events as scan findings; boundary violations rise to critical."""
    mapped = F.coalesce(
        *[F.when(F.lower("severity") == k, F.lit(v)) for k, v in DRIFT_TO_FINDING.items()],
        F.lit("warning"),
    )
    return drift.select(
        "repo_key",
        F.concat(F.lit("drift/"), "kind").alias("rule_id"),
        F.when(F.col("kind") == "boundary_violation", "critical").otherwise(mapped).alias("severity"),
        F.coalesce(
            F.nullif(F.col("description"), F.lit("")),
            F.concat(F.col("caller"), F.lit(" -> "), F.col("callee")),
        ).alias("message"),
        F.lit(None).cast("string").alias("file_path"),
        F.lit(None).cast("int").alias("line"),
        F.array().cast("array<string>").alias("derivation"),
        "caller", "callee", "boundary_name",
        F.col("severity").alias("raw_severity"),
        F.lit(None).cast("string").alias("incident_id"),
    )


def incident_findings(recent_causes: DataFrame, lookback_hours: int = 168) -> DataFrame:
    """One note per recent incident with its top cause and the first three derivations."""
    top = F.col("causes")[0]
    return recent_causes.select(
        F.lit("incident/recent-cause").alias("rule_id"),
        F.lit("note").alias("severity"),
        F.format_string(
            f"incident %s (last {lookback_hours}h): top cause = %s (strategy=%s, confidence=%.2f)",
            F.col("incident_id"), top["kind"], top["strategy"], top["confidence"],
        ).alias("message"),
        F.transform(F.slice("causes", 1, 3), lambda c: c["derivation"]).alias("derivation"),
        "incident_id",
    )


def scan_findings(
    drift: DataFrame, recent_causes: DataFrame | None = None, lookback_hours: int = 168
) -> DataFrame:
    findings = drift_findings(drift)
    if recent_causes is None:
        return findings
    return findings.unionByName(
        incident_findings(recent_causes, lookback_hours), allowMissingColumns=True
    )


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, F.lit(r)) for s, r in SEVERITY_RANK.items()])


def quality_gate(findings: DataFrame, gate: str = "normal") -> DataFrame:
    """One row: findings per severity, the highest severity, and whether the gate passed."""
    rank = severity_rank(F.col("severity"))
    name_of = F.coalesce(
        *[F.when(F.col("max_rank") == r, F.lit(s)) for s, r in SEVERITY_RANK.items()]
    )
    if gate == "none":
        passed = F.lit(True)
    else:
        floor = SEVERITY_RANK[GATE_FLOOR.get(gate, GATE_FLOOR["normal"])]
        passed = F.coalesce(F.col("max_rank") < floor, F.lit(True))
    return (
        findings.agg(
            *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK],
            F.count(F.lit(1)).alias("total"),
            F.max(rank).alias("max_rank"),
        )
        .withColumn("max_severity", name_of)
        .withColumn("gate", F.lit(gate))
        .withColumn("passed", passed)
    )
