"""Probable causes of incidents: candidates in time, decay score, evidence bonuses, ranking.

Events are one table for the three kinds (see ``runtime.all_events``): ``kind, env_key, event_key,
at, service_name`` plus the fields of each kind. ``event_key`` is unique per kind and environment.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracebeam.functions.scores import decay
from tracebeam.functions.texts import explicit_reference
from tracebeam.functions.times import instant, seconds_between, seconds_of, shift
from tracebeam.operators.skew import (
    ROWS_PER_TASK,
    counts_before,
    first_per_key,
    interval_join,
    last_before,
)
from tracebeam.operators.tables import replace_scopes

# Scoring constants and strategy names.
HALF_LIFE_SECONDS = 300.0
MIN_CONFIDENCE = 0.05
LOOKBACK = "6 hours"
HORIZON_SECONDS = 60.0
# a window meets the events of this many buckets and one: a quarter more than lie inside
BUCKETS_PER_REACH = 4
AFFECTED_BONUS = 0.6
REFERENCE_BONUS = 0.8
PROXIMITY = "temporal_proximity"
PROXIMITY_AND_AFFECTED = "temporal_proximity+lagged_correlation"
REFERENCE_SUFFIX = "+explicit_reference"
CAUSE_KINDS = ("Deployment", "MetricShift", "LogSignature")


def usable_lookback(lookback: float, half_life: float, min_confidence: float) -> float:
    """Seconds before an incident beyond which the decay alone is below the floor."""
    if min_confidence <= 0:
        return lookback
    return min(lookback, half_life * math.log2(1.0 / min_confidence))


def causal_candidates(
    incidents: DataFrame,
    events: DataFrame,
    lookback: str | float = LOOKBACK,
    horizon_seconds: float = HORIZON_SECONDS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Incident x event pairs of one environment with the event in [detected - lookback, + 1 min].

    Adds ``delta_seconds``, how long before the detection the event happened.
    """
    reach = seconds_of(lookback)
    detected = F.col("detected_at")
    windows = incidents.select(
        F.col("id").alias("incident_id"),
        "env_key",
        "detected_at",
        "affected_services",
        "summary",
        shift(detected, -reach).alias("_lo"),
        shift(detected, horizon_seconds).alias("_hi"),
    )
    pairs = interval_join(
        windows, events, ["env_key"], "_lo", "_hi", "at",
        bucket_seconds=(reach + horizon_seconds) / BUCKETS_PER_REACH,
        spread_by=["kind", "event_key", "at"],
        rows_per_task=rows_per_task,
    ).drop("_lo", "_hi")
    return pairs.withColumn("delta_seconds", seconds_between(F.col("at"), detected))


def score_proximity(
    candidates: DataFrame,
    half_life: float = HALF_LIFE_SECONDS,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Keep events before the detection and score them by closeness in time."""
    score = decay(F.col("delta_seconds"), half_life)
    # a second inside the bound no score is needed to know that it passes
    near = usable_lookback(math.inf, half_life, min_confidence) - 1.0
    passes = (F.col("delta_seconds") <= near) | (F.col("proximity") >= min_confidence)
    return (
        candidates.where(F.col("delta_seconds") > 0)
        .withColumn("proximity", score)
        .where(passes)
        .withColumn("confidence", F.col("proximity"))
        .withColumn("strategy", F.lit(PROXIMITY))
    )


def proximate_causes(
    incidents: DataFrame,
    events: DataFrame,
    lookback: str | float = LOOKBACK,
    half_life: float = HALF_LIFE_SECONDS,
    min_confidence: float = MIN_CONFIDENCE,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``score_proximity`` of all candidates; the join fetches none that the floor would drop anyway."""
    reach = seconds_of(lookback)
    # one extra second so that rounding of the bound never cuts a row the floor would keep
    narrow = usable_lookback(reach, half_life, min_confidence) + 1.0
    pairs = causal_candidates(incidents, events, min(reach, narrow), 0.0, rows_per_task)
    return score_proximity(pairs, half_life, min_confidence)


def _boost(df: DataFrame, applies: Column, bonus: float, strategy: Column, mark: str) -> DataFrame:
    """Raise the confidence of matching deployments and remember the value before the bonus."""
    hit = (F.col("kind") == "Deployment") & F.coalesce(applies, F.lit(False))
    return (
        df.withColumn(mark, F.when(hit, F.col("confidence")))
        .withColumn("strategy", F.when(hit, strategy).otherwise(F.col("strategy")))
        .withColumn(
            "confidence",
            F.when(hit, F.least(F.lit(1.0), F.col("confidence") + bonus)).otherwise(
                F.col("confidence")
            ),
        )
    )


def apply_affected_bonus(scored: DataFrame) -> DataFrame:
    """Deployments of an affected service gain 0.6; symptoms on that service do not."""
    service = F.col("service_name")
    return _boost(
        scored,
        (F.length(service) > 0) & F.array_contains(F.col("affected_services"), service),
        AFFECTED_BONUS,
        F.lit(PROXIMITY_AND_AFFECTED),
        "before_affected",
    )


def apply_reference_bonus(scored: DataFrame) -> DataFrame:
    """Deployments named in the incident summary (by id or commit) gain 0.8."""
    named = explicit_reference(F.col("summary"), F.col("deployment_id"), F.col("commit_sha"))
    with_name = scored.withColumn("reference", F.when(F.col("kind") == "Deployment", named))
    return _boost(
        with_name,
        F.col("reference").isNotNull(),
        REFERENCE_BONUS,
        F.concat(F.col("strategy"), F.lit(REFERENCE_SUFFIX)),
        "before_reference",
    )


def cause_label() -> Column:
    """Human-readable name of the cause."""
    number = lambda name: F.col(name).cast("string")
    change = F.when(
        F.col("before").isNotNull() & F.col("after").isNotNull(),
        F.concat(
            F.lit(" ("), number("before"), F.coalesce("unit", F.lit("")), F.lit(" → "),
            number("after"), F.coalesce("unit", F.lit("")), F.lit(")"),
        ),
    ).otherwise(F.lit(""))
    signature = F.coalesce("signature", F.lit(""))
    clipped = F.when(F.length(signature) < 60, signature).otherwise(
        F.concat(F.substring(signature, 1, 57), F.lit("…"))
    )
    service = F.coalesce("service_name", F.lit("?"))
    return (
        F.when(
            F.col("kind") == "Deployment",
            F.concat(F.lit("Deployment "), F.col("deployment_id"), F.lit(" on "), service),
        )
        .when(
            F.col("kind") == "MetricShift",
            F.concat(F.lit("MetricShift "), service, F.lit("."), F.col("metric"), change),
        )
        .otherwise(F.concat(F.lit('LogSignature "'), clipped, F.lit('" on '), service))
    )


def derive_text(scored: DataFrame, half_life: float = HALF_LIFE_SECONDS) -> DataFrame:
    """Add ``cause_label`` and ``derivation``, the one-line explanation of the score."""
    delta = F.col("delta_seconds")
    verb = (
        F.when(F.col("kind") == "Deployment", "occurred")
        .when(F.col("kind") == "MetricShift", "started")
        .otherwise("first seen")
    )
    ago = F.when(delta < 60, F.format_string("%.0fs before", delta)).otherwise(
        F.format_string("%.1fmin before", delta / 60)
    )
    base = F.format_string(
        f"temporal_proximity: %s %s %s the incident → confidence %.3f (half-life {half_life / 60:g}min)",
        F.col("cause_label"), verb, ago, F.col("proximity"),
    )
    after_affected = F.coalesce("before_reference", "confidence")
    affected = F.format_string(
        "; lagged_correlation: deploy is on affected service '%s'; promoted from symptom-tier to "
        f"cause-tier with +{AFFECTED_BONUS} bonus (%.3f → %.3f)",
        F.col("service_name"), F.col("before_affected"), after_affected,
    )
    reference = F.format_string(
        f"; explicit_reference: %s found in incident summary; +{REFERENCE_BONUS} bonus "
        "(%.3f → %.3f)",
        F.col("reference"), F.col("before_reference"), F.col("confidence"),
    )
    return scored.withColumn("cause_label", cause_label()).withColumn(
        "derivation",
        F.concat(
            base,
            F.when(F.col("before_affected").isNotNull(), affected).otherwise(F.lit("")),
            F.when(F.col("before_reference").isNotNull(), reference).otherwise(F.lit("")),
        ),
    )


def score_causes(
    incidents: DataFrame,
    events: DataFrame,
    lookback: str | float = LOOKBACK,
    half_life: float = HALF_LIFE_SECONDS,
    min_confidence: float = MIN_CONFIDENCE,
    floor_after_bonus: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Candidates with score and bonuses.

    The floor normally applies before the bonuses, so only events inside ``usable_lookback`` can
    survive and the join fetches no more than those. ``floor_after_bonus`` keeps the whole
    lookback and tests the final confidence instead.
    """
    reach = seconds_of(lookback)
    if floor_after_bonus:
        pairs = causal_candidates(incidents, events, reach, 0.0, rows_per_task)
        scored = score_proximity(pairs, half_life, 0.0)
    else:
        scored = proximate_causes(incidents, events, reach, half_life, min_confidence, rows_per_task)
    boosted = apply_reference_bonus(apply_affected_bonus(scored))
    return boosted.where(F.col("confidence") >= min_confidence) if floor_after_bonus else boosted


def rank_causes(scored: DataFrame, limit: int = 50) -> DataFrame:
    """Best ``limit`` causes per incident; ties by smaller delta, then kind and key."""
    order = [F.desc("confidence"), F.asc("delta_seconds"), F.asc("kind"), F.asc("event_key")]
    return first_per_key(scored, ["incident_id"], order, limit, rank="rank")


def mentioned_ids(incidents: DataFrame, deployments: DataFrame) -> DataFrame:
    """(env_key, summary, names): deployment ids and commits of the environment that a summary contains.

    Summaries are looked up by their substrings of the lengths that ids have, so no summary is tested
    against every id.
    """
    ids = deployments.select(
        "env_key", F.explode(F.array("deployment_id", "commit_sha")).alias("name")
    ).where(F.length("name") > 0).distinct()
    lengths = ids.agg(F.sort_array(F.collect_set(F.length("name"))).alias("_lengths"))
    summaries = incidents.select("env_key", "summary").where(F.length("summary") > 0).distinct()
    # one row: the distinct lengths
    parts = summaries.crossJoin(F.broadcast(lengths)).select(
        "env_key", "summary",
        F.explode(F.expr(
            "array_distinct(flatten(transform(filter(_lengths, l -> l <= length(summary)), l -> "
            "transform(sequence(1, length(summary) - l + 1), i -> substring(summary, i, l)))))"
        )).alias("name"),
    )
    return parts.join(ids, ["env_key", "name"]).groupBy("env_key", "summary").agg(
        F.collect_list("name").alias("names")
    )


def best_candidates(incidents: DataFrame, events: DataFrame, limit: int) -> DataFrame:
    """Of all pairs with the event before the detection, enough that each incident's best ``limit`` are
    among them, whatever half-life and floor; columns as ``causal_candidates``.

    Within events of equal bonus a later one is never worse. So the last ``limit`` events of the
    environment, of the deployments of each affected service, of those named in the summary, and of
    those both affected and named hold the best; each pair is taken from one of these four alone.
    """
    deployed = events.where(F.col("kind") == "Deployment")
    names = mentioned_ids(incidents, deployed)
    probes = incidents.join(names, ["env_key", "summary"], "left").select(
        "env_key", F.col("id").alias("incident_id"), "detected_at", "affected_services", "summary",
        F.explode(_with_blank(F.col("affected_services"))).alias("_service"),
        F.coalesce("names", F.array().cast("array<string>")).alias("_names"),
    ).select("*", F.explode(_with_blank(F.col("_names"))).alias("_name"))
    said = names.select("env_key", F.explode("names").alias("_name")).distinct()
    by_name = deployed.withColumn(
        "_name", F.explode(F.array_distinct(F.array("deployment_id", "commit_sha")))
    ).join(said, ["env_key", "_name"], "left_semi")
    blank = lambda df: df.withColumn("_name", F.lit(""))
    with_service = lambda df: df.where(F.length("service_name") > 0).withColumn("_service", F.col("service_name"))
    everywhere = lambda df: df.withColumn("_service", F.lit(""))
    points = everywhere(blank(events))
    for part in (with_service(blank(deployed)), everywhere(by_name), with_service(by_name)):
        points = points.unionByName(part)
    pairs = last_before(
        probes, points, ["env_key", "_service", "_name"], "detected_at", "at", ["kind", "event_key"], limit
    )
    deployment = F.col("kind") == "Deployment"
    said_by = lambda name: F.coalesce(F.array_contains("_names", F.col(name)), F.lit(False))
    service = F.when(
        deployment & (F.length("service_name") > 0) & F.array_contains("affected_services", F.col("service_name")),
        F.col("service_name"),
    )
    name = F.when(
        deployment, F.when(said_by("deployment_id"), F.col("deployment_id")).when(said_by("commit_sha"), F.col("commit_sha"))
    )
    return (
        pairs.where(
            (F.col("_service") == F.coalesce(service, F.lit("")))
            & (F.col("_name") == F.coalesce(name, F.lit("")))
        )
        .drop("_service", "_name", "_names")
        .withColumn("delta_seconds", seconds_between(F.col("at"), F.col("detected_at")))
    )


def _with_blank(names: Column) -> Column:
    """The distinct names without nulls, and the empty text once."""
    present = F.filter(names, lambda x: F.length(x) > 0)
    return F.array_union(F.coalesce(present, F.array().cast("array<string>")), F.array(F.lit("")))


def top_causes(
    incidents: DataFrame,
    events: DataFrame,
    limit: int = 50,
    lookback: str | float = LOOKBACK,
    half_life: float = HALF_LIFE_SECONDS,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """``rank_causes(score_causes(...), limit)`` by ``best_candidates``, so without scoring all pairs."""
    reach = seconds_of(lookback)
    pairs = best_candidates(incidents, events, limit).where(F.col("delta_seconds") <= reach)
    scored = score_proximity(pairs, half_life, min_confidence)
    return rank_causes(apply_reference_bonus(apply_affected_bonus(scored)), limit)


PRECEDED_COLUMNS = (
    "env_key", "incident_id", "kind", "event_key", "service_name", "at", "delta_seconds",
    "confidence", "strategy", "derivation",
)


def link_incidents(
    incidents: DataFrame,
    events: DataFrame,
    env_key: str | None = None,
    lookback: str | float = LOOKBACK,
    half_life: float = HALF_LIFE_SECONDS,
    min_confidence: float = MIN_CONFIDENCE,
    rows_per_task: int = ROWS_PER_TASK,
    limit: int | None = None,
) -> DataFrame:
    """All cause edges of every incident, or of one environment; with ``limit`` the best of each incident."""
    if env_key is not None:
        incidents = incidents.where(F.col("env_key") == env_key)
        events = events.where(F.col("env_key") == env_key)
    scored = score_causes(
        incidents, events, lookback, half_life, min_confidence, rows_per_task=rows_per_task
    ) if limit is None else top_causes(incidents, events, limit, lookback, half_life, min_confidence)
    return derive_text(scored, half_life).select(*PRECEDED_COLUMNS)


def write_links(preceded: DataFrame, path: str, incidents: DataFrame | None = None) -> None:
    """Replace the stored edges of ``incidents`` (env_key, incident_id); those of others stay.

    ``incidents`` names what was linked, so an incident that lost all its causes loses its edges;
    without it only the incidents present in ``preceded`` are replaced.
    """
    linked = preceded if incidents is None else incidents
    replace_scopes(preceded, path, linked.select("env_key", "incident_id"), ["env_key"])


def link_stats(
    incidents: DataFrame,
    events: DataFrame,
    lookback: str | float = LOOKBACK,
    half_life: float = HALF_LIFE_SECONDS,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Per incident: candidates inspected, edges written, skipped as too late / too weak, by kind.

    Counts cover the whole lookback, including events the score drops. No pair is made: counts are
    differences of cumulative event counts at five instants of each incident.
    """
    micros = lambda seconds: F.expr(f"make_dt_interval(0, 0, 0, {seconds:.6f})")
    detected, reach = F.col("detected_at"), written_reach(half_life, min_confidence, seconds_of(lookback))
    edge = lambda name, at, inclusive: F.struct(
        F.lit(name).alias("edge"), at.alias("at"), F.lit(inclusive).alias("inclusive")
    )
    edges = [
        edge("first", detected - micros(seconds_of(lookback)), False),
        edge("detected", detected, True),
        edge("last", detected + micros(HORIZON_SECONDS), True),
    ]
    if reach is not None:
        edges += [edge("from", detected - micros(reach), False), edge("before", detected, False)]
    probes = incidents.select(
        F.col("id").alias("incident_id"), "env_key", F.explode(F.array(*edges)).alias("e")
    ).select("incident_id", "env_key", "e.*")
    kinds = {k: F.col("kind") == k for k in CAUSE_KINDS}
    seen = counts_before(probes, events, ["env_key"], "at", "inclusive", {"n": F.lit(True), **kinds}, "at")
    between = lambda column, start, end: F.sum(
        F.when(F.col("edge") == end, F.col(column)).when(F.col("edge") == start, -F.col(column)).otherwise(0)
    )
    counted = seen.groupBy("incident_id").agg(
        between("n", "first", "last").alias("inspected"), between("n", "from", "before").alias("written"),
        between("n", "detected", "last").alias("skipped_after"),
        *[between(k, "from", "before").alias(f"written_{k}") for k in CAUSE_KINDS],
    ).withColumn("skipped_low", F.col("inspected") - F.col("skipped_after") - F.col("written"))
    names = [c for c in counted.columns if c != "incident_id"]
    return (
        incidents.select(F.col("id").alias("incident_id"), "env_key")
        .join(counted, "incident_id", "left")
        .na.fill(0, names)
    )


def written_reach(half_life: float, min_confidence: float, lookback: float) -> float | None:
    """Longest time before a detection (to the microsecond) at which an event is still written."""
    if min_confidence > 1:
        return None
    reach = int(usable_lookback(lookback, half_life, min_confidence) * 1_000_000)
    score = lambda us: math.exp(-math.log(2.0) * (us / 1_000_000) / half_life)
    while score(reach + 1) >= min_confidence and reach < lookback * 1_000_000:
        reach += 1
    while reach > 0 and score(reach) < min_confidence:
        reach -= 1
    return reach / 1_000_000


def causes_for_incident(
    preceded: DataFrame,
    incident_id: str | None = None,
    min_confidence: float = 0.0,
    limit: int = 50,
) -> DataFrame:
    """Stored edges of one incident, or of each, strongest first."""
    edges = preceded.where(F.col("confidence") >= min_confidence)
    if incident_id is not None:
        edges = edges.where(F.col("incident_id") == incident_id)
    return rank_causes(edges, limit)


def newest_incidents(incidents: DataFrame, as_of, lookback_hours: int = 168, limit: int = 20) -> DataFrame:
    """The ``limit`` newest incidents of the last hours; link these instead of all."""
    age = seconds_between(F.col("detected_at"), instant(as_of)) / 3600.0
    return (
        incidents.where(F.col("detected_at").isNotNull() & (F.floor(age) <= lookback_hours))
        .orderBy(F.desc("detected_at"), F.desc("id"))
        .limit(limit)
    )


def recent_incident_causes(
    incidents: DataFrame,
    preceded: DataFrame,
    as_of,
    lookback_hours: int = 168,
    limit: int = 20,
    top: int = 3,
) -> DataFrame:
    """Newest incidents of the last hours with their strongest causes; those without are left out.

    The newest ``limit`` incidents are taken first and the ones without causes dropped after, so
    fewer rows may come back.
    """
    recent = newest_incidents(incidents, as_of, lookback_hours, limit).select(
        F.col("id").alias("incident_id"), "detected_at", "severity", "summary"
    )
    # ``recent`` has at most ``limit`` rows, so broadcasting it is bounded
    mine = preceded.drop("env_key").join(F.broadcast(recent), "incident_id")
    best = rank_causes(mine, top)
    entry = F.struct("rank", "kind", "confidence", "strategy", "derivation", "event_key")
    return best.groupBy("incident_id", "detected_at", "severity", "summary").agg(
        F.array_sort(F.collect_list(entry)).alias("causes")
    )
