"""Scores, bonuses and replay on a small incident with known numbers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracebeam import schemas
from tracebeam.functions.scores import band, claim_multiplier, decay
from tracebeam.operators import causality as ca
from tracebeam.operators import drift as dr
from tracebeam.operators import ledger as lg
from tracebeam.operators import replay as rp
from tracebeam.operators import runtime as rt


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def cascade(spark):
    """Deployment on auth 420 s before and a latency shift on payments 60 s before an incident."""
    stamp = lambda name: F.col(name).cast("timestamp")
    make = lambda rows, columns, schema: _typed(spark, rows, columns, schema)
    incidents = make(
        [("prod", "INC-1", "Payments down", "sev1", "2026-04-12 14:24:00", "2026-04-12 15:10:00",
          "caused by deploy-abc123", ["payments", "auth"])],
        "env_key id title severity detected_at resolved_at summary affected_services", schemas.INCIDENTS,
    )
    deployments = make(
        [("prod", "deploy-abc123", "auth", "2026-04-12 14:17:00", "f00dfeed", "pool refactor"),
         ("prod", "deploy-late", "auth", "2026-04-12 14:24:30", None, None),
         ("test", "deploy-abc123", "auth", "2026-04-12 14:20:00", None, None)],
        "env_key deployment_id service_name at commit_sha description", schemas.DEPLOYMENTS,
    )
    shifts = make(
        [("prod", "payments", "p99", "2026-04-12 14:23:00", 120.0, 4200.0, "ms")],
        "env_key service_name metric started_at before after unit", schemas.METRIC_SHIFTS,
    )
    logs = make(
        [("prod", "payments", "timeout <n>", "abc", "2026-04-12 14:00:00", 3, "error")],
        "env_key service_name signature signature_hash first_seen_at count level", schemas.LOG_SIGNATURES,
    )
    return {"incidents": incidents, "deployments": deployments, "metric_shifts": shifts, "log_signatures": logs}


def _typed(spark, rows, columns, schema):
    names = columns.split()
    empty = spark.createDataFrame([], schema)
    kinds = dict(empty.dtypes)
    plain = {n: k if k.startswith("array") or k in ("double", "bigint") else "string" for n, k in kinds.items()}
    df = spark.createDataFrame(rows, ", ".join(f"{n} {plain[n]}" for n in names))
    df = df.select(*[F.col(n).cast(kinds[n]).alias(n) for n in names])
    return empty.unionByName(df, allowMissingColumns=True)


def causes_of(tables):
    return rt.all_events(tables["deployments"], tables["metric_shifts"], tables["log_signatures"])


def test_decay_halves(spark):
    for seconds, expected in ((0, 1.0), (300, 0.5), (600, 0.25)):
        assert value(spark, decay(F.lit(float(seconds)), 300.0)) == pytest.approx(expected)


def test_known_scores(cascade):
    ranked = ca.rank_causes(ca.score_causes(cascade["incidents"], causes_of(cascade))).collect()
    best = {r["event_key"]: r for r in ranked}
    deploy = best["deploy-abc123"]
    assert round(deploy["proximity"], 3) == 0.379
    assert round(deploy["before_reference"], 3) == 0.979
    assert deploy["confidence"] == 1.0
    assert deploy["strategy"] == "temporal_proximity+lagged_correlation+explicit_reference"
    shift = next(r for r in ranked if r["kind"] == "MetricShift")
    assert round(shift["confidence"], 4) == 0.8706 and shift["delta_seconds"] == 60
    # the log line is older than the floor allows, the late deployment comes after the detection
    assert len(ranked) == 2 and ranked[0]["rank"] == 1


def test_floor_after_bonus_keeps_old_named_deployments(cascade):
    early = cascade["deployments"].withColumn("at", F.lit("2026-04-12 12:00:00").cast("timestamp"))
    events = rt.all_events(early, cascade["metric_shifts"].limit(0), cascade["log_signatures"].limit(0))
    assert ca.score_causes(cascade["incidents"], events).count() == 0
    kept = ca.score_causes(cascade["incidents"], events, floor_after_bonus=True).collect()
    assert [r["event_key"] for r in kept] == ["deploy-abc123", "deploy-late"] or len(kept) == 2


def test_derivation_text(cascade):
    links = ca.link_incidents(cascade["incidents"], causes_of(cascade))
    text = links.where(F.col("kind") == "Deployment").first()["derivation"]
    assert text.startswith(
        "temporal_proximity: Deployment deploy-abc123 on auth occurred 7.0min before the incident → confidence 0.379 (half-life 5min)"
    )
    assert "(0.379 → 0.979)" in text and "(0.979 → 1.000)" in text


def test_link_stats_count_everything(cascade):
    stats = ca.link_stats(cascade["incidents"], causes_of(cascade)).first()
    assert (stats["inspected"], stats["written"], stats["skipped_after"], stats["skipped_low"]) == (4, 2, 1, 1)


def test_slicing_hot_buckets_changes_nothing(tables):
    columns = ["incident_id", "kind", "event_key", "at", "confidence"]
    plain = ca.link_incidents(tables.incidents, tables.causes).select(columns)
    sliced = ca.link_incidents(tables.incidents, tables.causes, rows_per_task=1).select(columns)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, sliced.collect()))


def test_links_are_replaced_per_environment(spark, cascade, tmp_path):
    links = ca.link_incidents(cascade["incidents"], causes_of(cascade))
    for _ in range(2):
        ca.write_links(links, str(tmp_path / "links"))
    assert spark.read.parquet(str(tmp_path / "links")).count() == 2


def test_relinking_one_incident_keeps_the_others(spark, cascade, tmp_path):
    path, links = str(tmp_path / "links"), ca.link_incidents(cascade["incidents"], causes_of(cascade))
    other = links.withColumn("incident_id", F.lit("INC-9"))
    ca.write_links(links.unionByName(other), path)
    ca.write_links(other.limit(1), path)
    stored = {r["incident_id"]: r["count"] for r in spark.read.parquet(path).groupBy("incident_id").count().collect()}
    assert stored == {"INC-1": 2, "INC-9": 1}
    ca.write_links(links.limit(0), path, incidents=other)
    assert {r["incident_id"] for r in spark.read.parquet(path).collect()} == {"INC-1"}


def test_replay_parts(cascade):
    links = ca.link_incidents(cascade["incidents"], causes_of(cascade))
    parts = rp.replay(cascade, links, ["INC-1"])
    marks = {(r["kind"], r["service_name"]): r["marker"] for r in parts.timeline.where("at <= '2026-04-12 14:24:00'").collect()}
    assert marks[("incident", "payments")] == "▶ INCIDENT"
    assert marks[("deployment", "auth")] == "↗ cause" and marks[("log_signature", "payments")] == ""
    assert parts.timeline.where("marker = '↓ response'").count() == 1
    cascade_rows = [r["service_name"] for r in parts.cascade.orderBy("position").collect()]
    assert cascade_rows == ["payments", "auth"]
    confidence = parts.confidence.first()
    assert confidence["evidence_count"] == 2 and confidence["score"] == pytest.approx((1 + 0.87055) / 2, abs=1e-4)
    assert parts.deployments_during.count() == 2 and parts.metric_deltas.count() == 1
    assert "Affected: payments, auth" in parts.summary.first()["lines"]


def test_replay_without_causes(cascade):
    none = ca.link_incidents(cascade["incidents"], causes_of(cascade)).limit(0)
    row = rp.replay_confidence(cascade["incidents"], none).first()
    assert row["score"] == 0.0 and row["evidence_count"] == 0 and "no causal edges" in row["derivation"]


def test_multiplier_and_bands(spark):
    for n, expected in ((0, 1.0), (1, 0.7), (2, 0.4), (3, 0.2), (9, 0.2)):
        assert value(spark, claim_multiplier(F.lit(n))) == pytest.approx(expected)
    assert [value(spark, band(F.lit(x))) for x in (0.6, 0.3, 0.1)] == ["green", "yellow", "red"]


def test_gate_truth_table(spark):
    empty = spark.createDataFrame([], "severity string")
    table = {
        "note": (True, True, True, True), "warning": (False, True, True, True),
        "error": (False, False, True, True), "critical": (False, False, False, True),
    }
    for gate_index, gate in enumerate(("strict", "normal", "lenient", "none")):
        assert dr.quality_gate(empty, gate).first()["passed"]
        for severity, expected in table.items():
            one = spark.createDataFrame([(severity,)], "severity string")
            assert dr.quality_gate(one, gate).first()["passed"] is expected[gate_index]
    unknown = dr.quality_gate(spark.createDataFrame([("error",)], "severity string"), "odd").first()
    assert not unknown["passed"]


def test_drift_kinds_and_first_rule_wins(spark):
    edge = "repo_key string, caller string, callee string, file_path string, line int"
    calls = spark.createDataFrame([("r", "auth.a", "pay.b", "f", 1), ("r", "auth.a", "pay.b", "f", 2), ("r", "x", "y", "f", 3)], edge)
    baseline = spark.createDataFrame([("r", "x", "y", "f", 3), ("r", "old", "gone", "f", 1)], edge).withColumn(
        "captured_at", F.lit("2024-01-01").cast("timestamp")
    )
    rules = [dr.Boundary("one", "auth.*", "pay.*"), dr.Boundary("two", "auth.?", "*")]
    drift = dr.detect_drift(calls, baseline, rules).collect()
    kinds = sorted((r["kind"], r["boundary_name"]) for r in drift)
    assert kinds == [("boundary_violation", "one"), ("boundary_violation", "one"), ("new_dependency", None), ("removed_dependency", None)]
    assert dr.detect_drift(calls, baseline.limit(0)).where("kind = 'new_dependency'").count() == 2


def test_fix_outcomes(spark):
    rows = [("not_run", 0.9), ("tests_passed", 0.6), ("tests_passed", 0.5), ("tests_failed", 0.9), ("apply_failed", 0.9), ("timeout", 0.9)]
    df = spark.createDataFrame(rows, "sandbox_outcome string, confidence_score double")
    got = [r["outcome"] for r in lg.classify_fix(df).collect()]
    assert got == ["proposed", "accepted", "inconclusive", "rejected", "rejected", "inconclusive"]


def test_as_of_and_shift(spark):
    rows = [("e", "s", "m", "2024-01-01 00:00:00", 10.0), ("e", "s", "m", "2024-01-01 00:04:00", 30.0), ("e", "s", "n", "2024-01-01 00:00:00", 5.0)]
    samples = spark.createDataFrame(rows, "env_key string, service_name string, metric string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    shifts = rt.metric_shifts(samples, "2024-01-01 00:05:00").collect()
    assert [(r["metric"], r["before"], r["after"]) for r in shifts] == [("m", 10.0, 30.0)]
    assert shifts[0]["confidence"] == pytest.approx(0.4)


def test_lines_differing_in_digits_are_one_signature(spark):
    lines = spark.createDataFrame([("e", "s", "error 12 at 0xff", 1), ("e", "s", "error 99 at 0xab", 2), ("e", "s", "fine", 3)], "env_key string, service_name string, message string, t int")
    out = rt.cluster_logs(lines.withColumn("ts", F.timestamp_seconds("t"))).collect()
    assert len(out) == 1 and out[0]["count"] == 2 and out[0]["signature"] == "error <n> at <n>"


def test_top_causes_equal_the_ranking_of_all_pairs(spark):
    """Nulls, blanks, names inside names, events named by commit only, equal instants and copies."""
    incidents = _typed(
        spark,
        [(e, f"INC-{n}-{e}", f"2026-04-12 14:{n % 60:02d}:00", said, services)
         for n, (said, services) in enumerate(
             [("see d-1", ["a", "b"]), ("see d-12 and c0ffee", ["b", None, ""]), (None, ["a"]), ("c0ffee", None),
              ("", ["c"]), ("d-1d-2", ["c", "a", "a"])] * 4, 20)
         for e in ("x", "y")],
        "env_key id detected_at summary affected_services", schemas.INCIDENTS,
    )
    deployments = _typed(
        spark,
        [(("x", "y", None)[n % 7 % 3], ("d-1", "d-2", "d-12", None, "c0ffee", "")[n % 6], ("a", "b", "c", "", None)[n % 5],
          f"2026-04-12 14:{n % 45:02d}:{30 * (n % 2):02d}", ("c0ffee", "beef", None, "")[n % 4]) for n in range(300)],
        "env_key deployment_id service_name at commit_sha", schemas.DEPLOYMENTS,
    )
    shifts = _typed(
        spark,
        [("x", "ab"[n % 2], f"m{n % 3}", f"2026-04-12 14:{n % 40:02d}:30", 1.0, 2.0, "ms") for n in range(160)],
        "env_key service_name metric started_at before after unit", schemas.METRIC_SHIFTS,
    )
    events = rt.all_events(deployments, shifts, spark.createDataFrame([], schemas.LOG_SIGNATURES))
    columns = ["incident_id", "rank", "kind", "event_key", "at", "confidence", "strategy", "delta_seconds"]
    found = lambda df: sorted(map(tuple, df.select(columns).collect()), key=repr)
    plain = lambda ranked: [(r[:6] + r[7:]) for r in ranked]
    for limit, floor in ((1, 0.05), (4, 0.05), (9, 0.6)):
        all_pairs = ca.rank_causes(ca.score_causes(incidents, events, min_confidence=floor), limit)
        best = ca.top_causes(incidents, events, limit, min_confidence=floor)
        # rows alike in all order columns may differ in service and strategy only
        assert plain(found(best)) == plain(found(all_pairs)) != []


def test_ranking_queries_score_no_other_pairs(spark, tables, monkeypatch):
    from tracebeam.plans import causality as plans

    def refused(*args, **kwargs):
        raise AssertionError("all pairs asked for")

    monkeypatch.setattr(ca, "causal_candidates", refused)
    for query in (plans.rank_causes, plans.causes_for_incident, plans.replay_confidence, plans.mark_timeline):
        assert query(tables).limit(1).count() == 1


def test_first_events_and_counts_equal_the_built_timeline(spark, tables, cascade):
    key = lambda df, names: sorted(map(tuple, df.select(*names).collect()), key=repr)
    for runtime, causes in ((tables.runtime, tables.causes), (cascade, causes_of(cascade))):
        columns = ["incident_id", "service_name", "first_event_at", "first_event_kind", "first_event_description", "position"]
        whole = rp.service_cascade(rp.build_timeline(runtime))
        assert key(rp.service_cascade(rp.first_of_timeline(runtime)), columns) == key(whole, columns) != []
        links = ca.link_incidents(runtime["incidents"], causes)
        overview = rp.replay_overview(rp.replay(runtime, links))
        counted = rp.replay_counts(runtime, links)
        assert sorted(counted.columns) == sorted(overview.columns)
        assert key(counted, overview.columns) == key(overview, overview.columns)


def test_cascade_and_replay_build_no_timeline(spark, tables, monkeypatch):
    from tracebeam.plans import causality as plans

    def refused(*args, **kwargs):
        raise AssertionError("a timeline was built")

    monkeypatch.setattr(rp, "interval_join", refused)
    for query in (plans.service_cascade, plans.replay):
        assert query(tables).limit(1).count() == 1


def test_fix_context_reads_only_the_texts_of_chosen_files(spark):
    causes = spark.createDataFrame([("I1", 1, "Deployment", 0.9, "a")], "incident_id string, rank int, kind string, confidence double, service_name string")
    services = spark.createDataFrame([("e", "a", ["pkg1/m.py"])], "env_key string, name string, file_paths array<string>")
    files = spark.range(50).select(
        F.format_string("pkg%d/m.py", "id").alias("path"),
        F.when(F.col("id") == 1, F.lit("text")).otherwise(F.raise_error(F.lit("a text nobody asked for"))).alias("source"),
    )
    assert [r["body"] for r in lg.fix_context(causes, services, 5, files, 300).collect()] == ["text"]


def test_proximity_queries_fetch_only_what_the_floor_keeps(tables, monkeypatch):
    from tracebeam.plans import causality as plans

    asked, whole = [], ca.causal_candidates
    want = ca.score_proximity(whole(tables.incidents, tables.causes)).count()

    def spied(incidents, events, lookback=ca.LOOKBACK, *rest):
        asked.append(ca.seconds_of(lookback))
        return whole(incidents, events, lookback, *rest)

    monkeypatch.setattr(ca, "causal_candidates", spied)
    assert plans.score_proximity(tables).count() == want
    assert plans.affected_bonus(tables).count() == want
    assert len(asked) == 2 and max(asked) < 1300


def test_rounded_score_rounds_half_up(spark):
    from tracebeam.functions.scores import rounded_score

    for x, expected in ((0.0, 0.0), (0.05, 0.05), (0.1234564, 0.123456), (0.1234566, 0.123457), (1.0, 1.0)):
        assert value(spark, rounded_score(F.lit(x), 6)) == expected
    assert value(spark, rounded_score(F.lit(None).cast("double"), 6)) is None
