"""As-of joins and cumulative counts against row-by-row references, series cut into several blocks."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracebeam.operators import causality as ca
from tracebeam.operators import drift as dr
from tracebeam.operators import external as ex
from tracebeam.operators.skew import asof_join, counts_before

START = datetime(2026, 1, 1)


def at(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def series(spark, n=3000, seed=1):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 8 + ["cold", None])
    points = [(key(), rng.randrange(400), round(rng.random(), 3), rng.choice("ab")) for _ in range(n)]
    probes = [(k, key(), rng.choice([None, -5, 600, *range(0, 400, 7)]), rng.random() < 0.5) for k in range(300)]
    p = spark.createDataFrame([(k, at(s), v, g) for k, s, v, g in points], "key string, ts timestamp, value double, kind string")
    q = spark.createDataFrame([(i, k, at(s), b) for i, k, s, b in probes], "id long, key string, at timestamp, inclusive boolean")
    return points, probes, p, q


def test_asof_join(spark):
    points, probes, p, q = series(spark)
    got = {r["id"]: r for r in asof_join(q, p, ["key"], "at", "ts", ["value", "kind"]).collect()}
    assert len(got) == len(probes)
    for i, key, when, _ in probes:
        seen = [(s, v, g) for k, s, v, g in points if key is not None and k == key and when is not None and s <= when]
        row = got[i]
        if seen:
            assert (row["matched_at"], row["value"], row["kind"]) == (at(max(seen)[0]), *max(seen)[1:])
        else:
            assert row["matched_at"] is None and row["value"] is None
    assert asof_join(q.limit(0), p, ["key"], "at", "ts", ["value"]).count() == 0
    assert asof_join(q, p.limit(0), ["key"], "at", "ts", ["value"]).where("value is not null").count() == 0


def test_counts_before(spark):
    points, probes, p, q = series(spark)
    counts = {"n": F.lit(True), "a": F.col("kind") == "a"}
    got = {r["id"]: (r["n"], r["a"]) for r in counts_before(q, p, ["key"], "at", "inclusive", counts, "ts").collect()}
    for i, key, when, inclusive in probes:
        seen = [
            g for k, s, _, g in points
            if key is not None and k == key and when is not None and (s < when or (inclusive and s == when))
        ]
        assert got[i] == (len(seen), seen.count("a"))


def test_link_stats_equal_counted_pairs(spark):
    rng = random.Random(2)
    incidents = spark.createDataFrame(
        [(f"I{k}", f"e{k % 2}", at(rng.randrange(20000)) if k else None, ["s"], "") for k in range(40)],
        "id string, env_key string, detected_at timestamp, affected_services array<string>, summary string",
    )
    events = spark.createDataFrame(
        [(rng.choice(ca.CAUSE_KINDS), f"e{k % 3}", f"k{k}", at(rng.randrange(20000)), "s") for k in range(2000)],
        "kind string, env_key string, event_key string, at timestamp, service_name string",
    )
    for lookback, floor in (("6 hours", 0.05), (900, 0.0), (900, 0.5), (600, 2.0)):
        pairs = ca.causal_candidates(incidents, events, lookback)
        delta = F.col("delta_seconds")
        good = (delta > 0) & (ca.decay(delta, 300.0) >= floor)
        want = {
            r["incident_id"]: tuple(r)[1:] for r in pairs.groupBy("incident_id").agg(
                F.count(F.lit(1)), F.count_if(good), F.count_if(delta < 0), F.count_if((delta >= 0) & ~good),
                *[F.count_if(good & (F.col("kind") == k)) for k in ca.CAUSE_KINDS],
            ).collect()
        }
        got = ca.link_stats(incidents, events, lookback, min_confidence=floor).select(
            "incident_id", "inspected", "written", "skipped_after", "skipped_low",
            *[f"written_{k}" for k in ca.CAUSE_KINDS],
        ).collect()
        assert len(got) == 40
        assert {r[0]: tuple(r)[1:] for r in got} == {f"I{k}": want.get(f"I{k}", (0,) * 7) for k in range(40)}


def test_rules_of_a_table_equal_rules_of_a_list(spark):
    rules = [
        dr.Boundary("a", "app.*", "db.*", "no"), dr.Boundary("b", "*", "db.raw?", ""), dr.Boundary("c", "*", "*.secret", "x"),
        dr.Boundary("d", "app.core.[a-c]*", "net.*"), dr.Boundary("e", "*x*", "*"), dr.Boundary("f", "", "db.*"),
        dr.Boundary("g", "app.core.abcdefghijklmnopqrstuvwxyz.long*", "*"),
    ]
    ends = ["app.core.a1", "app.core.d1", "app.x", "lib.y", "x", "", "app.core.abcdefghijklmnopqrstuvwxyz.long1"]
    far = ["db.raw1", "db.t", "net.io", "a.secret", "", None]
    calls = spark.createDataFrame(
        [("r", a, b) for a in [*ends, None] for b in far for _ in range(2)], "repo_key string, caller string, callee string"
    )
    table = spark.createDataFrame(
        [(k, *r) for k, r in enumerate(rules)] + [(99, "null", None, "*", None)],
        "position long, name string, source_pattern string, forbidden_pattern string, description string",
    )
    columns = ["repo_key", "caller", "callee", "boundary_name", "description"]
    got = dr.boundary_violations_by_table(calls, table, rows_per_task=5).select(columns).collect()
    want = dr.boundary_violations(calls, rules).select(columns).collect()
    assert len(want) > 20 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert dr.boundary_violations_by_table(calls, table.limit(0)).count() == 0


def test_rules_of_a_table_meet_names_not_pairs(spark, monkeypatch):
    calls = spark.range(900).selectExpr("'r' repo_key", "concat('pkg', id % 30) caller", "concat('svc', id div 30) callee")
    table = spark.createDataFrame(
        [(1, "a", "pkg1*", "svc2?", None), (2, "b", "*", "svc7", "x"), (3, "c", "*", "*9", None)],
        "position long, name string, source_pattern string, forbidden_pattern string, description string",
    )
    joined = []
    real = dr.salted_join

    def counted(left, right, keys, *args, **kwargs):
        if "prefix" in keys:
            joined.append(left.count())
        return real(left, right, keys, *args, **kwargs)

    monkeypatch.setattr(dr, "salted_join", counted)
    got = dr.boundary_violations_by_table(calls, table).groupBy("boundary_name").count().collect()
    # 11 callers begin with pkg1, 10 callees are svc2?; svc7 has 30 callers; svc9, svc19 and svc29 less those of rule a
    assert sorted(map(tuple, got)) == [("a", 110), ("b", 30), ("c", 79)]
    assert joined and sum(joined) <= 60 * 6


def test_equal_rules_are_filed_once_and_calls_not_shuffled(spark, monkeypatch):
    calls = spark.range(600).selectExpr("'r' repo_key", "concat('pkg', id % 30) caller", "concat('svc', id div 30) callee")
    table = spark.range(500).selectExpr(
        "500 - id position", "concat('n', 500 - id) name", "'pkg1*' source_pattern",
        "if(id % 2 = 0, '*', 'svc1?') forbidden_pattern", "cast(null as string) description",
    )
    filed = []
    real = dr.salted_join

    def watched(left, right, keys, *args, **kwargs):
        if "prefix" in keys:
            filed.append(right.count())
        return real(left, right, keys, *args, **kwargs)

    monkeypatch.setattr(dr, "salted_join", watched)
    got = dr.boundary_violations_by_table(calls, table)
    # (11 callers begin with pkg1) x 20 callees, of which svc1? has ten: the lowest position is a svc1? rule
    want = [("n1", 11 * 10), ("n2", 11 * 10)]
    assert sorted(map(tuple, got.groupBy("boundary_name").count().collect())) == want
    assert filed == [2]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    monkeypatch.setattr(dr, "BROADCAST_ROWS", 0)
    again = dr.boundary_violations_by_table(calls, table)
    assert sorted(map(tuple, again.select(got.columns).collect())) == sorted(map(tuple, got.collect()))


def test_mentions_of_a_name_table(spark):
    from tracebeam.functions.texts import mentioned_names

    names = ["auth", "auth-api", ".net", "--", "pay ments", "a+b", "x"]
    said = [
        "auth is down", "the auth-api, not authority", "uses .net and a--b", "pay ments pay", "1 a+b 2", "", None, "x",
        "x x x", "authx auth-apis", "-- alone",
    ]
    texts = spark.createDataFrame(list(enumerate(said)), "id long, text string")
    table = spark.createDataFrame([(n,) for n in [*names, "auth", None, ""]], "name string")
    got = ex.name_mentions(texts, ["id"], table, rows_per_task=2).collect()
    want = texts.select("id", F.explode(mentioned_names(F.col("text"), names)).alias("name")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 6
