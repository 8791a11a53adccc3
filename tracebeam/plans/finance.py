"""Queries over the cost ledger, savings, budget and fix audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebeam.functions import scores
from tracebeam.operators import causality as ca
from tracebeam.operators import ledger as ops
from tracebeam.operators import replay as rp
from tracebeam.plans.causality import six
from tracebeam.plans.registry import query
from tracebeam.plans.views import AS_OF, Tables, text

WINDOW = "ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY"


@query(f"SELECT round(coalesce(sum(cost_usd), 0), 6) AS total_usd, count(*) AS calls FROM v_costs WHERE {WINDOW}")
def cost_totals(t: Tables) -> DataFrame:
    return ops.cost_totals(t.costs, AS_OF, 20).select(*six("total_usd"), "calls")


@query(f"SELECT provider, round(sum(cost_usd), 6) AS cost_usd FROM v_costs WHERE {WINDOW} GROUP BY 1")
def cost_by_provider(t: Tables) -> DataFrame:
    return ops.cost_by(t.costs, "provider", AS_OF, 20).select("provider", *six("cost_usd"))


@query(f"SELECT tier, round(sum(cost_usd), 6) AS cost_usd FROM v_costs WHERE {WINDOW} GROUP BY 1")
def cost_by_tier(t: Tables) -> DataFrame:
    return ops.cost_by(t.costs, "tier", AS_OF, 20).select("tier", *six("cost_usd"))


@query(f"""SELECT day, round(c, 6) AS cost_usd, CAST(floor(c / max(c) OVER () * 30) AS INTEGER) AS bar
    FROM (SELECT CAST(ts AS DATE) AS day, sum(cost_usd) AS c FROM v_costs WHERE {WINDOW} GROUP BY 1)""")
def cost_by_day(t: Tables) -> DataFrame:
    return ops.cost_by_day(t.costs, AS_OF, 20).select("day", *six("cost_usd"), "bar")


@query(f"""SELECT CASE WHEN provider IS NOT NULL THEN 'provider' WHEN tier IS NOT NULL THEN 'tier' WHEN day IS NOT NULL THEN 'day' ELSE 'total' END AS dim,
    coalesce(provider, tier, CAST(day AS VARCHAR), 'all') AS name, round(coalesce(sum(cost_usd), 0), 6) AS cost_usd, count(*) AS calls
    FROM (SELECT *, CAST(ts AS DATE) AS day FROM v_costs WHERE {WINDOW}) GROUP BY GROUPING SETS ((provider), (tier), (day), ())""")
def cost_aggregates(t: Tables) -> DataFrame:
    return ops.cost_aggregates(t.costs, AS_OF, 20).select("dim", "name", *six("cost_usd"), "calls")


@query("SELECT round(coalesce(sum(cost_usd), 0), 6) AS spent_usd FROM v_costs WHERE CAST(ts AS DATE) = DATE '2024-01-12'")
def spend_today(t: Tables) -> DataFrame:
    return ops.spend_today(t.costs, "2024-01-12 15:00:00").select(*six("spent_usd"))


@query("""SELECT round(coalesce(sum(cost_usd), 0), 6) AS spent_usd, CAST(0.5 AS DOUBLE) AS budget_usd, coalesce(sum(cost_usd), 0) >= 0.5 AS downgrade
    FROM v_costs WHERE CAST(ts AS DATE) = DATE '2024-01-12'""")
def budget_status(t: Tables) -> DataFrame:
    return ops.budget_status(t.costs, 0.5, "2024-01-12 15:00:00").select(
        *six("spent_usd"), "budget_usd", "downgrade"
    )


@query("""SELECT id, round(coalesce(sum(cost_usd) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS spent_before
    FROM v_costs""")
def running_spend(t: Tables) -> DataFrame:
    return ops.running_spend(t.costs, 0.5).select("id", *six("spent_before"))


@query("""SELECT hits AS cache_hits, 25 AS window_days, round(f, 6) AS avg_fresh_usd, round(c, 6) AS avg_cached_usd, round(hits * greatest(f - c, 0), 4) AS saved_usd,
    CASE WHEN hits > 0 AND f > 0 THEN round(greatest(f - c, 0) / f * 100, 2) END AS savings_pct, hits > 0 AS measured FROM (
    SELECT (SELECT CAST(coalesce(sum(recall_hits), 0) AS BIGINT) FROM v_memories WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 25 DAY) AS hits,
    (SELECT coalesce(avg(cost_usd), 0) FROM v_memories WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 25 DAY) AS f,
    (SELECT coalesce(avg(cost_usd), 0) FROM v_costs WHERE tier = 'embed' AND input_tokens < 100 AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 25 DAY) AS c)""")
def memory_savings(t: Tables) -> DataFrame:
    return ops.memory_savings(t.memories, t.costs, AS_OF, 25)


@query("""SELECT round(cold_usd, 6) AS cold_usd, cold_tokens, cold_calls, round(warm_usd, 6) AS warm_usd, warm_tokens, warm_calls,
    round((cold_usd - warm_usd) / cold_usd * 100, 4) AS usd_saving_pct, round((cold_tokens - warm_tokens) / cold_tokens * 100, 4) AS token_saving_pct,
    round((cold_calls - warm_calls) / cold_calls * 100, 4) AS hit_rate_pct FROM (SELECT
    sum(cost_usd) FILTER (ts < TIMESTAMP '2024-01-22') AS cold_usd, CAST(sum(input_tokens + output_tokens) FILTER (ts < TIMESTAMP '2024-01-22') AS BIGINT) AS cold_tokens,
    count(*) FILTER (ts < TIMESTAMP '2024-01-22') AS cold_calls, sum(cost_usd) FILTER (ts >= TIMESTAMP '2024-01-22') AS warm_usd,
    CAST(sum(input_tokens + output_tokens) FILTER (ts >= TIMESTAMP '2024-01-22') AS BIGINT) AS warm_tokens, count(*) FILTER (ts >= TIMESTAMP '2024-01-22') AS warm_calls
    FROM v_costs WHERE ts >= TIMESTAMP '2024-01-05')""")
def ab_savings(t: Tables) -> DataFrame:
    out = ops.ab_savings(t.costs, "2024-01-05", "2024-01-22")
    four = [F.round(n, 4).alias(n) for n in ("usd_saving_pct", "token_saving_pct", "hit_rate_pct")]
    return out.select(
        *six("cold_usd"), "cold_tokens", "cold_calls", *six("warm_usd"), "warm_tokens", "warm_calls", *four
    )


@query("SELECT id, incident_id, sandbox_outcome, outcome FROM v_outcomes")
def classify_fix(t: Tables) -> DataFrame:
    return ops.classify_fix(t.audit).select("id", "incident_id", "sandbox_outcome", "outcome")


@query("""SELECT i.id AS incident_id, coalesce(round(least(top, score), 4), 0) AS confidence_score FROM v_incidents i LEFT JOIN (
    SELECT incident_id, max(confidence) AS top, avg(confidence) AS score FROM v_ranked WHERE rank <= 5 GROUP BY 1) c ON c.incident_id = i.id""")
def fix_confidence(t: Tables) -> DataFrame:
    top = ca.top_causes(t.incidents, t.causes, 5)
    return ops.fix_confidence(top, rp.replay_confidence(t.incidents, top))


@query("""SELECT incident_id, path, rank, kind, round(confidence, 6) AS confidence FROM (SELECT r.*, f.path, row_number() OVER (PARTITION BY incident_id, f.path ORDER BY rank) AS n
    FROM v_ranked r JOIN (SELECT env_key, name, min(file_paths[1]) AS path FROM v_services GROUP BY ALL) f ON f.name = r.service_name AND f.env_key = r.env_key WHERE rank <= 5) WHERE n = 1""")
def fix_context(t: Tables) -> DataFrame:
    top = ca.top_causes(t.incidents, t.causes, 5)
    return ops.fix_context(top, t.services, 5).select(
        "incident_id", "path", "rank", "kind", *six("confidence")
    )


@query("""SELECT c.incident_id, c.path, c.rank, CASE WHEN length(x.source) > 300 THEN substr(x.source, 1, 300) || chr(10) || '... [truncated at 300 chars]' ELSE x.source END AS body FROM (
    SELECT incident_id, path, rank, row_number() OVER (PARTITION BY incident_id, path ORDER BY rank) AS n FROM (SELECT r.incident_id, r.rank, f.path FROM v_ranked r
    JOIN (SELECT env_key, name, min(file_paths[1]) AS path FROM v_services GROUP BY ALL) f ON f.name = r.service_name AND f.env_key = r.env_key WHERE rank <= 5)) c
    JOIN (SELECT 'pkg' || p_partkey || '/m.py' AS path, repeat(p_name || ' ', p_partkey * 2) AS source FROM part WHERE p_partkey % 3 > 0) x ON x.path = c.path WHERE c.n = 1""")
def fix_context_files(t: Tables) -> DataFrame:
    """Fix context with the text of each file, cut to 300 characters."""
    top = ca.top_causes(t.incidents, t.causes, 5)
    n = F.col("p_partkey")
    files = t.raw("part").where(n % 3 > 0).select(
        text("=pkg", n, "=/m.py").alias("path"), F.repeat(F.concat("p_name", F.lit(" ")), (n * 2).cast("int")).alias("source")
    )
    return ops.fix_context(top, t.services, 5, files, 300).select("incident_id", "path", "rank", "body")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 2 THEN '' ELSE '--- a/src/m' || (o_custkey % 7) || '.py' || chr(10) || '+++ b/src/m' || (o_custkey % 7) || '.py'
    || chr(10) || '@@ -1 +1 @@' || chr(10) || '-x' || chr(10) || '+y' || chr(10) END AS diff, CASE o_orderkey % 3 WHEN 2 THEN '' ELSE 'src/m' || (o_custkey % 7) || '.py' END AS files,
    CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE 'patches b/src/m' || (o_custkey % 7) || '.py' END AS headline FROM orders""")
def parse_diffs(t: Tables) -> DataFrame:
    name = text("=src/m", F.col("o_custkey") % 7, "=.py")
    diff = F.concat(F.lit("--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -1 +1 @@\n-x\n+y"))
    reply = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Here:\n```diff\n"), diff, F.lit("\n```\ndone")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Patch below\n"), diff, F.lit("\n")))
        .otherwise("no patch needed")
    )
    replies = t.raw("orders").select(F.col("o_orderkey").alias("id"), reply.alias("reply"))
    return ops.parse_diffs(replies).select("id", "diff", F.array_join("files", ",").alias("files"), "headline")


@query("""SELECT incident_id, id, ts, rank FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ts DESC, id DESC) AS rank FROM v_audit) WHERE rank <= 50""")
def newest_fix_audit(t: Tables) -> DataFrame:
    return ops.fix_audit_for(t.audit, limit=50).select("incident_id", "id", "ts", "rank")


@query("SELECT incident_id, id, ts FROM v_audit")
def fix_audit_for_incident(t: Tables) -> DataFrame:
    return ops.fix_audit_for(t.audit).select("incident_id", "id", "ts")


@query("SELECT id, ts, incident_id FROM v_audit ORDER BY ts DESC, id DESC LIMIT 20")
def recent_fixes(t: Tables) -> DataFrame:
    return ops.recent_fixes(t.audit).select("id", "ts", "incident_id")


@query("""SELECT coalesce(outcome, '(total)') AS outcome, count(*) AS fixes, round(coalesce(sum(cost_usd), 0), 4) AS cost_usd FROM v_outcomes
    WHERE ts >= TIMESTAMP '1998-12-31' - INTERVAL 365 DAY GROUP BY ROLLUP (outcome)""")
def fix_aggregates(t: Tables) -> DataFrame:
    out = ops.fix_aggregates(ops.classify_fix(t.audit), "1998-12-31", 365)
    return out.select("outcome", "fixes", F.round("cost_usd", 4).alias("cost_usd"))


@query("""SELECT doc_id, greatest(1, length(text) // 4) AS tokens, round(greatest(1, length(text) // 4) / 1000000.0 * 0.5 + (doc_id % 100) / 1000000.0 * 1.5, 9) AS cost_usd FROM documents""")
def token_costs(t: Tables) -> DataFrame:
    tokens = scores.token_estimate(F.col("text"))
    cost = scores.call_cost(tokens, F.col("doc_id") % 100, F.lit(0.5), F.lit(1.5))
    return t.raw("documents").select("doc_id", tokens.alias("tokens"), F.round(cost, 9).alias("cost_usd"))


@query("""SELECT event_type, count(*) AS calls, round(sum(cost_usd), 6) AS cost_usd FROM (SELECT *, provider AS event_type FROM v_costs) GROUP BY 1""")
def ledger_append(t: Tables) -> DataFrame:
    """Costs appended to a ledger in two batches and read back."""
    from tracebeam.operators.tables import append
    from tracebeam.session import scratch_path

    path = scratch_path(t.spark, "cost-ledger")
    cut = F.lit("2024-01-15").cast("timestamp")
    append(t.costs.where(F.col("ts") < cut), path)
    append(t.costs.where(F.col("ts") >= cut), path)
    return t.spark.read.parquet(path).groupBy(F.col("provider").alias("event_type")).agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost_usd"), 6).alias("cost_usd")
    )
