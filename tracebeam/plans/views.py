"""Domain tables derived from the benchmark tables, as DataFrames and as SQL.

Each view exists twice, once per engine, so that the SQL side checks the DataFrame side.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebeam.functions.texts import log_signature, signature_hash, strip
from tracebeam.operators.code_graph import contains_edges
from tracebeam.operators.runtime import all_events

AS_OF = "2024-01-31 00:00:00"
TIERS = ("embed", "tight", "balanced", "deep", "batch")
SANDBOX = ("not_run", "tests_passed", "tests_failed", "apply_failed", "timeout", "tests_passed")
MODULES = 50
MEMBERS = 10


def text(*parts) -> Column:
    """Concatenation of columns (names or numbers cast to text) and literals (prefixed by =)."""
    return F.concat(
        *[
            F.lit(p[1:]) if isinstance(p, str) and p.startswith("=") else
            (F.col(p) if isinstance(p, str) else p).cast("string")
            for p in parts
        ]
    )


class Tables:
    """Benchmark tables and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        """A benchmark table; its zone-less times are read as UTC."""
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({n: F.col(n).cast("timestamp") for n in zoneless})

    @cached_property
    def events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.raw("events").withColumn("k", k)

    @cached_property
    def base(self) -> DataFrame:
        """Events with environment and service."""
        return self.events.select(
            "*", text("=env", F.col("user_id") % 3).alias("env_key"),
            text("=svc", F.col("user_id") % 20).alias("service_name"),
        )

    def of_type(self, *types: str) -> DataFrame:
        return self.base.where(F.col("event_type").isin(*types))

    @cached_property
    def incidents(self) -> DataFrame:
        severity = F.element_at(F.array(*[F.lit(f"sev{n}") for n in (1, 2, 3)]), F.col("k") % 3 + 1)
        return self.of_type("error").select(
            text("=INC-", "event_id").alias("id"), "env_key", text("=error ", "event_id").alias("title"),
            severity.alias("severity"), F.col("ts").alias("detected_at"),
            (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("resolved_at"),
            text("=see deploy-", "k").alias("summary"),
            F.array("service_name", text("=svc", (F.col("user_id") + 1) % 20)).alias("affected_services"),
        )

    @cached_property
    def deployments(self) -> DataFrame:
        return self.of_type("signup").select(
            "env_key", text("=deploy-", F.col("event_id") % 100).alias("deployment_id"),
            "service_name", F.col("ts").alias("at"),
            F.substring(F.md5(F.col("event_id").cast("string")), 1, 12).alias("commit_sha"),
            text("=release ", "k").alias("description"),
        )

    @cached_property
    def metric_shifts(self) -> DataFrame:
        return self.of_type("purchase").select(
            "env_key", "service_name", text("=m", F.col("k") % 5).alias("metric"),
            F.col("ts").alias("started_at"), ((F.col("k") % 3 + 1) * F.lit(10.0)).alias("before"),
            F.col("value").alias("after"), F.lit("ms").alias("unit"),
            F.lit(None).cast("string").alias("description"),
        )

    @cached_property
    def log_lines(self) -> DataFrame:
        letter = F.char(F.col("k") % 7 + 97)
        bad = text(
            "=Error in handler ", letter, "=: request ", "event_id", "= took ", "value", "= ms"
        )
        good = text("=info: request ", "event_id", "= done")
        return self.of_type("click", "view").select(
            "env_key", "service_name", "ts", "k", "event_type",
            F.when(F.col("event_type") == "click", bad).otherwise(good).alias("message"),
        )

    @cached_property
    def log_signatures(self) -> DataFrame:
        rows = self.log_lines.where(F.col("event_type") == "click")
        signed = rows.withColumn("signature", log_signature(F.col("message")))
        return signed.select(
            "env_key", "service_name", "signature",
            signature_hash(F.col("signature")).alias("signature_hash"),
            F.col("ts").alias("first_seen_at"), F.col("k").cast("bigint").alias("count"),
            F.lit("error").alias("level"),
        )

    @cached_property
    def services(self) -> DataFrame:
        return self.base.select(
            "env_key", F.col("service_name").alias("name"),
            text("=repo", F.substring("service_name", 4, 9).cast("int") % 4).alias("repo_key"),
            F.array(
                text("=pkg", F.substring("service_name", 4, 9), "=/m.py"),
                text("=lib", F.substring("service_name", 4, 9), "=/x.py"),
            ).alias("file_paths"),
        ).distinct()

    @cached_property
    def runtime(self) -> dict[str, DataFrame]:
        return {
            "deployments": self.deployments, "metric_shifts": self.metric_shifts,
            "log_signatures": self.log_signatures, "incidents": self.incidents,
        }

    @cached_property
    def causes(self) -> DataFrame:
        return all_events(self.deployments, self.metric_shifts, self.log_signatures)

    @cached_property
    def costs(self) -> DataFrame:
        tiers = F.array(*[F.lit(t) for t in TIERS])
        return self.events.select(
            F.col("event_id").alias("id"), "ts", F.col("event_type").alias("provider"),
            text("=model", F.col("user_id") % 4).alias("model"),
            F.element_at(tiers, F.col("k") % 5 + 1).alias("tier"),
            F.col("k").cast("bigint").alias("input_tokens"),
            (F.col("event_id") % 500).alias("output_tokens"),
            (F.col("value") / 10000).alias("cost_usd"),
        )

    @cached_property
    def samples(self) -> DataFrame:
        return self.of_type("purchase").select(
            "env_key", "service_name", text("=m", F.col("k") % 5).alias("metric"), "ts", "value"
        )

    @cached_property
    def all_calls(self) -> DataFrame:
        return self.raw("lineitem").select(
            text("=repo", F.col("l_partkey") % 4).alias("repo_key"),
            text("=pkg", F.col("l_partkey") % 10, "=.p", "l_partkey").alias("caller"),
            text("=svc", F.col("l_suppkey") % 10, "=.s", "l_suppkey").alias("callee"),
            text("=src/p", "l_partkey", "=.py").alias("file_path"),
            F.col("l_linenumber").alias("line"), F.lit("exact").alias("derivation"), "l_shipdate",
        )

    @cached_property
    def calls(self) -> DataFrame:
        return self.all_calls.where(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")).drop("l_shipdate")

    @cached_property
    def every_call(self) -> DataFrame:
        return self.all_calls.drop("l_shipdate")

    @cached_property
    def baseline(self) -> DataFrame:
        return self.all_calls.where(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp")).select(
            "repo_key", F.lit("1999-01-01").cast("timestamp").alias("captured_at"), "caller", "callee",
            "file_path", "line",
        )

    @cached_property
    def call_nodes(self) -> DataFrame:
        parts = self.raw("part").select(
            text("=repo", F.col("p_partkey") % 4).alias("repo_key"),
            text("=pkg", F.col("p_partkey") % 10, "=.p", "p_partkey").alias("qualified_name"),
            text("=src/p", "p_partkey", "=.py").alias("file_path"),
            text("=(", "p_size", "=)").alias("signature"),
        )
        return parts

    @cached_property
    def vectors(self) -> DataFrame:
        n = F.col("vec_id")
        return self.raw("embeddings").select(
            F.col("vec_id").alias("id"), text("=repo", F.col("label") % 4).alias("repo_key"),
            F.col("embedding").alias("vector"),
            text("=pkg", n % MODULES, "=.f", n).alias("qualified_name"),
            F.when(n % 2 == 0, "function").otherwise("class").alias("kind"),
        )

    @cached_property
    def vector_contains(self) -> DataFrame:
        """File -> function edges of the vector nodes."""
        return self.vectors.select(
            "repo_key", F.regexp_replace("qualified_name", r"\.f\d+$", ".py").alias("parent"),
            F.lit("file").alias("parent_kind"), F.col("qualified_name").alias("child"),
        )

    @cached_property
    def memories(self) -> DataFrame:
        vec = self.raw("embeddings").select(F.col("vec_id").alias("n"), "embedding", "label")
        doc = self.raw("documents").select(F.col("doc_id").alias("n"), F.col("text").alias("answer"))
        made = self.events.select(
            F.col("event_id").alias("n"), F.col("ts").alias("created_at"), "user_id", "k", "value",
            "event_type",
        )
        return vec.join(made, "n").join(doc, "n", "left").select(
            text("=mem-", "n").alias("id"), text("=repo", F.col("label") % 4).alias("repo_key"),
            text("=question ", "n").alias("question"), "answer", F.col("embedding").alias("vector"),
            "created_at", F.col("k").cast("bigint").alias("recall_hits"),
            (F.col("value") / 10000).alias("cost_usd"), text("=u", "user_id").alias("user_id"),
            F.col("event_type").alias("origin_agent"), text("=host", F.col("user_id") % 5).alias("machine_id"),
            text("=s", F.col("n") % 30).alias("origin_session_id"),
            text("=team", F.col("n") % 3).alias("team_id"),
            F.create_map(F.lit("original_session_id"), text("=s", (F.col("n") + 1) % 30)).alias("metadata"),
        )

    @cached_property
    def write_log(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("seq"), "ts", text("=repo", F.col("user_id") % 4).alias("repo_key"),
            text("=u", "user_id").alias("user_id"), F.col("event_type").alias("origin_agent"),
            F.when(F.col("k") % 3 != 0, text("=src", F.col("k") % 3)).alias("source"),
            F.when(F.col("value") > 30, "folded").otherwise("inserted").alias("outcome"),
            text("=mem-", F.col("event_id") % 200).alias("resulting_memory_id"),
        )

    @cached_property
    def turns(self) -> DataFrame:
        started = F.lit("2024-01-01").cast("timestamp")
        minutes = F.col("conv_id") * 60 + F.col("turn")
        return self.raw("conversations").where(F.col("role").isin("user", "assistant")).select(
            text("=s", "conv_id").alias("session_id"), F.col("turn").alias("pos"), "role",
            strip(F.col("text")).alias("text"),
            F.timestamp_micros(F.unix_micros(started) + minutes * 60_000_000).alias("ts"),
            text("=c", "conv_id", "=-", "turn").alias("message_id"), "conv_id", "turn",
        )

    @cached_property
    def function_names(self) -> DataFrame:
        """One function per part: module by key, every third in a class."""
        n = F.col("p_partkey")
        module = text("=pkg", n % MODULES)
        in_class = F.col("p_partkey") % 3 == 0
        parent = F.when(in_class, F.concat(module, F.lit(".C")))
        return self.raw("part").select(
            "p_partkey", text("=repo", n % MODULES % 4).alias("repo_key"),
            F.concat(F.coalesce(parent, module), text("=.f", n)).alias("qualified_name"),
            text("=f", n).alias("name"), text("=pkg", n % MODULES, "=/m.py").alias("file_path"),
            parent.alias("parent_class"), text("=(x, y=", "p_size", "=)").alias("signature"),
        )

    @cached_property
    def call_texts(self) -> DataFrame:
        """Call sites written in six ways by line number."""
        t = F.col("l_suppkey")
        x = text(t % MODULES)
        forms = [
            text("=pkg", x, "=.f", t), text("=self.f", t), text("=al", x, "=.f", t),
            text("=mem", x, "=.f", t), text("=f", t), text("=g", t % MEMBERS),
        ]
        callee = F.element_at(F.array(*forms), F.col("l_linenumber") % 6 + 1)
        return self.raw("lineitem").select(
            "l_partkey", "l_orderkey", F.col("l_linenumber").alias("line"), callee.alias("callee")
        )

    @cached_property
    def functions(self) -> DataFrame:
        per_caller = self.call_texts.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
            F.array_sort(F.collect_list(F.struct("l_orderkey", "line", "callee"))).alias("c")
        )
        calls = F.transform("c", lambda c: F.struct(c["callee"].alias("callee"), c["line"].alias("line")))
        none = F.array().cast("array<struct<callee: string, line: int>>")
        return self.function_names.join(per_caller, "p_partkey", "left").select(
            *self.function_names.columns, F.coalesce(calls, none).alias("calls")
        ).withColumn("n_calls", F.size("calls"))

    @cached_property
    def files(self) -> DataFrame:
        """One file per module; every file has the same imports."""
        imp = lambda module, names, alias: (
            f"named_struct('module', {module}, 'names', {names}, 'alias_of', {alias}, "
            "'line', 1, 'is_relative', false)"
        )
        numbers = f"sequence(0, {MODULES - 1})"
        as_module = f"transform({numbers}, i -> {imp('concat(\"pkg\", i)', 'cast(array() as array<string>)', 'map(concat(\"al\", i), concat(\"pkg\", i))')})"
        as_class = f"transform({numbers}, i -> {imp('concat(\"pkg\", i)', 'array(\"C\")', 'map(concat(\"mem\", i), \"C\")')})"
        members = f"transform(sequence(0, {MEMBERS - 1}), i -> {imp('concat(\"pkg\", i)', 'array(concat(\"f\", i))', 'map(concat(\"g\", i), concat(\"f\", i))')})"
        imports = F.expr(f"concat({as_module}, {as_class}, {members})")
        return self.function_names.groupBy("repo_key", F.col("file_path").alias("path")).agg(
            (F.count(F.lit(1)) * 10).alias("loc")
        ).select(
            "repo_key", "path", F.lit("python").alias("language"), "loc",
            F.regexp_replace("path", "/m[.]py$", "").alias("module_name"), imports.alias("imports"),
            F.array().cast("array<string>").alias("parse_errors"),
        )

    @cached_property
    def classes(self) -> DataFrame:
        return self.function_names.where(F.col("parent_class").isNotNull()).groupBy(
            "repo_key", F.col("parent_class").alias("qualified_name"), "file_path"
        ).agg(F.count(F.lit(1)).alias("n_methods"))

    @cached_property
    def contains(self) -> DataFrame:
        return contains_edges(self.files, self.function_names, self.classes)

    @cached_property
    def repos(self) -> DataFrame:
        return self.raw("nation").select(
            text("=repo", "n_nationkey").alias("key"), text("=org/", "n_name").alias("spec"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("n_nationkey") * 3600).alias("indexed_at"),
        )

    @cached_property
    def audit(self) -> DataFrame:
        outcomes = F.array(*[F.lit(s) for s in SANDBOX])
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"),
            text("=INC-", F.col("o_orderkey") % 200).alias("incident_id"),
            F.element_at(outcomes, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("sandbox_outcome"),
            (F.col("o_totalprice") / 500000).alias("confidence_score"),
            (F.col("o_custkey") / 1000).alias("cost_usd"), "o_orderpriority",
        )

    @cached_property
    def messages(self) -> DataFrame:
        """Chat-like notes, one per order."""
        return self.raw("orders").select(
            text("=c", F.col("o_custkey") % 10).alias("channel"),
            text("o_orderkey", "=.000100").alias("ts"), text("=U", F.col("o_custkey") % 50).alias("author"),
            text("=INC-", F.col("o_orderkey") % 4000, "= hits svc", F.col("o_custkey") % 25, "= badly").alias("text"),
            "o_orderkey", "o_custkey",
        )


K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
SIG = (
    "substr(regexp_replace({0}, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}"
    "|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9:.]+Z?|0x[0-9a-fA-F]+|[0-9a-fA-F]{{32,}}"
    "|[0-9]+(?:[.][0-9]+)?', '<n>', 'g'), 1, 200)"
)

SQL_VIEWS = {
    "v_events": f"SELECT *, {K} AS k, 'env' || (user_id % 3) AS env_key, 'svc' || (user_id % 20) AS service_name FROM events",
    "v_incidents": """SELECT 'INC-' || event_id AS id, env_key, 'error ' || event_id AS title, 'sev' || (k % 3 + 1) AS severity,
        ts AS detected_at, ts + INTERVAL 1 HOUR AS resolved_at, 'see deploy-' || k AS summary,
        [service_name, 'svc' || ((user_id + 1) % 20)] AS affected_services FROM v_events WHERE event_type = 'error'""",
    "v_deployments": """SELECT env_key, 'deploy-' || (event_id % 100) AS deployment_id, service_name, ts AS at,
        substr(md5(CAST(event_id AS VARCHAR)), 1, 12) AS commit_sha, 'release ' || k AS description
        FROM v_events WHERE event_type = 'signup'""",
    "v_metric_shifts": """SELECT env_key, service_name, 'm' || (k % 5) AS metric, ts AS started_at,
        (k % 3 + 1) * CAST(10.0 AS DOUBLE) AS before, value AS after, 'ms' AS unit
        FROM v_events WHERE event_type = 'purchase'""",
    "v_log_lines": """SELECT env_key, service_name, ts, k, event_type, CASE WHEN event_type = 'click'
        THEN 'Error in handler ' || chr(97 + k % 7) || ': request ' || event_id || ' took ' || value || ' ms'
        ELSE 'info: request ' || event_id || ' done' END AS message
        FROM v_events WHERE event_type IN ('click', 'view')""",
    "v_log_signatures": f"""SELECT env_key, service_name, signature, substr(sha1(signature), 1, 16) AS signature_hash,
        first_seen_at, count, level FROM (SELECT env_key, service_name, {SIG.format('message')} AS signature,
        ts AS first_seen_at, CAST(k AS BIGINT) AS count, 'error' AS level FROM v_log_lines WHERE event_type = 'click')""",
    "v_services": """SELECT DISTINCT env_key, service_name AS name, 'repo' || (CAST(substr(service_name, 4) AS INTEGER) % 4) AS repo_key,
        ['pkg' || substr(service_name, 4) || '/m.py', 'lib' || substr(service_name, 4) || '/x.py'] AS file_paths FROM v_events""",
    "v_causes": """SELECT 'Deployment' AS kind, env_key, deployment_id AS event_key, at, service_name, deployment_id, commit_sha,
        NULL AS metric, CAST(NULL AS DOUBLE) AS before, CAST(NULL AS DOUBLE) AS after, NULL AS unit, NULL AS signature FROM v_deployments
        UNION ALL SELECT 'MetricShift', env_key, service_name || '/' || metric || '/' || epoch_us(started_at), started_at, service_name,
        NULL, NULL, metric, before, after, unit, NULL FROM v_metric_shifts
        UNION ALL SELECT 'LogSignature', env_key, service_name || '/' || signature_hash, first_seen_at, service_name,
        NULL, NULL, NULL, NULL, NULL, NULL, signature FROM v_log_signatures""",
    "v_pairs": """SELECT i.id AS incident_id, i.env_key, i.detected_at, i.affected_services, i.summary, c.* EXCLUDE (env_key),
        (epoch_us(i.detected_at) - epoch_us(c.at)) / 1000000.0::DOUBLE AS delta_seconds
        FROM v_incidents i JOIN v_causes c ON i.env_key = c.env_key
        AND c.at >= i.detected_at - INTERVAL 6 HOUR AND c.at <= i.detected_at + INTERVAL 1 MINUTE""",
    "v_proximity": """SELECT * FROM (SELECT *, exp(-ln(2.0::DOUBLE) * delta_seconds / 300.0::DOUBLE) AS proximity FROM v_pairs
        WHERE delta_seconds > 0) WHERE proximity >= 0.05""",
    "v_scored": """SELECT *, CASE WHEN named IS NOT NULL THEN least(1.0, c1 + 0.8) ELSE c1 END AS confidence,
        (CASE WHEN affected THEN 'temporal_proximity+lagged_correlation' ELSE 'temporal_proximity' END)
        || (CASE WHEN named IS NOT NULL THEN '+explicit_reference' ELSE '' END) AS strategy
        FROM (SELECT *, CASE WHEN affected THEN least(1.0, proximity + 0.6) ELSE proximity END AS c1
        FROM (SELECT *, kind = 'Deployment' AND list_contains(affected_services, service_name) AS affected,
        CASE WHEN kind <> 'Deployment' THEN NULL WHEN contains(summary, deployment_id) THEN 'deployment_id ''' || deployment_id || ''''
        WHEN contains(summary, commit_sha) THEN 'commit_sha ''' || commit_sha || '''' END AS named FROM v_proximity))""",
    "v_ranked": """SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY confidence DESC, delta_seconds, kind, event_key) AS rank FROM v_scored""",
    "v_service_events": """SELECT 'deployment' AS kind, 1 AS kind_order, env_key, service_name, at, deployment_id AS id, deployment_id AS sort_id,
        'Deployment ' || deployment_id || ' (sha: ' || commit_sha || ') - ' || description AS text FROM v_deployments
        UNION ALL SELECT 'metric_shift', 2, env_key, service_name, started_at, NULL, metric,
        metric || ': ' || before || unit || ' -> ' || after || unit FROM v_metric_shifts
        UNION ALL SELECT 'log_signature', 3, env_key, service_name, first_seen_at, NULL, signature_hash,
        'Log: "' || signature || '" (count=' || (CASE WHEN count = 0 THEN '' ELSE CAST(count AS VARCHAR) END) || ')' FROM v_log_signatures
        UNION ALL SELECT 'incident', 4, env_key, s, detected_at, id, id, title
        FROM (SELECT *, unnest(list_distinct(affected_services)) AS s FROM v_incidents)""",
    "v_once": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY env_key, service_name, kind, at ORDER BY kind_order, sort_id) AS again
        FROM v_service_events) WHERE again = 1""",
    "v_timeline": """SELECT i.id AS incident_id, i.detected_at, i.env_key, i.s AS service_name, o.kind, o.at, o.kind_order, o.sort_id, o.text AS description
        FROM (SELECT *, unnest(list_distinct(affected_services)) AS s FROM v_incidents) i
        JOIN v_once o ON o.env_key = i.env_key AND o.service_name = i.s
        AND o.at >= i.detected_at - INTERVAL 6 HOUR AND o.at <= coalesce(i.resolved_at, i.detected_at) + INTERVAL 6 HOUR""",
    "v_marked": """SELECT t.*, CASE WHEN t.kind = 'incident' THEN '▶ INCIDENT' WHEN c.incident_id IS NOT NULL THEN '↗ cause'
        WHEN t.at >= t.detected_at THEN '↓ response' ELSE '' END AS marker FROM v_timeline t LEFT JOIN (SELECT DISTINCT incident_id,
        CASE kind WHEN 'Deployment' THEN 'deployment' WHEN 'MetricShift' THEN 'metric_shift' ELSE 'log_signature' END AS kind,
        service_name, at FROM v_ranked WHERE rank <= 5) c
        ON c.incident_id = t.incident_id AND c.kind = t.kind AND c.service_name = t.service_name AND c.at = t.at""",
    "v_costs": """SELECT event_id AS id, ts, event_type AS provider, 'model' || (user_id % 4) AS model,
        ['embed', 'tight', 'balanced', 'deep', 'batch'][k % 5 + 1] AS tier, CAST(k AS BIGINT) AS input_tokens,
        event_id % 500 AS output_tokens, value / 10000 AS cost_usd FROM v_events""",
    "v_samples": """SELECT env_key, service_name, 'm' || (k % 5) AS metric, ts, value FROM v_events WHERE event_type = 'purchase'""",
    "v_all_calls": """SELECT 'repo' || (l_partkey % 4) AS repo_key, 'pkg' || (l_partkey % 10) || '.p' || l_partkey AS caller,
        'svc' || (l_suppkey % 10) || '.s' || l_suppkey AS callee, 'src/p' || l_partkey || '.py' AS file_path,
        l_linenumber AS line, 'exact' AS derivation, l_shipdate FROM lineitem""",
    "v_calls": "SELECT * EXCLUDE (l_shipdate) FROM v_all_calls WHERE l_shipdate >= TIMESTAMP '1997-01-01'",
    "v_every_call": "SELECT * EXCLUDE (l_shipdate) FROM v_all_calls",
    "v_baseline": "SELECT * EXCLUDE (l_shipdate) FROM v_all_calls WHERE l_shipdate < TIMESTAMP '1999-01-01'",
    "v_nodes": """SELECT 'repo' || (p_partkey % 4) AS repo_key, 'pkg' || (p_partkey % 10) || '.p' || p_partkey AS qualified_name,
        'src/p' || p_partkey || '.py' AS file_path, '(' || p_size || ')' AS signature FROM part""",
    "v_vectors": """SELECT vec_id AS id, 'repo' || (label % 4) AS repo_key, CAST(embedding AS DOUBLE[]) AS vector,
        'pkg' || (vec_id % 50) || '.f' || vec_id AS qualified_name, 'pkg' || (vec_id % 50) || '.py' AS parent FROM embeddings""",
    "v_sims": """SELECT q.id AS query_id, q.repo_key, v.id AS id, v.qualified_name, v.parent,
        round(list_cosine_similarity(q.vector, v.vector), 9) AS sim FROM v_vectors q JOIN v_vectors v ON q.repo_key = v.repo_key""",
    "v_memories": """SELECT 'mem-' || e.vec_id AS id, 'repo' || (e.label % 4) AS repo_key, 'question ' || e.vec_id AS question, d.text AS answer,
        CAST(e.embedding AS DOUBLE[]) AS vector, m.ts AS created_at, CAST(m.k AS BIGINT) AS recall_hits, m.value / 10000 AS cost_usd,
        'u' || m.user_id AS user_id, m.event_type AS origin_agent, 'host' || (m.user_id % 5) AS machine_id,
        's' || (e.vec_id % 30) AS origin_session_id, 's' || ((e.vec_id + 1) % 30) AS original_session_id, 'team' || (e.vec_id % 3) AS team_id, e.vec_id AS n
        FROM embeddings e JOIN v_events m ON m.event_id = e.vec_id LEFT JOIN documents d ON d.doc_id = e.vec_id""",
    "v_write_log": """SELECT event_id AS seq, ts, 'repo' || (user_id % 4) AS repo_key, 'u' || user_id AS user_id, event_type AS origin_agent,
        CASE WHEN k % 3 <> 0 THEN 'src' || (k % 3) END AS source, CASE WHEN value > 30 THEN 'folded' ELSE 'inserted' END AS outcome,
        'mem-' || (event_id % 200) AS resulting_memory_id FROM v_events""",
    "v_turns": """SELECT 's' || conv_id AS session_id, turn AS pos, role, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS text,
        TIMESTAMP '2024-01-01' + to_minutes(conv_id * 60 + turn) AS ts, 'c' || conv_id || '-' || turn AS message_id, conv_id, turn
        FROM conversations WHERE role IN ('user', 'assistant')""",
    "v_chunked": """SELECT * FROM (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos) AS BIGINT) AS chunk_id
        FROM v_turns) WHERE chunk_id > 0""",
    "v_chunks": """SELECT session_id, chunk_id, max(CASE WHEN role = 'user' THEN text END) AS question,
        string_agg(CASE WHEN role = 'assistant' AND text <> '' THEN text END, chr(10) || chr(10) ORDER BY pos) AS prose,
        CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS n_responses, max(CASE WHEN role = 'user' THEN ts END) AS start_ts,
        arg_max(ts, pos) AS end_ts FROM v_chunked GROUP BY session_id, chunk_id""",
    "v_paired": """SELECT session_id, chunk_id, question, CASE WHEN prose IS NULL THEN '(no assistant response captured)'
        WHEN length(prose) > 3000 THEN substr(prose, 1, 3000) || chr(10) || '…[truncated]' ELSE prose END AS response,
        n_responses, start_ts, end_ts FROM v_chunks""",
    "v_function_names": """SELECT p_partkey, 'repo' || (p_partkey % 50 % 4) AS repo_key, CASE WHEN p_partkey % 3 = 0 THEN 'pkg' || (p_partkey % 50) || '.C' END AS parent_class,
        'pkg' || (p_partkey % 50) || (CASE WHEN p_partkey % 3 = 0 THEN '.C' ELSE '' END) || '.f' || p_partkey AS qualified_name,
        'pkg' || (p_partkey % 50) AS module_name, 'pkg' || (p_partkey % 50) || '/m.py' AS file_path, '(x, y=' || p_size || ')' AS signature FROM part""",
    "v_sites": """SELECT f.repo_key, f.qualified_name AS caller, f.file_path, f.parent_class, f.module_name, l.l_linenumber AS line, l.l_orderkey,
        l.l_linenumber % 6 AS form, CASE l.l_linenumber % 6 WHEN 0 THEN 'pkg' || (l_suppkey % 50) || '.f' || l_suppkey WHEN 1 THEN 'self.f' || l_suppkey
        WHEN 2 THEN 'al' || (l_suppkey % 50) || '.f' || l_suppkey WHEN 3 THEN 'mem' || (l_suppkey % 50) || '.f' || l_suppkey
        WHEN 4 THEN 'f' || l_suppkey ELSE 'g' || (l_suppkey % 10) END AS callee_text,
        CASE l.l_linenumber % 6 WHEN 0 THEN 'pkg' || (l_suppkey % 50) || '.f' || l_suppkey WHEN 1 THEN f.parent_class || '.f' || l_suppkey
        WHEN 2 THEN 'pkg' || (l_suppkey % 50) || '.f' || l_suppkey WHEN 3 THEN 'pkg' || (l_suppkey % 50) || '.C.f' || l_suppkey
        WHEN 4 THEN f.module_name || '.f' || l_suppkey ELSE 'pkg' || (l_suppkey % 10) || '.f' || (l_suppkey % 10) END AS target
        FROM lineitem l JOIN v_function_names f ON f.p_partkey = l.l_partkey""",
    "v_resolved": """SELECT s.*, coalesce(t.qualified_name, m.qualified_name) AS callee, CASE WHEN t.qualified_name IS NULL AND m.qualified_name IS NULL THEN '<unresolved>'
        WHEN t.qualified_name IS NULL THEN 'import_member'
        ELSE ['exact', 'self_method', 'import_alias', 'import_member', 'same_module', 'import_member'][form + 1] END AS strategy
        FROM v_sites s LEFT JOIN v_function_names t ON t.repo_key = s.repo_key AND t.qualified_name = s.target
        LEFT JOIN v_function_names m ON s.form = 4 AND length(s.callee_text) = 2 AND m.repo_key = s.repo_key
        AND m.qualified_name = 'pkg' || substr(s.callee_text, 2) || '.' || s.callee_text""",
    "v_files": """SELECT repo_key, file_path AS path, module_name, CAST(count(*) * 10 AS BIGINT) AS loc FROM v_function_names GROUP BY ALL""",
    "v_contains": """SELECT repo_key, file_path AS parent, 'file' AS parent_kind, qualified_name AS child FROM v_function_names
        UNION ALL SELECT DISTINCT repo_key, file_path, 'file', parent_class FROM v_function_names WHERE parent_class IS NOT NULL
        UNION ALL SELECT repo_key, parent_class, 'class', qualified_name FROM v_function_names WHERE parent_class IS NOT NULL""",
    "v_repos": """SELECT 'repo' || n_nationkey AS key, 'org/' || n_name AS spec, TIMESTAMP '2024-01-01' + to_hours(n_nationkey) AS indexed_at FROM nation""",
    "v_audit": """SELECT o_orderkey AS id, o_orderdate AS ts, 'INC-' || (o_orderkey % 200) AS incident_id,
        ['not_run', 'tests_passed', 'tests_failed', 'apply_failed', 'timeout', 'tests_passed'][o_orderkey % 6 + 1] AS sandbox_outcome,
        o_totalprice / 500000 AS confidence_score, o_custkey / 1000 AS cost_usd FROM orders""",
    "v_outcomes": """SELECT *, CASE WHEN sandbox_outcome = 'not_run' THEN 'proposed' WHEN sandbox_outcome = 'tests_passed' AND confidence_score >= 0.6 THEN 'accepted'
        WHEN sandbox_outcome IN ('tests_failed', 'apply_failed') THEN 'rejected' ELSE 'inconclusive' END AS outcome FROM v_audit""",
    "v_messages": """SELECT 'c' || (o_custkey % 10) AS channel, o_orderkey || '.000100' AS ts, 'U' || (o_custkey % 50) AS author,
        'INC-' || (o_orderkey % 4000) || ' hits svc' || (o_custkey % 25) || ' badly' AS text, o_orderkey, o_custkey FROM orders""",
    "v_drift": """SELECT repo_key, caller, callee, 'new_dependency' AS kind, 'warning' AS severity, NULL AS boundary_name,
        'New dependency: ' || caller || ' → ' || callee || '. This edge was absent in the baseline captured at 1999-01-01T00:00:00' AS description
        FROM (SELECT DISTINCT repo_key, caller, callee FROM v_calls EXCEPT SELECT DISTINCT repo_key, caller, callee FROM v_baseline)
        UNION ALL SELECT repo_key, caller, callee, 'removed_dependency', 'info', NULL,
        'Dependency removed: ' || caller || ' → ' || callee || '. This edge existed in the baseline but is no longer present.'
        FROM (SELECT DISTINCT repo_key, caller, callee FROM v_baseline EXCEPT SELECT DISTINCT repo_key, caller, callee FROM v_calls)
        UNION ALL SELECT repo_key, caller, callee, 'boundary_violation', 'critical', rule,
        'Boundary violation (' || rule || '): ' || caller || ' depends on ' || callee || '. ' || (CASE rule WHEN 'one-to-two' THEN 'keep apart' ELSE '' END)
        FROM (SELECT *, CASE WHEN regexp_matches(caller, '^pkg1[.].*$') AND regexp_matches(callee, '^svc2[.]s[0-9]*2$') THEN 'one-to-two'
        WHEN regexp_matches(caller, '^pkg[3-4][.]p.$') AND regexp_matches(callee, '^svc[^0-6][.].*$') THEN 'short-names' END AS rule FROM v_calls) WHERE rule IS NOT NULL""",
    "v_findings": """SELECT 'drift/' || kind AS rule_id, CASE WHEN kind = 'boundary_violation' THEN 'critical' WHEN severity = 'warning' THEN 'warning' ELSE 'note' END AS severity,
        description AS message, repo_key, caller, callee, boundary_name FROM v_drift""",
}


def quoted(sql: str) -> str:
    """``sql`` with the column name ``at``, a keyword in some dialects, in double quotes."""
    pieces = sql.split("'")
    pieces[::2] = [re.sub(r'(?<!")\bat\b(?!")', '"at"', piece) for piece in pieces[::2]]
    return "'".join(pieces)


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it uses, directly or through other views."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", body):
            if name in SQL_VIEWS and name not in needed:
                visit(SQL_VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    views = ", ".join(f"{name} AS ({SQL_VIEWS[name]})" for name in needed)
    body = sql.strip()
    if not views:
        return quoted(body)
    rest = re.match(r"WITH (RECURSIVE )?", body, re.IGNORECASE)
    if rest:
        return quoted(f"WITH {rest.group(1) or ''}{views}, {body[rest.end():]}")
    return quoted(f"WITH {views} {body}")
