"""Queries over the file sources: each parses documents that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracebeam.operators import code_graph as cg
from tracebeam.operators import drift as dr
from tracebeam.plans.causality import six
from tracebeam.plans.code import BOUNDARIES
from tracebeam.plans.registry import query
from tracebeam.plans.views import Tables, text
from tracebeam.session import materialize, scratch_path, spread
from tracebeam.sources import reports, runtime_files, source_tree, transcripts


def iso(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def event_docs(t: Tables) -> DataFrame:
    """One document per event, as a list or under ``events``; every seventh has a bad confidence."""
    kind = F.col("event_type")
    confidence = F.when(F.col("k") % 7 == 0, F.lit(1.5)).when(F.col("k") % 7 == 1, F.lit(0.5))
    record = F.struct(
        F.when(kind == "error", "incident").when(kind == "signup", "deployment")
        .when(kind == "purchase", "metric_shift").when(kind == "click", "log_signature")
        .otherwise("heartbeat").alias("kind"),
        confidence.alias("confidence"),
        F.when(kind == "error", text("=INC-", "event_id")).alias("id"),
        F.when(kind == "error", text("=error ", "event_id")).alias("title"),
        F.when(kind == "signup", text("=deploy-", "event_id")).alias("deployment_id"),
        F.when(kind != "error", F.col("service_name")).alias("service_name"),
        F.when(kind == "purchase", text("=m", F.col("k") % 5)).alias("metric"),
        F.when(kind == "purchase", F.col("value")).alias("after"),
        F.when(kind == "click", text("=failure number ", F.col("k") % 4)).alias("signature"),
        F.when(kind == "signup", iso("ts")).alias("at"),
        F.when(kind == "purchase", iso("ts")).alias("started_at"),
        F.when(kind == "click", iso("ts")).alias("first_seen_at"),
        F.when(kind == "error", iso("ts")).alias("detected_at"),
    )
    listed = F.to_json(F.array(record))
    value = F.when(F.col("k") % 2 == 0, listed).otherwise(F.concat(F.lit('{"events": '), listed, F.lit("}")))
    return t.base.select(text("=/in/e", "event_id", "=.json").alias("path"), "env_key", value.alias("value"))


@query("""SELECT event_type AS kind, env_key, 'file:e' || event_id || '.json' AS source, CASE WHEN k % 7 = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, ts AS at,
    CASE event_type WHEN 'error' THEN 'INC-' || event_id WHEN 'signup' THEN 'deploy-' || event_id WHEN 'purchase' THEN service_name || 'm' || (k % 5) ELSE service_name || 'failure number ' || (k % 4) END AS key
    FROM v_events WHERE event_type <> 'view' AND k % 7 <> 0""")
def runtime_event_files(t: Tables) -> DataFrame:
    tables, _ = runtime_files.parse_runtime_events(event_docs(t))
    shape = {
        "incident": ("error", F.col("detected_at"), F.col("id")),
        "deployment": ("signup", F.col("at"), F.col("deployment_id")),
        "metric_shift": ("purchase", F.col("started_at"), F.concat("service_name", "metric")),
        "log_signature": ("click", F.col("first_seen_at"), F.concat("service_name", "signature")),
    }
    out = None
    for name, (kind, at, key) in shape.items():
        rows = tables[name].select(
            F.lit(kind).alias("kind"), "env_key", "source", "confidence", at.alias("at"), key.alias("key")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT env_key, count(*) AS n FROM v_events WHERE event_type = 'view' OR k % 7 = 0 GROUP BY 1""")
def runtime_event_rejects(t: Tables) -> DataFrame:
    _, rejected = runtime_files.parse_runtime_events(event_docs(t))
    return rejected.groupBy("env_key").agg(F.count(F.lit(1)).alias("n"))


def postmortem_docs(t: Tables) -> DataFrame:
    """One postmortem per error event with a deployment, a metric shift and a log row."""
    none = F.lit(None).cast("string")
    row = lambda kind, **f: F.struct(
        F.lit(kind).alias("kind"), iso("ts").alias("at"), F.col("service_name").alias("service"),
        *[f.get(n, none).alias(n) for n in ("deployment_id", "metric", "before", "after", "signature", "name", "repo_key")],
    )
    timeline = F.array(
        row("deployment", deployment_id=text("=d", "event_id")),
        row("metric_shift", metric=F.lit("p99"), before=F.lit("n/a"), after=F.col("value").cast("string")),
        row("log_signature", signature=text("=oops ", F.col("k") % 4)),
        row("service", name=F.col("service_name"), repo_key=text("=repo", F.col("k") % 4)),
    )
    incident = F.struct(
        text("=INC-", "event_id").alias("id"), text("=error ", "event_id").alias("title"), text("=e", "event_id").alias("env"),
        iso("ts").alias("detected_at"), F.array("service_name", F.lit("edge")).alias("affected_services"),
    )
    return t.of_type("error").select(
        text("=/pm/p", "event_id", "=.json").alias("path"),
        F.to_json(F.struct(incident.alias("incident"), timeline.alias("timeline"))).alias("value"),
    )


@query("""SELECT 'e' || event_id AS env_key, 'INC-' || event_id AS id, 'postmortem:p' || event_id || '.json' AS source, 'unknown' AS severity, ts AS detected_at, service_name || ',edge' AS affected FROM v_events WHERE event_type = 'error'""")
def postmortem_incidents(t: Tables) -> DataFrame:
    incidents, timeline = runtime_files.parse_postmortems(postmortem_docs(t))
    out = runtime_files.timeline_to_tables(incidents, timeline)["incident"]
    return out.select("env_key", "id", "source", "severity", "detected_at", F.array_join("affected_services", ",").alias("affected"))


@query("""SELECT 'e' || event_id AS env_key, service_name, 'p99' AS metric, ts AS started_at, CAST(NULL AS DOUBLE) AS before, value AS after FROM v_events WHERE event_type = 'error'""")
def postmortem_metrics(t: Tables) -> DataFrame:
    incidents, timeline = runtime_files.parse_postmortems(postmortem_docs(t))
    out = runtime_files.timeline_to_tables(incidents, timeline)["metric_shift"]
    return out.select("env_key", "service_name", "metric", "started_at", "before", "after")


@query("""SELECT 'e' || event_id AS env_key, service_name AS name, 'repo' || (k % 4) AS repo_key FROM v_events WHERE event_type = 'error' UNION ALL SELECT 'e' || event_id, 'edge', NULL FROM v_events WHERE event_type = 'error'""")
def postmortem_services(t: Tables) -> DataFrame:
    incidents, timeline = runtime_files.parse_postmortems(postmortem_docs(t))
    return runtime_files.timeline_to_tables(incidents, timeline)["service"].select("env_key", "name", "repo_key")


@query("""SELECT env_key, service_name, 'm' || (k % 5) AS metric, date_trunc('second', ts) AS ts, value FROM v_events WHERE event_type = 'purchase' AND k % 3 <> 0""")
def metric_sample_replies(t: Tables) -> DataFrame:
    epoch = F.unix_seconds("ts").cast("string")
    reply = F.concat(
        F.lit('{"status":"'), F.when(F.col("k") % 3 == 0, "error").otherwise("success"),
        F.lit('","data":{"result":[{"metric":{},"value":['), epoch, F.lit(',"'), F.col("value").cast("string"), F.lit('"]}]}}'),
    )
    docs = t.of_type("purchase").select("env_key", "service_name", text("=m", F.col("k") % 5).alias("metric"), reply.alias("value"))
    return runtime_files.parse_metric_samples(docs).select("env_key", "service_name", "metric", "ts", "value")


@query("""SELECT env_key, service_name, ts, message FROM v_log_lines""")
def log_stream_replies(t: Tables) -> DataFrame:
    nanos = F.concat(F.unix_micros("ts").cast("string"), F.lit("000"))
    stream = F.struct(
        F.create_map(F.lit("job"), F.col("service_name")).alias("stream"), F.array(F.array(nanos, F.col("message"))).alias("values")
    )
    reply = F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.array(stream).alias("result")).alias("data")))
    return runtime_files.parse_log_streams(t.log_lines.select("env_key", reply.alias("value")))


@query("""SELECT path, language, module_name FROM (SELECT p_partkey, folder || '/f' || p_partkey || ext AS path, CASE ext WHEN '.py' THEN 'python' ELSE 'typescript' END AS language,
    replace(folder, '/', '.') || '.f' || p_partkey AS module_name, folder, ext FROM (SELECT p_partkey, ['src/app', 'src/build/x', 'lib', 'env/lib'][p_partkey % 4 + 1] AS folder,
    ['.py', '.ts', '.min.js', '.txt', '.go'][p_partkey % 5 + 1] AS ext FROM part)) WHERE folder IN ('src/app', 'lib') AND ext IN ('.py', '.ts')""")
def source_file_selection(t: Tables) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % n + 1).cast("int"))
    folder = pick(("src/app", "src/build/x", "lib", "env/lib"), 4)
    path = F.concat(folder, text("=/f", "p_partkey"), pick((".py", ".ts", ".min.js", ".txt", ".go"), 5))
    files = t.raw("part").select(F.lit("repo").alias("repo_key"), path.alias("path"), F.col("p_name").alias("source"))
    return source_tree.select_source_files(files, ["python", "typescript"]).select("path", "language", "module_name")


def python_files(t: Tables) -> DataFrame:
    """A small Python module per part."""
    n = F.col("p_partkey").cast("string")
    source = F.concat(
        F.lit("import os.path as osp\nfrom .base import A, b as c\nLIMIT = "), F.col("p_size").cast("string"),
        F.lit("\nname: str = 'x'\n\n\nclass Part"), n, F.lit("(Base, meta=M):\n    \"\"\"Holds a part.\"\"\"\n\n    @cached(1)\n    def run(self, x: int) -> dict:\n        self.load(osp.join(x, str(x)))\n        return {}\n\n\nasync def main"),
        n, F.lit("(a, b=(1, 2)):\n    await c.go(a)\n    return helper(b)\n"),
        F.when(F.col("p_partkey") % 10 == 9, "def broken(:\n").otherwise(""),
    )
    return spread(t.raw("part")).select(
        F.lit("repo").alias("repo_key"), text("=pkg/m", "p_partkey", "=.py").alias("path"), F.lit("python").alias("language"),
        text("=pkg.m", "p_partkey").alias("module_name"), source.alias("source"),
    )


OK_PARTS = "part WHERE p_partkey % 10 <> 9"


@query(f"""SELECT * FROM (SELECT 'pkg.m' || p_partkey || '.Part' || p_partkey || '.run' AS qualified_name, '(self, x: int) -> dict' AS signature, 11 AS start_line, 13 AS end_line, false AS is_async,
    'pkg.m' || p_partkey || '.Part' || p_partkey AS parent_class, 'cached(1)' AS decorators, 'self.load:12,osp.join:12,str:12' AS calls FROM {OK_PARTS}
    UNION ALL SELECT 'pkg.m' || p_partkey || '.main' || p_partkey, '(a, b=(1, 2))', 16, 18, true, NULL, '', 'c.go:17,helper:18' FROM {OK_PARTS})""")
def code_structure(t: Tables) -> DataFrame:
    fn = source_tree.extract_code_structure(python_files(t))["functions"]
    calls = F.transform("calls", lambda c: F.concat(c["callee"], F.lit(":"), c["line"].cast("string")))
    return fn.select(
        "qualified_name", "signature", "start_line", "end_line", "is_async", "parent_class",
        F.array_join("decorators", ";").alias("decorators"), F.array_join(calls, ",").alias("calls"),
    )


@query("""SELECT 'pkg/m' || p_partkey || '.py' AS path, CASE WHEN p_partkey % 10 = 9 THEN 20 ELSE 19 END AS loc, CASE WHEN p_partkey % 10 = 9 THEN 0 ELSE 2 END AS n_functions, CASE WHEN p_partkey % 10 = 9 THEN 0 ELSE 1 END AS n_classes,
    CASE WHEN p_partkey % 10 = 9 THEN 0 ELSE 4 END AS n_symbols, CASE WHEN p_partkey % 10 = 9 THEN '' ELSE 'os.path[],.base[A;b]' END AS imports, p_partkey % 10 = 9 AS broken FROM part""")
def code_files(t: Tables) -> DataFrame:
    files = source_tree.extract_code_structure(python_files(t))["files"]
    imports = F.transform("imports", lambda i: F.concat(i["module"], F.lit("["), F.array_join(i["names"], ";"), F.lit("]")))
    return files.select(
        "path", F.col("loc").cast("int").alias("loc"), "n_functions", "n_classes", "n_symbols",
        F.array_join(imports, ",").alias("imports"), (F.size("parse_errors") > 0).alias("broken"),
    )


@query(f"""SELECT 'pkg.m' || p_partkey || '.' || s AS qualified_name, kind, line FROM {OK_PARTS.replace('WHERE', ", (SELECT unnest(['LIMIT', 'name', 'Part', 'main']) AS s0, unnest(['constant', 'variable', 'class', 'function']) AS kind, unnest([3, 4, 7, 16]) AS line), LATERAL (SELECT CASE WHEN s0 IN ('Part', 'main') THEN s0 || p_partkey ELSE s0 END AS s) WHERE")}""")
def code_symbols(t: Tables) -> DataFrame:
    return source_tree.extract_code_structure(python_files(t))["symbols"].select("qualified_name", "kind", "line")


@query(f"""SELECT * FROM (SELECT 'pkg.m' || p_partkey || '.main' || p_partkey AS qualified_name, 'function' AS kind,
    '# pkg.m' || p_partkey || '.main' || p_partkey || '(a, b=(1, 2))' || chr(10) || chr(10) || 'async def main' || p_partkey || '(a, b=(1, 2)):' || chr(10) || '    await c.go(a)' || chr(10) || '    return helper(b)' AS text FROM {OK_PARTS}
    UNION ALL SELECT 'pkg.m' || p_partkey || '.Part' || p_partkey || '.run', 'function', '# pkg.m' || p_partkey || '.Part' || p_partkey || '.run(self, x: int) -> dict' || chr(10) || '# decorators: cached(1)' || chr(10) || chr(10)
    || '    def run(self, x: int) -> dict:' || chr(10) || '        self.load(osp.join(x, str(x)))' || chr(10) || '        return {{}}' FROM {OK_PARTS}
    UNION ALL SELECT 'pkg.m' || p_partkey || '.Part' || p_partkey, 'class', '# class pkg.m' || p_partkey || '.Part' || p_partkey || chr(10) || '# inherits: Base' || chr(10) || '# Holds a part.' || chr(10) || '# methods: run' || chr(10) || chr(10)
    || 'class Part' || p_partkey || '(Base, meta=M):' || chr(10) || '    \"\"\"Holds a part.\"\"\"' || chr(10) || chr(10) || '    @cached(1)' || chr(10) || '    def run(self, x: int) -> dict:' || chr(10)
    || '        self.load(osp.join(x, str(x)))' || chr(10) || '        return {{}}' FROM {OK_PARTS})""")
def chunk_texts(t: Tables) -> DataFrame:
    return cg.chunk_texts(source_tree.parse_sources(python_files(t))).select("qualified_name", "kind", "text")


def session_lines(t: Tables) -> DataFrame:
    """Session records: plain and block content, tool results, tool uses, broken lines."""
    talk = t.raw("conversations")
    blocks = F.array(
        F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("map<string,string>").alias("input")),
        F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("Edit").alias("name"),
                 F.create_map(F.lit("file_path"), text("=/a/f", "turn", "=.py")).alias("input")),
    )
    head = F.concat(
        F.lit('{"type":"'), F.col("role"), F.lit('","uuid":"c'), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"),
        F.lit('","timestamp":"2024-01-01T00:00:'), F.format_string("%02d", F.col("turn")), F.lit('Z","message":{"content":'),
    )
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    only_results = F.lit('[{"type":"tool_result","content":"x"}]')
    content = (
        F.when((F.col("role") == "user") & (F.col("turn") == 4), only_results)
        .when(F.col("turn") % 2 == 1, F.to_json(blocks)).otherwise(quoted)
    )
    line = F.when((F.col("role") == "user") & (F.col("turn") == 6), "{broken").otherwise(F.concat(head, content, F.lit("}}")))
    return talk.select(text("=s", "conv_id").alias("session_id"), F.col("turn").alias("pos"), line.alias("value"))


@query("""SELECT session_id, pos, role, text, ts, message_id, tools FROM (SELECT 's' || conv_id AS session_id, turn AS pos, role, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS text,
    TIMESTAMP '2024-01-01' + to_seconds(turn) AS ts, 'c' || conv_id || '-' || turn AS message_id, CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN 'Edit:/a/f' || turn || '.py' ELSE '' END AS tools
    FROM conversations WHERE role IN ('user', 'assistant') AND NOT (role = 'user' AND turn IN (4, 6))) WHERE text <> '' OR tools <> ''""")
def session_transcripts(t: Tables) -> DataFrame:
    turns = transcripts.parse_session_lines(session_lines(t))
    tools = F.transform("tool_uses", lambda u: F.concat(u["name"], F.lit(":"), F.try_element_at(u["input"], F.lit("file_path"))))
    return turns.select("session_id", "pos", "role", "text", "ts", "message_id", F.array_join(tools, ",").alias("tools"))


@query("""SELECT 's' || conv_id AS session_id, turn AS pos, role, CASE WHEN turn % 2 = 0 THEN 'a' || turn || chr(10) || 'b' ELSE 'plain ' || turn END AS text, CASE WHEN turn % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_seconds(turn) END AS ts,
    CAST(turn AS VARCHAR) AS message_id FROM conversations WHERE role IN ('user', 'assistant')""")
def jsonl_transcripts(t: Tables) -> DataFrame:
    talk = t.raw("conversations")
    body = F.when(F.col("turn") % 2 == 0, text('=[{"text": "a', "turn", '="}, "b"]')).otherwise(text('="  plain ', "turn", '=\\n"'))
    stamp = F.when(F.col("turn") % 3 == 0, F.lit("soon")).otherwise(F.concat(F.lit("2024-01-01T00:00:"), F.format_string("%02d", F.col("turn"))))
    line = F.concat(
        F.lit('{"who": "The-'), F.upper("role"), F.lit('", "said": '), body, F.lit(', "when": "'), stamp, F.lit('", "id": '),
        F.col("turn").cast("string"), F.lit("}"),
    )
    lines = talk.select(text("=s", "conv_id").alias("session_id"), F.col("turn").alias("pos"), line.alias("value"))
    return transcripts.parse_jsonl_turns(lines, role_key="who", text_key="said", ts_key="when")


@query("""SELECT 'chat' || conv_id || '-' || turn AS session_id, role, CASE WHEN turn % 3 = 2 THEN 'p' || turn || chr(10) || 'q' ELSE 't' || turn END AS text, 'b' || turn AS message_id FROM conversations WHERE role IN ('user', 'assistant')""")
def chat_exports(t: Tables) -> DataFrame:
    n = F.col("turn").cast("string")
    label = F.when(F.col("role") == "assistant", F.lit("AI")).otherwise(F.col("role"))
    words = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit('"text": "t'), n, F.lit('"')))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit('"text": "", "markdown": " t'), n, F.lit(' "')))
        .otherwise(F.concat(F.lit('"content": [{"type": "text", "text": "p'), n, F.lit('"}, "q"]')))
    )
    message = F.concat(F.lit('[{"type": "'), label, F.lit('", "bubbleId": "b'), n, F.lit('", '), words, F.lit("}]"))
    doc = (
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"tabs": [{"id": "x", "bubbles": '), message, F.lit("}]}")))
        .otherwise(F.concat(F.lit('{"messages": '), message, F.lit("}")))
    )
    docs = t.raw("conversations").select(text("=/x/chat", "conv_id", "=-", "turn", "=.json").alias("path"), doc.alias("value"))
    return transcripts.parse_chat_export(docs).select("session_id", "role", "text", "message_id")


@query("""SELECT 'c' || item_id AS corpus, CAST(p AS BIGINT) AS query_id, CASE p WHEN 0 THEN text ELSE 'second' END AS question, CASE p WHEN 0 THEN 'a.b;c' ELSE 'd' END AS expected, '' AS notes FROM benchmark, (SELECT unnest([0, 1]) AS p)""")
def eval_corpora(t: Tables) -> DataFrame:
    case = lambda q, *e: F.struct(q.alias("question"), F.array(*[F.lit(x) for x in e]).alias("expected_any"))
    body = F.struct(
        text("=c", "item_id").alias("name"), F.lit("repo").alias("repo_key"),
        F.array(case(F.col("text"), "a.b", "c"), case(F.lit("second"), "d")).alias("cases"),
    )
    docs = t.raw("benchmark").select(text("=/c/", "item_id", "=.json").alias("path"), F.to_json(body).alias("value"))
    return reports.parse_eval_corpus(docs).select("corpus", "query_id", "question", F.array_join("expected_any", ";").alias("expected"), "notes")


@query("SELECT repo_key, caller, callee, line, TIMESTAMP '1999-01-01' AS captured_at FROM v_baseline")
def baseline_round_trip(t: Tables) -> DataFrame:
    """Baseline written twice (the second write replaces the first) and read back."""
    path = scratch_path(t.spark, "baseline")
    for _ in range(2):
        reports.write_baseline(t.baseline, path)
    return reports.read_baseline(t.spark, path).select("repo_key", "caller", "callee", "line", "captured_at")


@query("SELECT incident_id, kind, round(confidence, 6) AS confidence FROM v_ranked WHERE rank <= 5")
def snapshot_round_trip(t: Tables) -> DataFrame:
    """Top causes written as JSON, one folder per environment, and read back."""
    from tracebeam.operators import causality as ca

    top = ca.top_causes(t.incidents, t.causes, 5)
    path = scratch_path(t.spark, "snapshots")
    reports.write_snapshots(top.select("env_key", "incident_id", "kind", "confidence"), path, by="env_key")
    stored = t.spark.read.schema("incident_id string, kind string, confidence double, env_key string").json(path)
    return stored.select("incident_id", "kind", *six("confidence"))


def report_of(t: Tables) -> tuple[DataFrame, DataFrame]:
    # the findings are numbered, counted and written: evaluated once
    findings = materialize(dr.scan_findings(dr.detect_drift(t.calls, t.baseline, BOUNDARIES)), "findings")
    report = dr.quality_gate(findings, "strict").withColumn("repo_key", F.lit("all")).withColumn(
        "started_at", F.lit("2024-01-31").cast("timestamp")
    )
    return findings, report


@query("""SELECT DISTINCT rule_id, CASE rule_id WHEN 'drift/boundary_violation' THEN 'Declared boundary broken' WHEN 'drift/new_dependency' THEN 'Dependency added'
    WHEN 'drift/removed_dependency' THEN 'Dependency gone' END AS short, true AS has_full FROM v_findings""")
def sarif_rules(t: Tables) -> DataFrame:
    """Rule descriptors of all SARIF documents."""
    schema = (
        "struct<runs: array<struct<tool: struct<driver: struct<rules: array<struct<id: string, "
        "shortDescription: struct<text: string>, fullDescription: struct<text: string>>>>>>>>"
    )
    rules = F.from_json("sarif", schema)["runs"][0]["tool"]["driver"]["rules"]
    told = reports.findings_to_sarif(*report_of(t)).select(F.explode(rules).alias("r"))
    return told.select(
        F.col("r.id").alias("rule_id"), F.col("r.shortDescription.text").alias("short"),
        F.col("r.fullDescription.text").isNotNull().alias("has_full"),
    ).distinct()


@query("""SELECT rule_id, CASE severity WHEN 'critical' THEN 'error' ELSE severity END AS level, message, '.' AS uri FROM v_findings""")
def sarif_report(t: Tables) -> DataFrame:
    """All SARIF documents read back into their results."""
    schema = (
        "struct<runs: array<struct<results: array<struct<ruleId: string, level: string, message: struct<text: string>, "
        "locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>>>>>>>>>"
    )
    documents = reports.findings_to_sarif(*report_of(t))
    results = documents.select(F.explode(F.from_json("sarif", schema)["runs"][0]["results"]).alias("r"))
    return results.select(
        F.col("r.ruleId").alias("rule_id"), "r.level", F.col("r.message.text").alias("message"),
        F.col("r.locations")[0]["physicalLocation"]["artifactLocation"]["uri"].alias("uri"),
    )


@query("""SELECT '- **`' || rule_id || '`** — ' || message AS line FROM v_findings""")
def markdown_report(t: Tables) -> DataFrame:
    """All digest parts split back into their finding lines."""
    parts = reports.findings_to_markdown(*report_of(t))
    lines = parts.select(F.explode(F.split("markdown", "\n")).alias("line"))
    return lines.where(F.startswith("line", F.lit("- **`")))
