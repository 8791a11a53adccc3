"""Queries over the code graph: call resolution, drift, neighbours, ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebeam.functions.texts import glob_match
from tracebeam.operators import causality as ca
from tracebeam.operators import code_graph as ops
from tracebeam.operators import drift as dr
from tracebeam.operators import runtime as rt
from tracebeam.plans.registry import query
from tracebeam.plans.views import AS_OF, Tables, text
from tracebeam.session import materialize

BOUNDARIES = (
    dr.Boundary("one-to-two", "pkg1.*", "svc2.s*2", "keep apart"),
    dr.Boundary("short-names", "pkg[3-4].p?", "svc[!0-6].*"),
)


@query("""SELECT repo_key, path, 71 AS n_members, 50 AS n_aliases, 'pkg49.C' AS last_class, 'pkg7' AS alias_7, 'pkg3.f3' AS member_g3 FROM v_files""")
def index_imports(t: Tables) -> DataFrame:
    pick = lambda column, key: F.try_element_at(F.col(column), F.lit(key))
    return ops.index_imports(t.files).select(
        "repo_key", "path", F.size("members").alias("n_members"), F.size("aliases").alias("n_aliases"),
        pick("members", "C").alias("last_class"), pick("aliases", "al7").alias("alias_7"),
        pick("members", "g3").alias("member_g3"),
    )


@query("SELECT repo_key, caller, line, callee_text, callee, strategy FROM v_resolved")
def resolve_calls(t: Tables) -> DataFrame:
    return ops.resolve_calls(t.functions, t.files).select(
        "repo_key", "caller", "line", "callee_text", "callee", "strategy"
    )


@query("""SELECT repo_key, caller, callee, line, file_path, any_value(strategy) AS derivation, any_value(callee_text) AS callee_text
    FROM v_resolved WHERE callee IS NOT NULL GROUP BY repo_key, caller, callee, line, file_path""")
def call_edges(t: Tables) -> DataFrame:
    return ops.call_edges(ops.resolve_calls(t.functions, t.files))


@query("""SELECT repo_key, count(DISTINCT caller) AS callers, count(*) AS sites, count(callee) AS resolved, count(*) - count(callee) AS unresolved,
    round(count(callee) / count(*), 6) AS rate FROM v_resolved GROUP BY 1""")
def call_resolution_stats(t: Tables) -> DataFrame:
    out = ops.call_resolution_stats(ops.resolve_calls(t.functions, t.files))
    return out.withColumn("rate", F.round("rate", 6))


@query("SELECT repo_key, strategy, count(*) AS sites FROM v_resolved GROUP BY 1, 2")
def calls_by_strategy(t: Tables) -> DataFrame:
    return ops.calls_by_strategy(ops.resolve_calls(t.functions, t.files))


@query("""SELECT c.repo_key, c.caller, c.callee, c.line, c.derivation, n.file_path, n.signature FROM v_every_call c
    LEFT JOIN v_nodes n ON n.repo_key = c.repo_key AND n.qualified_name = c.caller""")
def get_callers(t: Tables) -> DataFrame:
    return ops.get_callers(t.every_call, t.call_nodes)


@query("""SELECT repo_key, caller, callee, line, rank, derivation, n.file_path, n.signature FROM (SELECT *, row_number() OVER (PARTITION BY repo_key, callee ORDER BY caller, line) AS rank FROM v_every_call) c
    LEFT JOIN (SELECT repo_key AS r, qualified_name, file_path, signature FROM v_nodes) n ON n.r = c.repo_key AND n.qualified_name = c.caller WHERE rank <= 50""".replace("derivation, n.file_path", "c.derivation, n.file_path"))
def first_callers(t: Tables) -> DataFrame:
    return ops.get_callers(t.every_call, t.call_nodes, limit=50)


@query("""SELECT c.repo_key, c.caller, c.callee, c.line, c.derivation, n.file_path, n.signature FROM v_every_call c
    LEFT JOIN v_nodes n ON n.repo_key = c.repo_key AND n.qualified_name = c.callee""")
def get_dependencies(t: Tables) -> DataFrame:
    return ops.get_dependencies(t.every_call, t.call_nodes)


@query("SELECT repo_key, parent, parent_kind, child FROM v_contains")
def contains_edges(t: Tables) -> DataFrame:
    return t.contains


@query("""SELECT query_id, repo_key, qualified_name, kind AS container_kind FROM (SELECT query_id, repo_key, qualified_name, max(kind) AS kind FROM (
    SELECT f.p_partkey AS query_id, f.repo_key, c2.child AS qualified_name, NULL AS kind FROM v_function_names f
    JOIN v_contains c1 ON c1.repo_key = f.repo_key AND c1.child = f.qualified_name
    JOIN v_contains c2 ON c2.repo_key = c1.repo_key AND c2.parent = c1.parent AND c2.child <> f.qualified_name
    UNION ALL SELECT f.p_partkey, f.repo_key, c1.parent, c1.parent_kind FROM v_function_names f
    JOIN v_contains c1 ON c1.repo_key = f.repo_key AND c1.child = f.qualified_name) GROUP BY ALL)""")
def graph_expand(t: Tables) -> DataFrame:
    hits = t.function_names.select(F.col("p_partkey").alias("query_id"), "repo_key", "qualified_name")
    return ops.graph_expand(hits, t.contains)


@query("""SELECT repo_key, child AS qualified_name, 'parent' AS role, parent AS other FROM v_contains WHERE child IN (SELECT qualified_name FROM v_function_names)
    UNION ALL SELECT DISTINCT c.repo_key, c.parent, 'child', c.child FROM v_contains c JOIN v_function_names f ON f.repo_key = c.repo_key AND f.qualified_name = c.parent""")
def neighbors(t: Tables) -> DataFrame:
    return ops.neighbors(t.function_names, t.contains)


@query("""SELECT p.path, f.repo_key, r.spec, f.module_name, f.loc, r.spec IS NOT NULL AS found, NULL AS author FROM (SELECT DISTINCT unnest(file_paths) AS path FROM v_services) p
    LEFT JOIN v_files f ON f.path = p.path LEFT JOIN v_repos r ON r.key = f.repo_key""")
def who_owns(t: Tables) -> DataFrame:
    wanted = t.services.select(F.explode("file_paths").alias("path"))
    return ops.who_owns(wanted, t.repos, t.files).select(
        "path", "repo_key", "spec", "module_name", "loc", "found", "author"
    )


@query("""SELECT 'Repo' AS label, count(*) AS n FROM v_repos UNION ALL SELECT 'File', count(*) FROM v_files
    UNION ALL SELECT 'Function', count(*) FROM v_function_names UNION ALL SELECT 'Class', count(DISTINCT parent_class) FROM v_function_names""")
def code_stats(t: Tables) -> DataFrame:
    return rt.code_stats(
        {"Repo": t.repos, "File": t.files, "Function": t.function_names, "Class": t.classes}
    )


@query("""SELECT r.key, r.spec, r.indexed_at, coalesce(f.n, 0) AS files FROM v_repos r LEFT JOIN (SELECT repo_key, count(*) AS n FROM v_files GROUP BY 1) f ON f.repo_key = r.key""")
def list_repos(t: Tables) -> DataFrame:
    return rt.list_repos(t.repos, t.files)


@query("""SELECT f.repo_key, 'python' AS language, f.files, f.loc, f.imports, 0 AS error_files, n.functions, c.calls, k.classes FROM
    (SELECT repo_key, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc, CAST(count(*) * 110 AS BIGINT) AS imports FROM v_files GROUP BY 1) f
    JOIN (SELECT repo_key, count(*) AS functions FROM v_function_names GROUP BY 1) n ON n.repo_key = f.repo_key
    JOIN (SELECT repo_key, count(*) AS calls FROM v_sites GROUP BY 1) c ON c.repo_key = f.repo_key
    JOIN (SELECT repo_key, count(DISTINCT parent_class) AS classes FROM v_function_names GROUP BY 1) k ON k.repo_key = f.repo_key""")
def ingest_stats(t: Tables) -> DataFrame:
    return ops.ingest_stats(t.files, t.functions, t.classes)


@query("""SELECT repo_key, modules AS module_count, functions AS function_count, edges FROM (SELECT repo_key, count(*) AS modules FROM v_files GROUP BY 1)
    JOIN (SELECT repo_key, count(*) AS functions FROM v_function_names GROUP BY 1) USING (repo_key) JOIN (SELECT repo_key, count(*) AS edges FROM v_every_call GROUP BY 1) USING (repo_key)""")
def capture_baseline(t: Tables) -> DataFrame:
    edges, counts = dr.capture_baseline(t.every_call, t.files, t.function_names, AS_OF)
    return counts.join(edges.groupBy("repo_key").agg(F.count(F.lit(1)).alias("edges")), "repo_key")


@query("SELECT repo_key, caller, callee, description FROM v_drift WHERE kind = 'new_dependency'")
def drift_new(t: Tables) -> DataFrame:
    return dr.drift_new(t.calls, t.baseline).select("repo_key", "caller", "callee", "description")


@query("SELECT repo_key, caller, callee, description FROM v_drift WHERE kind = 'removed_dependency'")
def drift_removed(t: Tables) -> DataFrame:
    return dr.drift_removed(t.calls, t.baseline).select("repo_key", "caller", "callee", "description")


@query("SELECT repo_key, caller, callee, boundary_name, description FROM v_drift WHERE kind = 'boundary_violation'")
def boundary_violations(t: Tables) -> DataFrame:
    return dr.boundary_violations(t.calls, BOUNDARIES).select(
        "repo_key", "caller", "callee", "boundary_name", "description"
    )


RULES = """SELECT row_number() OVER (ORDER BY p_partkey) AS position, 'rule' || p_partkey AS name,
    CASE p_partkey % 4 WHEN 0 THEN 'pkg' || (p_partkey % 10) || '.p' || (p_partkey % 500) || '*' WHEN 1 THEN 'pkg' || (p_partkey % 10) || '.p' || (p_partkey % 100) || '?' ELSE '*' END AS source_pattern,
    CASE p_partkey % 4 WHEN 0 THEN '*' WHEN 1 THEN 'svc*' WHEN 2 THEN 'svc' || (p_partkey % 10) || '.s' || (p_partkey % 20) || '[0-4]' ELSE 'svc' || (p_partkey % 10) || '.s' || p_partkey END AS forbidden_pattern,
    CASE WHEN p_partkey % 3 > 0 THEN 'part ' || p_partkey END AS description FROM part"""


@query(f"""WITH r AS ({RULES}), e AS (SELECT DISTINCT caller, callee FROM v_every_call),
    hit AS (SELECT caller, callee, arg_min(name, position) AS name, arg_min(coalesce(description, ''), position) AS description FROM e JOIN r ON e.caller GLOB r.source_pattern AND e.callee GLOB r.forbidden_pattern GROUP BY ALL)
    SELECT c.repo_key, c.caller, c.callee, h.name AS boundary_name, 'Boundary violation (' || h.name || '): ' || c.caller || ' depends on ' || c.callee || '. ' || h.description AS description
    FROM v_every_call c JOIN hit h USING (caller, callee)""")
def boundary_violations_table(t: Tables) -> DataFrame:
    """All calls against one rule per part, read from a table."""
    n, of = F.col("p_partkey"), lambda m: F.col("p_partkey") % m
    kind = of(4)
    rules = t.raw("part").select(
        n.alias("position"), text("=rule", n).alias("name"),
        F.when(kind == 0, text("=pkg", of(10), "=.p", of(500), "=*")).when(kind == 1, text("=pkg", of(10), "=.p", of(100), "=?"))
        .otherwise("*").alias("source_pattern"),
        F.when(kind == 0, "*").when(kind == 1, "svc*").when(kind == 2, text("=svc", of(10), "=.s", of(20), "=[0-4]"))
        .otherwise(text("=svc", of(10), "=.s", n)).alias("forbidden_pattern"),
        F.when(of(3) > 0, text("=part ", n)).alias("description"),
    )
    return dr.boundary_violations_by_table(t.every_call, rules).select(
        "repo_key", "caller", "callee", "boundary_name", "description"
    )


@query("""SELECT kind, severity, caller, callee, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS severity_order FROM v_drift""")
def detect_drift(t: Tables) -> DataFrame:
    return dr.detect_drift(t.calls, t.baseline, BOUNDARIES).select(
        "kind", "severity", "caller", "callee", "severity_order"
    )


def findings_of(t: Tables) -> DataFrame:
    newest = materialize(ca.newest_incidents(t.incidents, AS_OF), "newest-incidents")
    recent = ca.recent_incident_causes(newest, ca.link_incidents(newest, t.causes), AS_OF)
    return dr.scan_findings(dr.detect_drift(t.calls, t.baseline, BOUNDARIES), recent)


@query("""SELECT rule_id, severity, message, caller, callee, NULL AS incident_id FROM v_findings UNION ALL
    SELECT 'incident/recent-cause', 'note', 'incident ' || r.incident_id || ' (last 168h): top cause = ' || c.kind || ' (strategy=' || c.strategy || ', confidence=' || printf('%.2f', c.confidence) || ')',
    NULL, NULL, r.incident_id FROM (SELECT id AS incident_id FROM v_incidents
    WHERE floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(detected_at)) / 1000000.0 / 3600.0) <= 168 ORDER BY detected_at DESC, id DESC LIMIT 20) r
    JOIN v_ranked c ON c.incident_id = r.incident_id AND c.rank = 1""")
def scan_findings(t: Tables) -> DataFrame:
    return findings_of(t).select("rule_id", "severity", "message", "caller", "callee", "incident_id")


GATE_SQL = """SELECT count(*) FILTER (severity = 'note') AS note, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'error') AS error,
    count(*) FILTER (severity = 'critical') AS critical, count(*) AS total, 'critical' AS max_severity, '{gate}' AS gate, {passed} AS passed FROM v_findings"""


@query(" UNION ALL ".join(GATE_SQL.format(gate=g, passed=p) for g, p in (("strict", "false"), ("normal", "false"), ("lenient", "count(*) FILTER (severity = 'critical') = 0"), ("none", "true"))))
def quality_gate(t: Tables) -> DataFrame:
    findings = dr.scan_findings(dr.detect_drift(t.calls, t.baseline, BOUNDARIES))
    out = None
    for gate in ("strict", "normal", "lenient", "none"):
        one = dr.quality_gate(findings, gate).drop("max_rank")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT l_orderkey, l_linenumber, regexp_matches(n, '^pkg[1-3]\\.p.5.*$') AS a, regexp_matches(n, '^[^p].*$') AS b FROM (SELECT *, 'pkg' || (l_partkey % 10) || '.p' || l_partkey AS n FROM lineitem)""")
def glob_filter(t: Tables) -> DataFrame:
    name = text("=pkg", F.col("l_partkey") % 10, "=.p", "l_partkey")
    return t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", glob_match(name, "pkg[1-3].p?5*").alias("a"),
        glob_match(name, "[!p]*").alias("b"),
    )


@query("""SELECT repo_key, caller, callee, count(*) AS n FROM v_every_call GROUP BY ALL HAVING repo_key = 'repo1'""")
def repo_scope(t: Tables) -> DataFrame:
    return rt.scope(t.every_call, repo_key="repo1").groupBy("repo_key", "caller", "callee").agg(
        F.count(F.lit(1)).alias("n")
    )
