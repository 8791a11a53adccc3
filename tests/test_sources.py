"""Readers and parsers on small files."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracebeam.functions import jsons, texts, times
from tracebeam.operators import code_graph as cg
from tracebeam.operators import tables as tb
from tracebeam.operators import transcripts as tr
from tracebeam.sources import reports, runtime_files, source_tree, transcripts
from tracebeam.sources.documents import read_lines


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


EVENTS = [
    {"kind": "deployment", "deployment_id": "d1", "service_name": "auth", "at": "2026-04-12T14:17:00Z"},
    {"kind": "metric_shift", "service_name": "pay", "metric": "p99", "started_at": "2026-04-12T14:23:00+00:00", "before": 120, "after": 4200},
    {"kind": "deployment", "service_name": "auth", "at": "2026-04-12T14:17:00Z"},
    {"kind": "mystery", "service_name": "auth"},
    {"kind": "incident", "id": "I", "title": "t", "detected_at": "2026-04-12T14:24:00+02:00"},
    {"kind": "log_signature", "service_name": "pay", "signature": "x", "first_seen_at": "2026-04-12T14:24:00Z", "confidence": 7},
]


@pytest.mark.parametrize("form", ["list", "events", "yaml"])
def test_runtime_event_files(spark, tmp_path, form):
    body = EVENTS if form != "events" else {"events": EVENTS}
    if form == "yaml":
        yaml = pytest.importorskip("yaml")
        (tmp_path / "e.yaml").write_text(yaml.safe_dump(body))
    else:
        (tmp_path / "e.json").write_text(json.dumps(body, indent=2))
    tables = runtime_files.read_runtime_events(spark, str(tmp_path), "prod")
    counts = {k: df.count() for k, df in tables.items()}
    assert counts == {"service": 0, "deployment": 1, "metric_shift": 1, "log_signature": 0, "incident": 1}
    deploy, incident = tables["deployment"].first(), tables["incident"].first()
    assert deploy["source"].startswith("file:e.") and deploy["confidence"] == 1.0
    assert incident["severity"] == "unknown" and incident["detected_at"].hour == 12


def test_postmortem_strict_names_the_row(spark, tmp_path):
    doc = {"incident": {"id": "I", "title": "t", "env": "prod", "detected_at": "2026-01-01T00:00:00Z", "affected_services": ["a"]},
           "timeline": [{"kind": "deployment", "service": "b", "deployment_id": "d", "at": "2026-01-01T00:00:00Z"}, {"kind": "deployment", "service": "b"}]}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    incidents, timeline = runtime_files.read_postmortems(spark, str(tmp_path))
    with pytest.raises(Exception, match=r"timeline\[1\]"):
        runtime_files.timeline_to_tables(incidents, timeline)["deployment"].collect()
    incidents, timeline = runtime_files.read_postmortems(spark, str(tmp_path), strict=False)
    tables = runtime_files.timeline_to_tables(incidents, timeline)
    assert tables["deployment"].count() == 1
    assert sorted(r["name"] for r in tables["service"].collect()) == ["a", "b"]


SOURCE = '''"""Doc."""
import json
import os.path as osp
from .base import A, b as c

LIMIT = 3
value = 1


def helper(x):
    """Help."""
    return osp.join(x, str(x))


class Box(A):
    @property
    def size(self) -> int:
        return self.count() + helper(1)

    def count(self):
        return json.dumps(1)
'''


@pytest.fixture
def tree(tmp_path):
    for name, text in {"pkg/mod.py": SOURCE, "pkg/bad.py": "def (:", "build/x.py": "a = 1", "a.min.js": "", "readme.txt": "x"}.items():
        path = tmp_path / "repo" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path / "repo")


def test_source_tree_to_call_edges(spark, tree):
    files = source_tree.scan_source_tree(spark, tree, "r")
    assert sorted(r["path"] for r in files.collect()) == ["pkg/bad.py", "pkg/mod.py"]
    parts = source_tree.extract_code_structure(files)
    functions = {r["qualified_name"]: r for r in parts["functions"].collect()}
    assert set(functions) == {"pkg.mod.helper", "pkg.mod.Box.size", "pkg.mod.Box.count"}
    size = functions["pkg.mod.Box.size"]
    assert size["decorators"] == ["property"] and size["signature"] == "(self) -> int" and size["is_method"]
    assert {(r["name"], r["kind"]) for r in parts["symbols"].collect()} == {("LIMIT", "constant"), ("value", "variable"), ("helper", "function"), ("Box", "class")}
    assert parts["files"].where(F.size("parse_errors") > 0).count() == 1
    resolved = cg.resolve_calls(parts["functions"], parts["files"])
    found = {(r["callee_text"], r["callee"], r["strategy"]) for r in resolved.collect()}
    assert ("self.count", "pkg.mod.Box.count", "self_method") in found
    assert ("helper", "pkg.mod.helper", "same_module") in found
    assert ("osp.join", None, "<unresolved>") in found


def test_imports_last_one_wins(spark):
    imp = "struct<module: string, names: array<string>, alias_of: map<string,string>, line: int, is_relative: boolean>"
    rows = [("r", "f", "m", [("a", ["x", "*"], {}, 1, False), ("b", ["x", "y"], {"z": "y"}, 2, False), ("p.q", [], {}, 3, False), ("n", [], {"k": "n"}, 4, False)])]
    out = cg.index_imports(spark.createDataFrame(rows, f"repo_key string, path string, module_name string, imports array<{imp}>")).first()
    assert out["members"] == {"x": "b.x", "y": "b.y", "z": "b.y"}
    assert out["aliases"] == {"q": "p.q", "p.q": "p.q", "k": "n"}


def test_session_files_keep_line_order(spark, tmp_path):
    folder = tmp_path / "-home-me-app"
    folder.mkdir()
    say = lambda role, content, n: json.dumps({"type": role, "uuid": f"u{n}", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": role, "content": content}})
    lines = [say("user", " first ", 1), "{broken", say("assistant", [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "Edit", "input": {"file_path": "/x/src/r/a.py"}}], 2),
             say("user", [{"type": "tool_result", "content": "x"}], 3), say("assistant", [{"type": "thinking", "thinking": "-"}], 4), say("user", [{"type": "text", "text": "second"}], 5)]
    (folder / "s1.jsonl").write_text("\n".join(lines))
    turns, sessions = transcripts.read_session_transcripts(spark, str(folder))
    got = [(r["pos"], r["role"], r["text"]) for r in turns.orderBy("pos").collect()]
    assert got == [(1, "user", "first"), (3, "assistant", "hi"), (6, "user", "second")]
    assert sessions.first()["project"] == "/home/me/app"
    chunks = tr.pair_session_turns(turns).orderBy("chunk_id").collect()
    assert chunks[0]["response"] == "hi\n\n**Actions taken in this turn:**\n- **Edited:** a.py"
    assert chunks[1]["response"] == "(no assistant response captured)"


def test_lines_of_split_files_stay_in_order(spark, tmp_path):
    (tmp_path / "big.txt").write_text("\n".join(f"line {i}" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_lines(spark, str(tmp_path)).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["value"] for r in rows] == [f"line {i}" for i in range(5000)]
    assert [r["pos"] for r in rows] == list(range(1, 5001))


def naive_pairs(turns, limit):
    out, current = [], None
    for role, text in turns:
        if role == "user":
            current = [text, [], 0]
            out.append(current)
        elif current is not None:
            current[2] += 1
            if text:
                current[1].append(text)
    pairs = []
    for question, texts_, n in out:
        answer = "\n\n".join(texts_)
        if len(answer) > limit:
            answer = answer[:limit] + "\n…[truncated]"
        pairs.append((question, answer or "(no assistant response captured)", n))
    return pairs


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
def test_pairing_across_blocks(spark, block_rows):
    import random

    rng = random.Random(block_rows)
    rows, expected = [], {}
    for s in range(6):
        talk = [(rng.choice(["user", "assistant", "assistant", "assistant"]), "" if rng.random() < 0.1 else "w" * rng.randrange(1, 30)) for _ in range(40)]
        talk = [(r, t or ("q" if r == "user" else "")) for r, t in talk]
        expected[f"s{s}"] = naive_pairs(talk, 60)
        rows += [(f"s{s}", i, r, t) for i, (r, t) in enumerate(talk)]
    turns = spark.createDataFrame(rows, "session_id string, pos bigint, role string, text string").repartition(5)
    got = {}
    for r in tr.pair_turns(turns, 60, block_rows=block_rows).orderBy("session_id", "chunk_id").collect():
        got.setdefault(r["session_id"], []).append((r["question"], r["response"], r["n_responses"]))
    assert got == expected


def test_upsert_rules(spark):
    schema = "k string, v string, stub boolean, n int"
    old = spark.createDataFrame([("a", "full", False, 0), ("b", "stub", True, 0)], schema)
    new = spark.createDataFrame([("a", "stub", True, 1), ("b", "new", False, 1), ("b", None, False, 2), ("c", "stub", True, 1)], schema)
    merged = tb.upsert(old, new, ["k"], "n", "stub")
    rows = {r["k"]: r["v"] for r in merged.collect()}
    assert rows == {"a": "full", "b": None, "c": "stub"}
    again = tb.upsert(merged, new, ["k"], "n", "stub")
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, merged.collect()), key=repr)


def test_rewrite_of_the_path_being_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    tb.rewrite(spark.read.parquet(path).where("id > 6"), path)
    assert spark.read.parquet(path).count() == 3


def test_rewrite_drops_a_whole_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "concat('r', id % 2) repo_key").write.partitionBy("repo_key").parquet(path)
    kept, _ = tb.delete_where(spark.read.parquet(path), F.col("repo_key") == "r0")
    tb.rewrite(kept, path, ["repo_key"])
    assert {r["repo_key"] for r in spark.read.parquet(path).collect()} == {"r1"}


def test_missing_baseline_is_empty(spark, tmp_path):
    assert reports.read_baseline(spark, str(tmp_path / "none")).count() == 0


def test_globs(spark):
    cases = [("a.b.c", "a.*", True), ("a.b", "a.?", True), ("A.b", "a.*", False), ("x1", "x[0-9]", True), ("xa", "x[!0-9]", True), ("a+b", "a+b", True), ("ab", "a[", False)]
    for text, pattern, expected in cases:
        assert one(spark, texts.glob_match(F.lit(text), pattern)) is expected


@settings(max_examples=400, deadline=None)
@given(st.text("ab-c.*?[]!^", max_size=8), st.text("abc.-!^[]", max_size=5))
def test_globs_agree_with_shell_matching(pattern, text):
    import fnmatch
    import re

    # the end anchor is written \\z in Java and \\Z in Python
    regex = texts.glob_regex(pattern).replace(r"\z", r"\Z")
    assert bool(re.match(regex, text)) == fnmatch.fnmatchcase(text, pattern)


def test_incident_ids(spark):
    for text, expected in {"INC-2026-04-12-payments-cascade": "INC-2026-04-12-payments-cascade", "see incident-99": "incident-99", "INC1234 happened": "INC1234", "INCIDENT-99 affecting auth": "INCIDENT-99"}.items():
        assert one(spark, texts.incident_ids(F.lit(text))) == [expected]


def test_relative_windows(spark):
    as_of = "2024-01-10 00:00:00"
    read = lambda s: one(spark, times.relative_since(F.lit(s), as_of).cast("string"))
    assert [read(s) for s in ("2h", "1d", "30m", "1w")] == ["2024-01-09 22:00:00", "2024-01-09 00:00:00", "2024-01-09 23:30:00", "2024-01-03 00:00:00"]
    assert read("soon") is None and read("5y") is None


def test_claims_in_three_forms(spark):
    body = json.dumps({"claims": [{"claim": "a", "supported": True, "citation": "f.py:1"}, {"claim": " "}, {"claim": "b", "citation": "null"}]})
    for reply in (body, f"Sure\n```json\n{body}\n```", f"It is {body} indeed"):
        got = one(spark, jsons.claims(F.lit(reply)))
        assert [(c["claim"], c["supported"], c["citation"]) for c in got] == [("a", True, "f.py:1"), ("b", False, None)]
    assert one(spark, jsons.claims(F.lit("no json"))) == []


def test_report_parts_hold_every_finding(spark):
    rows = [("r", f"rule{i % 3}", "warning", f"m{i % 5}", None, None, [], "a", "b", None, "warning", None) for i in range(23)]
    schema = "repo_key string, rule_id string, severity string, message string, file_path string, line int, derivation array<string>, caller string, callee string, boundary_name string, raw_severity string, incident_id string"
    findings = spark.createDataFrame(rows, schema)
    from tracebeam.operators.drift import quality_gate

    report = quality_gate(findings).withColumn("repo_key", F.lit("r")).withColumn("started_at", F.lit("2024-01-01").cast("timestamp"))
    documents = [json.loads(r["sarif"]) for r in reports.findings_to_sarif(findings, report, per_part=10).collect()]
    assert sorted(len(d["runs"][0]["results"]) for d in documents) == [3, 10, 10]
    assert all(d["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "." for d in documents)
    digests = reports.findings_to_markdown(findings, report, per_part=10).collect()
    assert sum(r["markdown"].count("- **`") for r in digests) == 23


def test_sources_are_parsed_few_at_a_time(spark):
    import pyarrow as pa

    names = ["repo_key", "path", "language", "module_name", "source"]
    frame = spark.createDataFrame([], ", ".join(f"{n} string" for n in names))

    class Files:
        schema = frame.schema

        def mapInArrow(self, run, schema):
            return run

    source = "import a as b, c\nfrom d import e as f\nx = 1\n\n\ndef go():\n    e()\n"
    rows = [("r", f"{k}.py", "python", f"m{k}", source if k else None) for k in range(450)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)
    parts = list(source_tree.parse_sources(Files())(iter([batch])))
    assert [p.num_rows for p in parts] == [200, 200, 50]
    found = pa.Table.from_batches(parts).to_pylist()
    assert [f["path"] for f in found] == [r[1] for r in rows]
    assert found[0]["symbols"] == [] and [s["name"] for s in found[449]["symbols"]] == ["x", "go"]
    assert [i["alias_of"] for i in found[1]["imports"]] == [[("b", "a")], [], [("f", "e")]]
