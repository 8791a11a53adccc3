"""Schemas of the canonical tables and of the files that are read."""

from __future__ import annotations

BASE = "env_key string, source string, confidence double"

SERVICES = f"{BASE}, name string, repo_key string, file_paths array<string>"
DEPLOYMENTS = (
    f"{BASE}, deployment_id string, service_name string, at timestamp, commit_sha string, "
    "description string"
)
METRIC_SHIFTS = (
    f"{BASE}, service_name string, metric string, started_at timestamp, ended_at timestamp, "
    "before double, after double, unit string, description string"
)
LOG_SIGNATURES = (
    f"{BASE}, service_name string, signature string, signature_hash string, "
    "first_seen_at timestamp, last_seen_at timestamp, count bigint, level string"
)
INCIDENTS = (
    f"{BASE}, id string, title string, severity string, detected_at timestamp, "
    "resolved_at timestamp, summary string, affected_services array<string>"
)
RUNTIME_TABLES = {
    "service": SERVICES,
    "deployment": DEPLOYMENTS,
    "metric_shift": METRIC_SHIFTS,
    "log_signature": LOG_SIGNATURES,
    "incident": INCIDENTS,
}

# one record of a runtime-event file; numbers and times stay text until they are checked
EVENT_RECORD = (
    "struct<kind: string, confidence: string, name: string, repo_key: string, "
    "file_paths: array<string>, deployment_id: string, service_name: string, service: string, "
    "at: string, commit_sha: string, description: string, metric: string, started_at: string, "
    "ended_at: string, before: string, after: string, unit: string, signature: string, "
    "first_seen_at: string, last_seen_at: string, count: string, level: string, id: string, "
    "title: string, severity: string, detected_at: string, resolved_at: string, summary: string, "
    "affected_services: array<string>>"
)
INCIDENT_BLOCK = (
    "struct<id: string, title: string, env: string, detected_at: string, resolved_at: string, "
    "severity: string, summary: string, affected_services: array<string>>"
)

CALL = "struct<callee: string, line: int>"
IMPORT = (
    "struct<module: string, names: array<string>, alias_of: map<string,string>, line: int, "
    "is_relative: boolean>"
)
FUNCTION = (
    "struct<qualified_name: string, name: string, signature: string, start_line: int, "
    "end_line: int, docstring: string, is_async: boolean, is_method: boolean, "
    f"parent_class: string, decorators: array<string>, calls: array<{CALL}>>"
)
CLASS = (
    "struct<qualified_name: string, name: string, start_line: int, end_line: int, "
    "docstring: string, decorators: array<string>, base_classes: array<string>, "
    "method_qnames: array<string>>"
)
SYMBOL = "struct<qualified_name: string, name: string, kind: string, line: int>"
CODE_STRUCTURE = (
    f"imports array<{IMPORT}>, parse_errors array<string>, functions array<{FUNCTION}>, "
    f"classes array<{CLASS}>, symbols array<{SYMBOL}>"
)

TURNS = (
    "session_id string, pos bigint, role string, text string, ts timestamp, message_id string, "
    "tool_uses array<struct<name: string, input: map<string,string>>>"
)
CASES = "corpus string, repo_key string, query_id bigint, question string, expected_any array<string>, notes string"
