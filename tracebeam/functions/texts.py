"""Text expressions: log redaction, ids, globs, mentions, clipping."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tokens folded into <n>, tried in this order: lower-case uuid, ISO time, 0x number,
# hex run of 32 or more, plain number.
VOLATILE_TOKEN = (
    "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    "|[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+Z?"
    "|0x[0-9a-fA-F]+"
    "|[0-9a-fA-F]{32,}"
    "|[0-9]+(?:[.][0-9]+)?"
)
SIGNATURE_CHARS = 200

# Form of incident ids, folders after which a repository begins, empty answer.
INCIDENT_ID = r"(?i)\b(INC(?:IDENT)?-?[0-9][\w-]*)"
PATH_MARKERS = ("/GitHub/", "/github.com/", "/src/")
NO_RESPONSE = "(no assistant response captured)"


def log_signature(line: Column) -> Column:
    """The line with volatile tokens replaced by ``<n>``, first 200 characters."""
    return F.substring(F.regexp_replace(line, VOLATILE_TOKEN, "<n>"), 1, SIGNATURE_CHARS)


def signature_hash(signature: Column) -> Column:
    return F.substring(F.sha1(signature), 1, 16)


def point_id(repo_key: Column, qualified_name: Column) -> Column:
    """Stable 8-4-4-4-12 id of a code node."""
    digest = F.sha1(F.concat(repo_key, F.lit("::"), qualified_name))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def incident_ids(text: Column) -> Column:
    """Incident ids named in the text, first mention first."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(INCIDENT_ID), 1))


def mentioned_names(text: Column, names: Sequence[str]) -> Column:
    """Those of ``names`` that occur in the text as whole words."""
    known = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return F.filter(
        known,
        lambda n: F.regexp_like(
            F.coalesce(text, F.lit("")), F.concat(F.lit(r"\b\Q"), n, F.lit(r"\E\b"))
        ),
    )


def _char_class(body: str) -> str:
    """Regex for the inside of a glob bracket; an empty range matches nothing."""
    negated = body.startswith("!")
    body = body[1:] if negated else body
    items, i = [], 0
    while i < len(body):
        if body[i + 1 : i + 2] == "-" and i + 2 < len(body):
            if body[i] <= body[i + 2]:
                items.append(f"{_literal(body[i])}-{_literal(body[i + 2])}")
            i += 3
        else:
            items.append(_literal(body[i]))
            i += 1
    if not items:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(items)}]"


def _literal(char: str) -> str:
    return char if char.isalnum() or char == "_" else "\\" + char


def glob_regex(pattern: str) -> str:
    """Anchored regex of a shell glob; ``*`` also crosses dots and slashes."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        first = i + 2 if pattern[i + 1 : i + 2] == "!" else i + 1
        close = pattern.find("]", first + 1) if char == "[" else -1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif close > 0:
            out.append(_char_class(pattern[i + 1 : close]))
            i = close
        else:
            out.append(_literal(char))
        i += 1
    return "(?s)^" + "".join(out) + "\\z"


def literal_prefix(pattern: Column) -> Column:
    """What a glob begins with before its first wildcard."""
    return F.regexp_extract(pattern, r"^([^*?\[]*)", 1)


@F.pandas_udf(StringType())
def glob_regexes(patterns: pd.Series) -> pd.Series:
    """Regular expressions of a column of globs (for small tables of rules)."""
    return patterns.map(lambda p: None if p is None else glob_regex(p))


def glob_match(col: Column, pattern: str) -> Column:
    return col.rlike(glob_regex(pattern))


def explicit_reference(summary: Column, deployment_id: Column, commit_sha: Column) -> Column:
    """Which id the summary names: the deployment id first, else the commit; null for neither."""

    def named(identifier: Column) -> Column:
        text = F.coalesce(identifier, F.lit(""))
        return (F.length(text) > 0) & F.contains(F.coalesce(summary, F.lit("")), text)

    return F.when(
        named(deployment_id), F.concat(F.lit("deployment_id '"), deployment_id, F.lit("'"))
    ).when(named(commit_sha), F.concat(F.lit("commit_sha '"), commit_sha, F.lit("'")))


def strip(text: Column) -> Column:
    """Leading and trailing white space (line breaks and tabs too) removed."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clip(text: Column, size: int) -> Column:
    """One line of at most ``size`` characters, cut with an ellipsis."""
    line = F.replace(strip(text), F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) <= size, line).otherwise(
        F.concat(F.substring(line, 1, size - 1), F.lit("…"))
    )


def truncate(text: Column, size: int, marker: str) -> Column:
    return F.when(
        F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("\n" + marker))
    ).otherwise(text)


def project_path(encoded: Column) -> Column:
    """``-home-me-app`` back to ``/home/me/app``."""
    return F.concat(F.lit("/"), F.translate(F.ltrim(encoded, F.lit("-")), "-", "/"))


def short_path(path: Column) -> Column:
    """Path inside its repository when a known parent folder shows where that starts, else the name."""

    def inside(marker: str) -> Column:
        at = F.instr(path, marker)
        rest = path.substr(at + len(marker), F.length(path))
        slash = F.instr(rest, "/")
        return F.when((at > 1) & (slash > 0), rest.substr(slash + 1, F.length(rest)))

    return F.coalesce(
        *[inside(marker) for marker in PATH_MARKERS], F.substring_index(path, "/", -1), F.lit("")
    )


def remote_spec(spec: Column) -> Column:
    """(org, name) of an ssh, http(s) or ``org/name`` repository spec; null fields when neither fits."""
    text = F.trim(spec)
    ssh = r"^git@[^:]*:([^/]+)/(.+?)(?:[.]git)?/*$"
    http = r"^https?://[^/]+/+([^/]+)/([^/]+?)(?:[.]git)?(?:/.*)?$"
    plain = r"^([A-Za-z0-9_.\-]+)/([A-Za-z0-9_.\-]+)$"
    part = lambda n: F.coalesce(
        *[F.when(text.rlike(p), F.regexp_extract(text, p, n)) for p in (ssh, http, plain)]
    )
    return F.struct(part(1).alias("org"), part(2).alias("name"))


def repo_key(spec: Column) -> Column:
    """``org/name`` of a remote spec, ``local:<path>`` otherwise."""
    parsed = remote_spec(spec)
    return F.when(
        parsed["org"].isNotNull(), F.concat_ws("/", parsed["org"], parsed["name"])
    ).otherwise(F.concat(F.lit("local:"), F.trim(spec)))


def provenance(
    created_at: Column,
    user: Column,
    agent: Column,
    machine: Column,
    similarity: Column,
    threshold: float,
    is_cached: Column,
) -> Column:
    """One sentence telling where an answer comes from."""

    def known(col: Column) -> Column:
        return F.coalesce(F.nullif(col, F.lit("")), F.lit("unknown"))

    when = F.coalesce(F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("unknown"))
    cached = F.format_string(
        "Recalled from memory — originally answered on %s by %s via %s on %s "
        "(similarity %.3f, threshold %.2f). Reasoning + verifier LLM calls were skipped. "
        "Proceed with full research?",
        when, known(user), known(agent), known(machine), similarity, F.lit(float(threshold)),
    )
    fresh = F.format_string(
        "Fresh answer (no cache hit above similarity %.2f).", F.lit(float(threshold))
    )
    return F.when(is_cached, cached).otherwise(fresh)
