"""Pull requests, chat messages and tickets from their JSON shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracebeam.functions.texts import incident_ids, mentioned_names
from tracebeam.functions.times import parse_iso

PULL_REQUEST = (
    "struct<number: bigint, title: string, state: string, author: struct<login: string>, "
    "body: string, headRefOid: string, mergeCommit: struct<oid: string>, createdAt: string, "
    "mergedAt: string, labels: array<struct<name: string>>, url: string>"
)
CHAT = "struct<ok: boolean, messages: array<struct<ts: string, user: string, text: string>>>"
NAMED = "struct<name: string>"
SHOWN = "struct<displayName: string>"
ISSUE = (
    f"struct<key: string, fields: struct<summary: string, status: {NAMED}, assignee: {SHOWN}, "
    f"reporter: {SHOWN}, created: string, updated: string, resolutiondate: string, "
    f"labels: array<string>, priority: {NAMED}, description: string>>"
)
NODES = (
    "struct<data: struct<issues: struct<nodes: array<struct<identifier: string, title: string, "
    "description: string, url: string, createdAt: string, updatedAt: string, completedAt: string, "
    f"priorityLabel: string, labels: struct<nodes: array<{NAMED}>>, state: {NAMED}, "
    f"assignee: {SHOWN}, creator: {SHOWN}>>>>>"
)
MERGE_SUBJECT = r"^Merge pull request #([0-9]+) from "
NO_LABELS = "array<string>"


def normalise_pull_requests(records: DataFrame) -> DataFrame:
    """Pull requests from JSON (repo_key, value)."""
    p = F.from_json("value", PULL_REQUEST)
    return records.select(
        "repo_key", p["number"].alias("number"), p["title"].alias("title"),
        F.lower(p["state"]).alias("state"), p["author"]["login"].alias("author"),
        p["body"].alias("body"), p["headRefOid"].alias("head_commit_sha"),
        p["mergeCommit"]["oid"].alias("merge_commit_sha"),
        parse_iso(p["createdAt"]).alias("created_at"), parse_iso(p["mergedAt"]).alias("merged_at"),
        F.coalesce(F.transform(p["labels"], lambda x: x["name"]), F.array().cast(NO_LABELS)).alias("labels"),
        p["url"].alias("url"),
        F.concat(F.lit("github://"), "repo_key").alias("source"),
        p["number"].cast("string").alias("external_id"),
    ).where((F.col("number") >= 1) & (F.col("title") != "") & F.col("created_at").isNotNull())


def pull_requests_from_commits(commits: DataFrame) -> DataFrame:
    """Merged pull requests told by merge-commit subjects (repo_key, sha, subject, author,
    committed_at)."""
    return commits.where(F.col("subject").rlike(MERGE_SUBJECT)).select(
        "repo_key",
        F.regexp_extract("subject", MERGE_SUBJECT, 1).cast("bigint").alias("number"),
        F.col("subject").alias("title"),
        F.lit("merged").alias("state"),
        "author",
        F.col("sha").alias("merge_commit_sha"),
        F.col("committed_at").alias("created_at"),
        F.col("committed_at").alias("merged_at"),
    )


def normalise_chat(records: DataFrame, known_services: Sequence[str] = ()) -> DataFrame:
    """Chat messages from history replies (channel, value); replies that are not ok are left out."""
    body = F.from_json("value", CHAT)
    rows = records.where(body["ok"]).select("channel", F.explode(body["messages"]).alias("m"))
    text = F.col("m.text")
    return rows.where((F.col("m.ts") != "") & (text != "")).select(
        "channel", F.col("m.ts").alias("ts"), F.col("m.user").alias("author"), text.alias("text"),
        F.timestamp_micros(
            (F.col("m.ts").try_cast("decimal(20,6)") * 1_000_000).cast("bigint")
        ).alias("posted_at"),
        incident_ids(text).alias("incident_ids"),
        mentioned_names(text, known_services).alias("service_names"),
        F.concat(F.lit("slack://"), "channel").alias("source"),
    )


def _ids_of(*texts: Column) -> Column:
    return incident_ids(F.concat_ws("\n", *texts))


def normalise_issues(records: DataFrame, base_url: str) -> DataFrame:
    """Tickets from issue JSON (value)."""
    t = F.from_json("value", ISSUE)
    f = t["fields"]
    return records.where(t["key"].isNotNull()).select(
        F.lit("jira").alias("provider"), t["key"].alias("key"), f["summary"].alias("title"),
        f["status"]["name"].alias("status"), f["assignee"]["displayName"].alias("assignee"),
        f["reporter"]["displayName"].alias("reporter"), parse_iso(f["created"]).alias("created_at"),
        parse_iso(f["updated"]).alias("updated_at"), parse_iso(f["resolutiondate"]).alias("closed_at"),
        F.concat(F.lit(base_url.rstrip("/") + "/browse/"), t["key"]).alias("url"),
        _ids_of(f["summary"], f["description"]).alias("incident_ids"),
        F.coalesce(f["labels"], F.array().cast(NO_LABELS)).alias("labels"),
        f["priority"]["name"].alias("priority"),
    )


def normalise_issue_nodes(records: DataFrame) -> DataFrame:
    """Tickets from GraphQL replies (value)."""
    nodes = F.from_json("value", NODES)["data"]["issues"]["nodes"]
    n = F.col("n")
    return records.select(F.explode(nodes).alias("n")).where(n["identifier"].isNotNull()).select(
        F.lit("linear").alias("provider"), n["identifier"].alias("key"), n["title"].alias("title"),
        n["state"]["name"].alias("status"), n["assignee"]["displayName"].alias("assignee"),
        n["creator"]["displayName"].alias("reporter"), parse_iso(n["createdAt"]).alias("created_at"),
        parse_iso(n["updatedAt"]).alias("updated_at"), parse_iso(n["completedAt"]).alias("closed_at"),
        n["url"].alias("url"), _ids_of(n["title"], n["description"]).alias("incident_ids"),
        F.coalesce(F.transform(n["labels"]["nodes"], lambda x: x["name"]), F.array().cast(NO_LABELS)).alias("labels"),
        n["priorityLabel"].alias("priority"),
    )
