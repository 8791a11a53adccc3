"""Pull requests, chats and tickets: links to incidents, services and commits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebeam.operators.skew import ROWS_PER_TASK, salted_join


def _id_links(
    records: DataFrame, key: list[str], incidents: DataFrame, source: str
) -> tuple[DataFrame, DataFrame]:
    """(edges, stub incidents): one edge per record and named incident, stubs for unknown ones."""
    named = records.select(*key, F.explode(F.array_distinct("incident_ids")).alias("incident_id"))
    known = incidents.select(F.col("id").alias("incident_id"), F.lit(True).alias("known")).distinct()
    # an incident everybody talks about is a hot key
    edges = salted_join(named, known, ["incident_id"], key, "left").select(
        *key, "incident_id", F.coalesce("known", F.lit(False)).alias("known")
    )
    stubs = edges.where(~F.col("known")).select(F.col("incident_id").alias("id")).distinct()
    return edges, stubs.withColumn("source", F.lit(source))


def name_mentions(
    texts: DataFrame, key: Sequence[str], names: DataFrame, text: str = "text", name: str = "name",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """(key, name): names of a table that occur in the texts as whole words, one row each.

    Names are filed under their first word; texts look up their distinct words, so a name is only tested
    against texts that hold its first word. Texts are shuffled once, to test the names proposed. Names
    without any word character are tested on every text. Null texts and names match nothing.
    """
    word = F.regexp_extract(F.col("name"), r"\w+", 0)
    filed = (
        names.select(F.col(name).alias("name")).where(F.length("name") > 0).distinct()
        .select("name", word.alias("word"))
    )
    said = texts.where(F.col(text).isNotNull()).select(
        *key, F.explode(F.array_union(F.regexp_extract_all(F.col(text), F.lit(r"\w+"), 0), F.array(F.lit("")))).alias("word")
    )
    proposed = salted_join(said, filed, ["word"], key, rows_per_task=rows_per_task).select(*key, "name")
    whole = proposed.join(texts.select(*key, F.col(text).alias("_text")), list(key))
    return whole.where(
        F.regexp_like("_text", F.concat(F.lit(r"\b\Q"), "name", F.lit(r"\E\b")))
    ).select(*key, "name").distinct()


def link_mentions(
    messages: DataFrame, incidents: DataFrame, services: DataFrame
) -> dict[str, DataFrame]:
    """Edges of chat messages: DISCUSSES incidents by id, MENTIONS services of that name in every
    environment. Unknown incidents and services become stubs."""
    key = ["channel", "ts"]
    discusses, incident_stubs = _id_links(messages, key, incidents, "auto-from-chat")
    named = messages.select(*key, F.explode(F.array_distinct("service_names")).alias("name"))
    known = services.select("name", "env_key").distinct()
    mentions = salted_join(named, known, ["name"], key, "left")
    service_stubs = (
        mentions.where(F.col("env_key").isNull()).select("name").distinct()
        .withColumn("source", F.lit("auto-from-chat"))
    )
    return {
        "discusses": discusses, "mentions": mentions,
        "incident_stubs": incident_stubs, "service_stubs": service_stubs,
    }


def link_tickets(tickets: DataFrame, incidents: DataFrame) -> dict[str, DataFrame]:
    """Edges of tickets: LINKS_TO incidents by id, ASSIGNED_TO people."""
    links, stubs = _id_links(tickets, ["provider", "key"], incidents, "auto-from-ticket")
    people = tickets.where(F.col("assignee").isNotNull()).select(
        "provider", "key", F.col("assignee").alias("login")
    )
    return {"links_to": links, "assigned_to": people, "incident_stubs": stubs}


def link_pull_requests(pull_requests: DataFrame) -> dict[str, DataFrame]:
    """Edges of pull requests: AUTHORED_BY people, MERGES commits."""
    key = ["repo_key", "number"]
    return {
        "authored_by": pull_requests.where(F.col("author").isNotNull()).select(
            *key, F.col("author").alias("login")
        ),
        "merges": pull_requests.where(F.col("merge_commit_sha").isNotNull()).select(
            *key, F.col("merge_commit_sha").alias("sha")
        ),
    }
