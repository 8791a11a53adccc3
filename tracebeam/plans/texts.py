"""Queries over texts: redaction, ids, mentions, links of external records, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebeam.functions import jsons, texts, times
from tracebeam.operators import external as ex
from tracebeam.operators import transcripts as tr
from tracebeam.plans.registry import query
from tracebeam.plans.views import SIG, Tables, text
from tracebeam.sources import external_records as er


@query(f"""SELECT doc_id, sig AS signature, substr(sha1(sig), 1, 16) AS signature_hash FROM (SELECT doc_id, {SIG.format("text || ' 0xBEEF 12.5 2024-01-02T03:04:05.6Z ' || md5(text)")} AS sig FROM documents)""")
def log_redaction(t: Tables) -> DataFrame:
    line = F.concat(F.col("text"), F.lit(" 0xBEEF 12.5 2024-01-02T03:04:05.6Z "), F.md5("text"))
    signature = texts.log_signature(line)
    return t.raw("documents").select(
        "doc_id", signature.alias("signature"), texts.signature_hash(signature).alias("signature_hash")
    )


@query("""SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS point_id
    FROM (SELECT p_partkey, sha1(p_brand || '::' || p_name) AS h FROM part)""")
def point_ids(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", texts.point_id(F.col("p_brand"), F.col("p_name")).alias("point_id"))


@query("""SELECT o_orderkey, array_to_string(list_distinct(ids), ';') AS ids FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN ['INC-' || o_orderkey || '-x'] WHEN o_orderkey % 5 = 1 THEN ['incident-' || o_custkey]
    WHEN o_orderkey % 5 = 2 THEN ['INC' || o_custkey] WHEN o_orderkey % 5 = 3 THEN ['INCIDENT-9'] ELSE [] END AS ids FROM orders)""")
def incident_mentions(t: Tables) -> DataFrame:
    form = F.col("o_orderkey") % 5
    body = (
        F.when(form == 0, text("=(INC-", "o_orderkey", "=-x) again"))
        .when(form == 1, text("=see incident-", "o_custkey", "=, incident-", "o_custkey"))
        .when(form == 2, text("=INC", "o_custkey", "= happened"))
        .when(form == 3, F.lit("about INCIDENT-9."))
        .otherwise("since nothing")
    )
    return t.raw("orders").select("o_orderkey", F.array_join(texts.incident_ids(body), ";").alias("ids"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 25 < 20 THEN 'svc' || (o_custkey % 25) ELSE '' END AS services FROM orders""")
def service_mentions(t: Tables) -> DataFrame:
    """Services of the service table that each message names."""
    messages = t.messages
    found = ex.name_mentions(messages, ["o_orderkey"], t.services)
    listed = found.groupBy("o_orderkey").agg(F.array_join(F.sort_array(F.collect_list("name")), ";").alias("services"))
    return messages.select("o_orderkey").join(listed, "o_orderkey", "left").na.fill("", ["services"])


@query("""SELECT doc_id, CASE WHEN length(line) <= 120 THEN line ELSE substr(line, 1, 119) || '…' END AS clipped FROM (SELECT doc_id, replace(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), chr(10), ' ') AS line FROM documents)""")
def clip_text(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", texts.clip(F.col("text"), 120).alias("clipped"))


@query("""SELECT doc_id, CASE WHEN length(text) > 3000 THEN substr(text, 1, 3000) || chr(10) || '…[truncated]' ELSE text END AS text FROM documents""")
def truncate_text(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", texts.truncate(F.col("text"), 3000, "…[truncated]").alias("text"))


@query("""SELECT page_id, '/' || replace(ltrim('-home-user-' || page_id || '-app', '-'), '-', '/') AS project FROM pages""")
def project_paths(t: Tables) -> DataFrame:
    encoded = text("=-home-user-", "page_id", "=-app")
    return t.raw("pages").select("page_id", texts.project_path(encoded).alias("project"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'lib/f' || page_id || '.py' WHEN 1 THEN 'm' || page_id || '.py' WHEN 2 THEN 'plain' || page_id ELSE 'pkg/x.py' END AS path FROM pages""")
def short_paths(t: Tables) -> DataFrame:
    form = F.col("page_id") % 4
    path = (
        F.when(form == 0, text("=/Users/me/GitHub/app/lib/f", "page_id", "=.py"))
        .when(form == 1, text("=/tmp/x/m", "page_id", "=.py"))
        .when(form == 2, text("=plain", "page_id"))
        .otherwise(text("=/home/u/src/repo", "page_id", "=/pkg/x.py"))
    )
    return t.raw("pages").select("page_id", texts.short_path(path).alias("path"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'local:/srv/code' || page_id ELSE 'org' || page_id || '/app.x' END AS repo_key FROM pages""")
def repo_keys(t: Tables) -> DataFrame:
    form = F.col("page_id") % 4
    spec = (
        F.when(form == 0, text("=git@host.example:org", "page_id", "=/app.x.git"))
        .when(form == 1, text("=https://host.example/org", "page_id", "=/app.x/"))
        .when(form == 2, text("=org", "page_id", "=/app.x"))
        .otherwise(text("=/srv/code", "page_id"))
    )
    return t.raw("pages").select("page_id", texts.repo_key(spec).alias("repo_key"))


@query("""SELECT event_id, CASE WHEN k % 4 = 3 THEN NULL WHEN k % 4 = 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR ELSE date_trunc('second', ts) END AS at FROM v_events""")
def parse_iso_times(t: Tables) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("Z", "+0000", "+02:00", "?")]), F.col("k") % 4 + 1)
    return t.events.select("event_id", times.parse_iso(F.concat(stamp, suffix)).alias("at"))


@query("""SELECT event_id, CASE WHEN k % 3 = 2 THEN '' ELSE 'a' || k || ',b' END AS items, CASE WHEN k % 3 = 2 THEN 0 ELSE 2 END AS n, CASE WHEN k % 3 = 1 THEN NULL ELSE CAST(k AS VARCHAR) END AS v FROM v_events""")
def json_coercion(t: Tables) -> DataFrame:
    form = F.col("k") % 3
    listed = F.when(form == 2, "not json").otherwise(text('=["a', "k", '=", "b"]'))
    mapped = F.when(form == 1, F.lit(None).cast("string")).otherwise(text('={"v": ', "k", "=}"))
    items = jsons.string_list(listed)
    return t.events.select(
        "event_id", F.array_join(items, ",").alias("items"), F.size(items).alias("n"),
        F.try_element_at(jsons.string_map(mapped), F.lit("v")).alias("v"),
    )


@query("""SELECT conv_id, array_to_string(list(role ORDER BY first), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1""")
def distinct_in_order(t: Tables) -> DataFrame:
    """Roles of a conversation in order of first appearance, each once."""
    first = t.raw("conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    roles = F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda x: x["role"])
    return first.groupBy("conv_id").agg(F.array_join(F.array_distinct(roles), ",").alias("roles"))


@query("SELECT session_id, pos, role, chunk_id FROM v_chunked")
def assign_chunks(t: Tables) -> DataFrame:
    return tr.assign_chunks(t.turns).select("session_id", "pos", "role", "chunk_id")


@query("SELECT session_id, chunk_id, question, response, n_responses, start_ts, end_ts FROM v_paired")
def pair_turns(t: Tables) -> DataFrame:
    return tr.pair_turns(t.turns)


@query("SELECT session_id, chunk_id, pos, message_id FROM v_chunked")
def chunk_turn_ids(t: Tables) -> DataFrame:
    return tr.chunk_turn_ids(t.turns)


@query("""SELECT session_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY chunk_id DESC) AS n FROM v_paired) WHERE n <= 2
    AND session_id IN (SELECT 's' || conv_id FROM conversations WHERE conv_id % 7 >= 3)""")
def select_chunks(t: Tables) -> DataFrame:
    chunks = tr.pair_turns(t.turns)
    day = F.lit("2024-02-01").cast("timestamp")
    sessions = t.raw("conversations").select("conv_id").distinct().select(
        text("=s", "conv_id").alias("session_id"), text("=/home/p", F.col("conv_id") % 2).alias("project"),
        F.timestamp_micros(F.unix_micros(day) + (F.col("conv_id") % 7) * 86_400_000_000).alias("modified_at"),
    )
    picked = tr.select_chunks(chunks, sessions, since="2024-02-04", project="/home", max_per_session=2)
    return picked.select("session_id", "chunk_id")


@query("""SELECT session_id, chunk_id, '## ' || chunk_id || '. ' || question || chr(10) || chr(10) || '_' || strftime(start_ts, '%Y-%m-%d %H:%M') || ' — session ' || substr(session_id, 1, 8) || '_'
    || chr(10) || chr(10) || response || chr(10) || chr(10) || '---' || chr(10) AS section FROM v_paired""")
def chunk_bundle(t: Tables) -> DataFrame:
    return tr.chunk_bundle(tr.pair_turns(t.turns))


def turns_with_tools(t: Tables) -> DataFrame:
    """Assistant turns use two tools each: one on a file named by the turn, one fixed by position."""
    names = F.array(*[F.lit(n) for n in ("Edit", "Write", "Read", "Bash", "Task", "Grep", "Read", "TodoWrite")])
    name = F.element_at(names, (F.col("turn") % 8 + 1).cast("int"))
    first = F.struct(
        name.alias("name"),
        F.create_map(
            F.lit("file_path"), text("=/w/src/app/m", F.col("turn") % 3, "=.py"),
            F.lit("command"), text("=run ", "turn"), F.lit("description"), text("=step ", "turn"),
            F.lit("todos"), text('=[{"status":"completed","content":"t', "turn", '="},{"content":"next"}]'),
        ).alias("input"),
    )
    second = F.struct(
        F.lit("Read").alias("name"),
        F.create_map(F.lit("file_path"), text("=/tmp/r", "turn", "=.txt")).alias("input"),
    )
    none = F.array().cast("array<struct<name: string, input: map<string,string>>>")
    uses = F.when(F.col("role") == "assistant", F.array(first, second)).otherwise(none)
    return t.turns.withColumn("tool_uses", uses)


ACTIONS_SQL = """SELECT session_id, chunk_id, '**Actions taken in this turn:**' || coalesce(chr(10) || '- **Edited:** ' || string_agg(f, ', ' ORDER BY o) FILTER (b = 'edited'), '')
    || coalesce(chr(10) || '- **Wrote:** ' || string_agg(f, ', ' ORDER BY o) FILTER (b = 'wrote'), '')
    || coalesce(chr(10) || '- **Read:** ' || string_agg(f, ', ' ORDER BY o) FILTER (b = 'read' AND r <= 10) || (CASE WHEN CAST(sum(n) FILTER (b = 'read') AS BIGINT) > 10 THEN ' (+' || (CAST(sum(n) FILTER (b = 'read') AS BIGINT) - 10) || ' more)' ELSE '' END), '')
    || coalesce(chr(10) || '- **Ran:**' || chr(10) || string_agg(f, chr(10) ORDER BY o) FILTER (b = 'ran'), '')
    || coalesce(chr(10) || '- **Sub-agents:**' || chr(10) || string_agg(f, chr(10) ORDER BY o) FILTER (b = 'agents'), '')
    || coalesce(chr(10) || '- **Other tool calls:** ' || string_agg(f || '(' || n || ')', ', ' ORDER BY f) FILTER (b = 'other'), '') AS actions
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id, chunk_id, b ORDER BY o) AS r FROM (SELECT session_id, chunk_id, b, f, min(pos * 2 + i) AS o, count(*) AS n FROM (
    SELECT session_id, chunk_id, pos, 0 AS i, ['edited', 'wrote', 'read', 'ran', 'agents', 'other', 'read', 'todos'][turn % 8 + 1] AS b,
    CASE turn % 8 WHEN 3 THEN '  - `run ' || turn || '`  — step ' || turn WHEN 4 THEN '  - general: step ' || turn WHEN 5 THEN 'Grep' ELSE 'm' || (turn % 3) || '.py' END AS f FROM v_chunked WHERE role = 'assistant'
    UNION ALL SELECT session_id, chunk_id, pos, 1, 'read', 'r' || turn || '.txt' FROM v_chunked WHERE role = 'assistant') WHERE b <> 'todos' GROUP BY ALL)) GROUP BY ALL"""
TASKS_SQL = """SELECT session_id, chunk_id, '**Final task list:**' || chr(10) || '- ✅ t' || max(turn) || chr(10) || '- ⬜ next' AS tasks FROM v_chunked WHERE role = 'assistant' AND turn % 8 = 7 GROUP BY ALL"""


@query(f"SELECT session_id, chunk_id, actions, tasks FROM ({ACTIONS_SQL}) LEFT JOIN ({TASKS_SQL}) USING (session_id, chunk_id)")
def tool_digest(t: Tables) -> DataFrame:
    return tr.summarise_actions(tr.assign_chunks(turns_with_tools(t)))


@query(f"""SELECT c.session_id, c.chunk_id, c.question, coalesce(concat_ws(chr(10) || chr(10), CASE WHEN length(prose) > 3000 THEN substr(prose, 1, 3000) || chr(10) || '…[prose truncated]' ELSE prose END, actions, tasks), '') AS response_
    FROM v_chunks c LEFT JOIN ({ACTIONS_SQL}) USING (session_id, chunk_id) LEFT JOIN ({TASKS_SQL}) USING (session_id, chunk_id)""")
def pair_session_turns(t: Tables) -> DataFrame:
    out = tr.pair_session_turns(turns_with_tools(t))
    shown = F.when(F.col("response") == texts.NO_RESPONSE, "").otherwise(F.col("response"))
    return out.select("session_id", "chunk_id", "question", shown.alias("response_"))


@query("""SELECT m.channel, m.ts, 'INC-' || (o_orderkey % 4000) AS incident_id, i.id IS NOT NULL AS known FROM v_messages m LEFT JOIN v_incidents i ON i.id = 'INC-' || (o_orderkey % 4000)""")
def link_chat_incidents(t: Tables) -> DataFrame:
    return ex.link_mentions(messages(t), t.incidents, t.services)["discusses"]


def messages(t: Tables) -> DataFrame:
    names = [f"svc{n}" for n in range(25)]
    return t.messages.withColumn("incident_ids", texts.incident_ids(F.col("text"))).withColumn(
        "service_names", texts.mentioned_names(F.col("text"), names)
    )


@query("""SELECT m.channel, m.ts, 'svc' || (o_custkey % 25) AS name, s.env_key FROM v_messages m LEFT JOIN v_services s ON s.name = 'svc' || (o_custkey % 25)""")
def link_chat_services(t: Tables) -> DataFrame:
    return ex.link_mentions(messages(t), t.incidents, t.services)["mentions"]


@query("""SELECT DISTINCT 'INC-' || (o_orderkey % 4000) AS id, 'auto-from-chat' AS source FROM orders WHERE 'INC-' || (o_orderkey % 4000) NOT IN (SELECT id FROM v_incidents)
    UNION ALL SELECT DISTINCT 'svc' || (o_custkey % 25), 'auto-from-chat' FROM orders WHERE 'svc' || (o_custkey % 25) NOT IN (SELECT name FROM v_services)""")
def mention_stubs(t: Tables) -> DataFrame:
    links = ex.link_mentions(messages(t), t.incidents, t.services)
    return links["incident_stubs"].unionByName(links["service_stubs"].select(F.col("name").alias("id"), "source"))


def issues_of(t: Tables) -> DataFrame:
    body = F.to_json(F.struct(
        text("=INC-", "o_orderkey").alias("key"),
        F.struct(
            text("=Outage INC-", "o_custkey", "=-slug").alias("summary"),
            F.struct(F.col("o_orderstatus").alias("name")).alias("status"),
            F.struct(text("=A", F.col("o_custkey") % 9).alias("displayName")).alias("assignee"),
            F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T14:00:00.000+0000")).alias("created"),
            F.array(F.lit("p1"), F.col("o_orderpriority")).alias("labels"),
            F.struct(F.col("o_orderpriority").alias("name")).alias("priority"),
        ).alias("fields"),
    ))
    return t.raw("orders").select(body.alias("value"))


@query("""SELECT 'jira' AS provider, 'INC-' || o_orderkey AS key, 'Outage INC-' || o_custkey || '-slug' AS title, o_orderstatus AS status, 'A' || (o_custkey % 9) AS assignee, o_orderdate + INTERVAL 14 HOUR AS created_at,
    'https://tickets.example/browse/INC-' || o_orderkey AS url, 'INC-' || o_custkey || '-slug' AS incident_ids, 'p1;' || o_orderpriority AS labels, o_orderpriority AS priority FROM orders""")
def tickets_from_issues(t: Tables) -> DataFrame:
    out = er.normalise_issues(issues_of(t), "https://tickets.example")
    return out.select(
        "provider", "key", "title", "status", "assignee", "created_at", "url",
        F.array_join("incident_ids", ";").alias("incident_ids"), F.array_join("labels", ";").alias("labels"), "priority",
    )


@query("""SELECT 'linear' AS provider, 'ENG-' || o_orderkey AS key, 'In ' || o_orderstatus AS status, 'E' || (o_custkey % 9) AS assignee, o_orderdate + INTERVAL 14 HOUR AS created_at,
    'INC-' || o_custkey || '-slug;incident-' || o_orderkey AS incident_ids, 'bug;' || o_orderpriority AS labels, 'Urgent' AS priority FROM orders""")
def tickets_from_nodes(t: Tables) -> DataFrame:
    node = F.struct(
        text("=ENG-", "o_orderkey").alias("identifier"), text("=Look at INC-", "o_custkey", "=-slug").alias("title"),
        text("=see incident-", "o_orderkey").alias("description"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T14:00:00.000Z")).alias("createdAt"),
        F.lit("Urgent").alias("priorityLabel"),
        F.struct(F.array(F.struct(F.lit("bug").alias("name")), F.struct(F.col("o_orderpriority").alias("name"))).alias("nodes")).alias("labels"),
        F.struct(text("=In ", "o_orderstatus").alias("name")).alias("state"),
        F.struct(text("=E", F.col("o_custkey") % 9).alias("displayName")).alias("assignee"),
    )
    reply = F.to_json(F.struct(F.struct(F.struct(F.array(node).alias("nodes")).alias("issues")).alias("data")))
    out = er.normalise_issue_nodes(t.raw("orders").select(reply.alias("value")))
    return out.select(
        "provider", "key", "status", "assignee", "created_at", F.array_join("incident_ids", ";").alias("incident_ids"),
        F.array_join("labels", ";").alias("labels"), "priority",
    )


@query("""SELECT 'jira' AS provider, 'INC-' || o_orderkey AS key, 'INC-' || o_custkey || '-slug' AS incident_id, false AS known FROM orders""")
def link_tickets(t: Tables) -> DataFrame:
    tickets = er.normalise_issues(issues_of(t), "https://tickets.example")
    return ex.link_tickets(tickets, t.incidents)["links_to"]


@query("""SELECT 'C' || (o_custkey % 10) AS channel, o_orderkey || '.000100' AS ts, 'U' || (o_custkey % 50) AS author, to_timestamp(o_orderkey)::TIMESTAMP + INTERVAL 100 MICROSECOND AS posted_at,
    'INC-' || (o_orderkey % 4000) AS incident_ids, CASE WHEN o_custkey % 25 < 20 THEN 'svc' || (o_custkey % 25) ELSE '' END AS service_names FROM orders WHERE o_custkey % 7 <> 0""")
def chat_messages(t: Tables) -> DataFrame:
    message = F.struct("ts", F.col("author").alias("user"), "text")
    body = F.to_json(F.struct((F.col("o_custkey") % 7 != 0).alias("ok"), F.array(message).alias("messages")))
    records = t.messages.select(text("=C", F.col("o_custkey") % 10).alias("channel"), body.alias("value"))
    out = er.normalise_chat(records, [f"svc{n}" for n in range(20)])
    return out.select(
        "channel", "ts", "author", "posted_at", F.array_join("incident_ids", ";").alias("incident_ids"),
        F.array_join("service_names", ";").alias("service_names"),
    )


@query("""SELECT 'repo' || (o_custkey % 4) AS repo_key, o_orderkey AS number, 'merged' AS state, 'sha' || o_orderkey AS merge_commit_sha, o_orderdate AS merged_at FROM orders WHERE o_orderkey % 3 = 0""")
def merge_commit_pull_requests(t: Tables) -> DataFrame:
    subject = F.when(F.col("o_orderkey") % 3 == 0, text("=Merge pull request #", "o_orderkey", "= from me/x")).otherwise("fix Merge pull request #7 from y")
    commits = t.raw("orders").select(
        text("=repo", F.col("o_custkey") % 4).alias("repo_key"), text("=sha", "o_orderkey").alias("sha"), subject.alias("subject"),
        text("=dev", F.col("o_custkey") % 9).alias("author"), F.col("o_orderdate").alias("committed_at"),
    )
    return er.pull_requests_from_commits(commits).select("repo_key", "number", "state", "merge_commit_sha", "merged_at")


def pull_requests_of(t: Tables) -> DataFrame:
    body = F.to_json(F.struct(
        (F.col("o_orderkey") + 1).alias("number"), text("=change ", "o_custkey").alias("title"), F.lit("MERGED").alias("state"),
        F.struct(text("=dev", F.col("o_custkey") % 9).alias("login")).alias("author"),
        F.when(F.col("o_orderkey") % 2 == 0, F.struct(text("=sha", "o_orderkey").alias("oid"))).alias("mergeCommit"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("createdAt"),
        F.array(F.struct(F.col("o_orderpriority").alias("name"))).alias("labels"),
    ))
    records = t.raw("orders").select(text("=repo", F.col("o_custkey") % 4).alias("repo_key"), body.alias("value"))
    return er.normalise_pull_requests(records)


@query("""SELECT 'repo' || (o_custkey % 4) AS repo_key, o_orderkey + 1 AS number, 'change ' || o_custkey AS title, 'merged' AS state, 'dev' || (o_custkey % 9) AS author,
    CASE WHEN o_orderkey % 2 = 0 THEN 'sha' || o_orderkey END AS merge_commit_sha, o_orderdate AS created_at, o_orderpriority AS labels FROM orders""")
def pull_requests(t: Tables) -> DataFrame:
    return pull_requests_of(t).select(
        "repo_key", "number", "title", "state", "author", "merge_commit_sha", "created_at", F.array_join("labels", ";").alias("labels")
    )


@query("""SELECT 'repo' || (o_custkey % 4) AS repo_key, o_orderkey + 1 AS number, 'authored_by' AS edge, 'dev' || (o_custkey % 9) AS target FROM orders
    UNION ALL SELECT 'repo' || (o_custkey % 4), o_orderkey + 1, 'merges', 'sha' || o_orderkey FROM orders WHERE o_orderkey % 2 = 0""")
def link_pull_requests(t: Tables) -> DataFrame:
    links = ex.link_pull_requests(pull_requests_of(t))
    people = links["authored_by"].select("repo_key", "number", F.lit("authored_by").alias("edge"), F.col("login").alias("target"))
    return people.unionByName(links["merges"].select("repo_key", "number", F.lit("merges").alias("edge"), F.col("sha").alias("target")))
