"""Queries over vectors and memories: search, retrieval, cache, dedupe, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebeam.functions.embedding import hash_embedding
from tracebeam.functions.scores import cosine
from tracebeam.operators import memory as ops
from tracebeam.operators import memory_store
from tracebeam.operators import retrieval as re_
from tracebeam.operators import runtime as rt
from tracebeam.operators import search_index
from tracebeam.operators import tables as tb
from tracebeam.operators import transcripts as tr
from tracebeam.plans.causality import six
from tracebeam.plans.registry import query
from tracebeam.plans.views import AS_OF, Tables, text
from tracebeam.session import materialize, scratch_path, spread

TOP = """SELECT query_id, id, qualified_name, parent, repo_key, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM v_sims"""


def query_vectors(t: Tables) -> DataFrame:
    return t.vectors.select(F.col("id").alias("query_id"), "repo_key", "vector")


@query("""SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(n.embedding AS DOUBLE[])), 6) AS cosine
    FROM embeddings e JOIN embeddings n ON n.vec_id = e.vec_id + 1""")
def cosine_pairs(t: Tables) -> DataFrame:
    e = t.raw("embeddings")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("following"))
    pair = e.join(following, "vec_id")
    return pair.select("vec_id", F.round(cosine(F.col("embedding"), F.col("following")), 6).alias("cosine"))


@query(f"SELECT query_id, id, rank, round(sim, 6) AS similarity FROM ({TOP}) WHERE rank <= 10")
def vector_search(t: Tables) -> DataFrame:
    return re_.vector_search(query_vectors(t), t.vectors).select("query_id", "id", "rank", *six("similarity"))


@query(f"SELECT query_id, id, rank, round(sim, 6) AS similarity FROM ({TOP}) WHERE rank <= 10")
def vector_search_indexed(t: Tables) -> DataFrame:
    """The same search through a stored index with small cells."""
    path = scratch_path(t.spark, "search-index")
    search_index.build_index(t.vectors, path, cell_rows=32)
    return search_index.search_index(query_vectors(t), path, 10).select("query_id", "id", "rank", *six("similarity"))


@query(f"""SELECT query_id, id, rank, round(sim, 6) AS similarity FROM (SELECT s.query_id, s.id, s.sim, row_number() OVER (PARTITION BY s.query_id ORDER BY s.sim DESC, s.id) AS rank
    FROM v_sims s WHERE s.id % 2 = 0 AND s.repo_key = 'repo2') WHERE rank <= 3""")
def vector_search_scoped(t: Tables) -> DataFrame:
    found = re_.vector_search(query_vectors(t), t.vectors, 3, repo_key="repo2", kind="function")
    return found.select("query_id", "id", "rank", *six("similarity"))


HYBRID = f"""WITH hits AS (SELECT query_id, repo_key, qualified_name, parent, sim AS score, min(sim) OVER (PARTITION BY query_id) AS worst,
    count(*) OVER (PARTITION BY query_id) AS n FROM ({TOP}) WHERE rank <= 20),
    near AS (SELECT DISTINCT h.query_id, h.worst, h.n, x.name FROM hits h JOIN (SELECT DISTINCT repo_key, parent, parent AS name FROM v_vectors
    UNION ALL SELECT repo_key, parent, qualified_name FROM v_vectors) x ON x.repo_key = h.repo_key AND x.parent = h.parent),
    fresh AS (SELECT n.* FROM near n ANTI JOIN hits h ON h.query_id = n.query_id AND h.qualified_name = n.name),
    found AS (SELECT query_id, qualified_name, 'vector' AS source, score, n FROM hits UNION ALL
    SELECT query_id, name, 'graph_expand', greatest(0, worst * 0.5), n FROM fresh),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source DESC, qualified_name) AS rank FROM found) WHERE rank <= 10)"""


def hybrid(t: Tables) -> DataFrame:
    return re_.hybrid_retrieve(query_vectors(t), t.vectors, t.vector_contains)


@query(f"{HYBRID} SELECT query_id, qualified_name, source, rank, round(score, 6) AS score FROM best")
def hybrid_retrieve(t: Tables) -> DataFrame:
    return hybrid(t).select("query_id", "qualified_name", "source", "rank", *six("score"))


@query(f"""{HYBRID} SELECT query_id, round(least(1, greatest(0, max(score) FILTER (rank = 1))), 6) AS score, max(n) AS evidence_count,
    round(coalesce(avg(score) FILTER (rank <= 3 AND score > 0), 0), 6) AS retrieval_strength, max(qualified_name) FILTER (rank = 1) AS top_name,
    count(*) FILTER (source = 'graph_expand') AS expanded FROM best GROUP BY 1""")
def retrieval_confidence(t: Tables) -> DataFrame:
    out = re_.retrieval_confidence(query_vectors(t), hybrid(t))
    return out.select(
        "query_id", *six("score"), "evidence_count", *six("retrieval_strength"),
        F.regexp_extract(F.col("derivation")[0], r"top hit: (.*) \(score", 1).alias("top_name"),
        F.regexp_extract(F.col("derivation")[2], r"(\d+)$", 1).cast("bigint").alias("expanded"),
    )


@query(f"""{HYBRID} SELECT query_id, string_agg(qualified_name, ';' ORDER BY rank) AS names, round(sum(score), 3) AS total FROM best GROUP BY 1""")
def citations(t: Tables) -> DataFrame:
    # read twice, searched once
    found = materialize(hybrid(t), "citation-candidates")
    out = re_.citations(found)
    names = F.array_join(F.transform("citations", lambda c: c["qualified_name"]), ";")
    # cited scores carry four decimals, the total is compared to fewer
    total = found.groupBy("query_id").agg(F.round(F.sum("score"), 3).alias("total"))
    return out.select("query_id", names.alias("names")).join(total, "query_id")


def cases_of(t: Tables) -> DataFrame:
    n = F.col("id")
    expected = F.array(
        text("=f", n + 4), text("=zz.pkg", (n + 8) % 50, "=.f", n + 8),
        F.when(n % 3 == 0, text("=f", n)).otherwise("none"),
    )
    return t.vectors.select(F.col("repo_key").alias("corpus"), F.col("id").alias("query_id"), expected.alias("expected_any"))


RANKS = f"""SELECT c.repo_key AS corpus, c.id AS query_id, min(r.rank) FILTER (r.qualified_name LIKE '%.f' || (c.id + 4) OR r.qualified_name = 'pkg' || ((c.id + 8) % 50) || '.f' || (c.id + 8)
    OR (c.id % 3 = 0 AND r.qualified_name LIKE '%.f' || c.id)) AS hit_rank FROM v_vectors c LEFT JOIN ({TOP}) r ON r.query_id = c.id AND r.rank <= 10 GROUP BY ALL"""


def ranks_of(t: Tables) -> DataFrame:
    found = re_.vector_search(query_vectors(t), t.vectors).join(t.vectors.select("id", "qualified_name"), "id")
    return re_.hit_ranks(cases_of(t), found)


@query(RANKS)
def hit_ranks(t: Tables) -> DataFrame:
    return ranks_of(t)


@query(f"""SELECT corpus, count(*) AS n_cases, round(avg(CASE WHEN hit_rank <= 1 THEN 1.0 ELSE 0.0 END), 3) AS recall_at_1, round(avg(CASE WHEN hit_rank <= 3 THEN 1.0 ELSE 0.0 END), 3) AS recall_at_3,
    round(avg(CASE WHEN hit_rank <= 5 THEN 1.0 ELSE 0.0 END), 3) AS recall_at_5, round(avg(CASE WHEN hit_rank <= 10 THEN 1.0 ELSE 0.0 END), 3) AS recall_at_10 FROM ({RANKS}) GROUP BY 1""")
def recall_at_k(t: Tables) -> DataFrame:
    return re_.recall_at(ranks_of(t))


@query("SELECT coalesce(repo_key, '(total)') AS repo_key, count(*) AS points FROM v_vectors GROUP BY ROLLUP (repo_key)")
def vector_stats(t: Tables) -> DataFrame:
    return re_.vector_stats(t.vectors)


@query("""SELECT query_id, memory_id, rank, round(sim, 6) AS similarity FROM (SELECT q.n AS query_id, m.id AS memory_id, round(list_cosine_similarity(q.vector, m.vector), 9) AS sim,
    row_number() OVER (PARTITION BY q.n ORDER BY round(list_cosine_similarity(q.vector, m.vector), 9) DESC, m.id) AS rank FROM v_memories q JOIN v_memories m ON m.repo_key = q.repo_key) WHERE rank <= 5 AND sim >= 0.1""")
def recall_similar(t: Tables) -> DataFrame:
    asked = t.memories.select(F.substring("id", 5, 12).cast("bigint").alias("query_id"), "repo_key", "vector")
    return ops.recall_similar(asked, t.memories, min_similarity=0.1).select(
        "query_id", "memory_id", "rank", *six("similarity")
    )


def asked_again(t: Tables) -> DataFrame:
    """Each memory's vector mixed with its own reverse, more or less strongly."""
    share = (F.substring("id", 5, 12).cast("int") % 4 * 0.25).cast("double")
    mixed = F.zip_with("vector", F.reverse("vector"), lambda x, y: x.cast("double") + share * y.cast("double"))
    return t.memories.select(F.col("id").alias("query_id"), "repo_key", mixed.alias("vector"))


LOOKUP = """SELECT q.query_id, m.*, round(list_cosine_similarity(q.v, m.vector), 9) AS sim FROM (SELECT id AS query_id, repo_key,
    list_transform(list_zip(vector, list_reverse(vector)), lambda p: p[1] + (n % 4 * 0.25)::DOUBLE * p[2]) AS v FROM v_memories) q JOIN v_memories m ON m.repo_key = q.repo_key"""
CACHED = f"""SELECT a.id AS query_id, b.id AS memory_id, sim, coalesce(sim >= 0.92, false) AS is_cached, answer, created_at, user_id, origin_agent, machine_id FROM (SELECT id FROM v_memories) a
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS r FROM ({LOOKUP}) WHERE sim >= 0.85) WHERE r = 1) b ON b.query_id = a.id"""


@query(f"""SELECT query_id, memory_id, round(sim, 6) AS similarity, is_cached, CASE WHEN is_cached THEN answer END AS answer,
    CASE WHEN is_cached THEN 'Recalled from memory — originally answered on ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || ' by ' || user_id || ' via ' || origin_agent || ' on ' || machine_id
    || ' (similarity ' || printf('%.3f', sim) || ', threshold 0.92). Reasoning + verifier LLM calls were skipped. Proceed with full research?'
    ELSE 'Fresh answer (no cache hit above similarity 0.92).' END AS preamble FROM ({CACHED})""")
def cache_lookup(t: Tables) -> DataFrame:
    return ops.cache_lookup(asked_again(t), t.memories).select(
        "query_id", "memory_id", *six("similarity"), "is_cached", "answer", "preamble"
    )


@query(f"""SELECT m.id, m.recall_hits + coalesce(h.n, 0) AS recall_hits FROM v_memories m LEFT JOIN (SELECT memory_id, count(*) AS n FROM ({CACHED}) WHERE is_cached GROUP BY 1) h ON h.memory_id = m.id""")
def bump_recall_hits(t: Tables) -> DataFrame:
    found = ops.cache_lookup(asked_again(t), t.memories)
    return tb.bump_hits(t.memories, ops.cache_hits(found)).select("id", "recall_hits")


@query("SELECT id, created_at FROM v_memories WHERE repo_key = 'repo1' ORDER BY created_at DESC, id LIMIT 20")
def recall_recent(t: Tables) -> DataFrame:
    return ops.recall_recent(t.memories, "repo1").select("id", "created_at")


@query("SELECT id, recall_hits FROM v_memories ORDER BY recall_hits DESC, created_at DESC, id LIMIT 20")
def top_recalled(t: Tables) -> DataFrame:
    return ops.top_recalled(t.memories).select("id", "recall_hits")


@query("SELECT repo_key, count(*) AS memories, GROUPING(repo_key) AS is_total FROM v_memories GROUP BY ROLLUP (repo_key)")
def memory_stats(t: Tables) -> DataFrame:
    return ops.memory_stats(t.memories).select("repo_key", "memories", F.col("is_total").cast("bigint").alias("is_total"))


@query("""SELECT dim, name, n AS writes, CASE WHEN dim = 'total' THEN round(f / n * 100, 2) END AS dedupe_rate_pct FROM (SELECT CASE GROUPING_ID(outcome, origin_agent, source)
    WHEN 3 THEN 'outcome' WHEN 5 THEN 'origin_agent' WHEN 6 THEN 'source' ELSE 'total' END AS dim, coalesce(outcome, origin_agent, source, 'all') AS name, count(*) AS n, count(*) FILTER (outcome_ = 'folded') AS f
    FROM (SELECT outcome, outcome AS outcome_, origin_agent, coalesce(source, '(direct)') AS source FROM v_write_log WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY)
    GROUP BY GROUPING SETS ((outcome), (origin_agent), (source), ()))""")
def write_log_stats(t: Tables) -> DataFrame:
    return ops.write_log_stats(t.write_log, AS_OF, 10)


@query("""SELECT source, count(*) AS seen, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'folded') AS folded FROM v_write_log GROUP BY 1""")
def ingest_result(t: Tables) -> DataFrame:
    return ops.ingest_result(t.write_log)


@query("""SELECT resulting_memory_id AS memory_id, seq, coalesce(source, 'direct:' || origin_agent || ':' || user_id) AS source FROM v_write_log WHERE outcome = 'folded'""")
def memory_sources(t: Tables) -> DataFrame:
    return ops.memory_sources(t.write_log)


@query("SELECT id, question FROM v_memories WHERE id LIKE 'mem-12%' ORDER BY id LIMIT 1")
def resolve_id(t: Tables) -> DataFrame:
    return rt.resolve_id(t.memories, "id", "mem-12").select("id", "question")


@query("""SELECT position, '## ' || position || '. ' || question || chr(10) || chr(10) || '_Originally answered ' || strftime(created_at, '%Y-%m-%d %H:%M') || ' via ' || origin_agent
    || ' (recall_hits=' || recall_hits || ')_' || chr(10) || chr(10) || (CASE WHEN length(answer) > 1500 THEN substr(answer, 1, 1500) || chr(10) || '…[truncated]' ELSE answer END)
    || chr(10) || chr(10) || '---' || chr(10) AS section FROM (SELECT *, row_number() OVER (ORDER BY recall_hits DESC, created_at DESC, id) AS position FROM v_memories) WHERE position <= 20""")
def context_bundle(t: Tables) -> DataFrame:
    return tr.context_bundle(t.memories)


@query("""SELECT id, team_id, recall_hits FROM v_memories WHERE NOT (origin_session_id = 's7' OR original_session_id = 's7')""")
def delete_session(t: Tables) -> DataFrame:
    kept, _ = tb.delete_session(t.memories, "s7")
    return kept.select("id", "team_id", "recall_hits")


@query("SELECT count(*) AS removed FROM v_memories WHERE repo_key = 'repo0'")
def delete_count(t: Tables) -> DataFrame:
    return tb.delete_where(t.memories, F.col("repo_key") == "repo0")[1]


@query("""SELECT id, repo_key FROM v_memories WHERE id NOT IN (SELECT resulting_memory_id FROM v_write_log WHERE outcome = 'folded')""")
def delete_ids(t: Tables) -> DataFrame:
    gone = t.write_log.where(F.col("outcome") == "folded").select(F.col("resulting_memory_id").alias("id"))
    return tb.delete_ids(t.memories, gone, "id").select("id", "repo_key")


@query("""SELECT c.repo_key, c.caller, c.callee, c.line FROM v_every_call c WHERE c.caller IN (SELECT qualified_name FROM v_nodes WHERE repo_key <> 'repo3')""")
def detach_edges(t: Tables) -> DataFrame:
    left, _ = tb.delete_where(t.call_nodes, F.col("repo_key") == "repo3")
    return tb.detach(t.every_call, left, "caller", "qualified_name").select("repo_key", "caller", "callee", "line")


@query("""SELECT service, team, is_stub, seq FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY is_stub, CASE WHEN is_stub THEN batch ELSE -batch END, seq DESC) AS n FROM (
    SELECT 'u' || user_id AS service, event_type AS team, event_id AS seq, k % 2 = 0 AS is_stub, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS batch FROM v_events)) WHERE n = 1""")
def upsert(t: Tables) -> DataFrame:
    rows = t.events.select(
        text("=u", "user_id").alias("service"), F.col("event_type").alias("team"),
        F.col("event_id").alias("seq"), (F.col("k") % 2 == 0).alias("is_stub"),
    )
    even = rows.where(F.col("seq") % 2 == 0)
    # an existing table holds one row per key: the first load merges the even rows alone
    first = tb.upsert(even.limit(0), even, ["service"], "seq", "is_stub")
    return tb.upsert(first, rows.where(F.col("seq") % 2 == 1), ["service"], "seq", "is_stub")


REMEMBER_SQL = """WITH RECURSIVE near AS (SELECT query_id AS i, list(id) AS js FROM v_sims WHERE id < query_id AND sim >= 0.3 GROUP BY 1),
    walk AS (SELECT CAST(-1 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS leaders UNION ALL
    SELECT w.i + 1, CASE WHEN n.js IS NOT NULL AND list_has_any(n.js, w.leaders) THEN w.leaders ELSE list_append(w.leaders, w.i + 1) END
    FROM walk w LEFT JOIN near n ON n.i = w.i + 1 WHERE w.i < (SELECT max(id) FROM v_vectors)),
    leaders AS (SELECT unnest(leaders) AS id FROM walk WHERE i = (SELECT max(id) FROM v_vectors))
    SELECT v.id AS seq, CASE WHEN l.id IS NULL THEN 'folded' ELSE 'inserted' END AS outcome, round(s.sim, 6) AS nearest_similarity, s.id AS nearest_seq FROM v_vectors v LEFT JOIN leaders l ON l.id = v.id
    LEFT JOIN (SELECT * FROM (SELECT query_id, s.id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, s.id) AS r FROM v_sims s JOIN leaders USING (id)
    WHERE s.id < query_id AND sim >= 0) WHERE r = 1) s ON s.query_id = v.id"""


def incoming_vectors(t: Tables) -> DataFrame:
    return t.vectors.select(F.col("id").alias("seq"), "repo_key", F.col("qualified_name").alias("question"), "vector")


@query(REMEMBER_SQL)
def remember_batch(t: Tables) -> DataFrame:
    """All vectors remembered in order of their id into an empty memory, threshold 0.3."""
    incoming = incoming_vectors(t)
    empty = incoming.limit(0).select(F.lit("").alias("id"), "repo_key", "vector")
    log = ops.remember_batch(empty, incoming, 0.3).write_log
    ids = log.where(F.col("outcome") == "inserted").select(
        F.col("resulting_memory_id").alias("nearest_existing_id"), F.col("seq").alias("nearest_seq")
    )
    return log.join(ids, "nearest_existing_id", "left").select(
        "seq", "outcome", *six("nearest_similarity"), "nearest_seq"
    )


@query()
def remember_documents(t: Tables) -> DataFrame:
    """All documents as questions, embedded by feature hashing; copies and near copies fold."""
    incoming = spread(t.raw("documents")).select(
        F.col("doc_id").alias("seq"), F.col("lang").alias("repo_key"), F.col("text").alias("question"),
        hash_embedding(F.col("text")).alias("vector"),
    )
    empty = incoming.limit(0).select(F.lit("").alias("id"), "repo_key", "vector")
    log = ops.remember_outcomes(empty, incoming)
    return log.groupBy("repo_key", "outcome").agg(F.count(F.lit(1)).alias("writes"))


INTO_STORE = """WITH s AS (SELECT id, repo_key, CASE WHEN n % 17 > 0 THEN vector END AS vector, recall_hits FROM v_memories),
    q AS (SELECT n, repo_key, CASE WHEN n % 19 > 0 THEN list_transform(list_zip(vector, list_reverse(vector)), lambda p: p[1] + (n % 4 * 0.25)::DOUBLE * p[2]) END AS v,
    CASE WHEN n % 3 > 0 THEN 'src' || (n % 3) ELSE 'direct:' || origin_agent || ':' || user_id END AS source FROM v_memories),
    hit AS (SELECT * FROM (SELECT q.n, q.source, s.id, row_number() OVER (PARTITION BY q.n ORDER BY round(list_cosine_similarity(q.v, s.vector), 9) DESC, s.id) AS r,
    round(list_cosine_similarity(q.v, s.vector), 9) AS sim FROM q JOIN s ON s.repo_key = q.repo_key AND s.vector IS NOT NULL AND q.v IS NOT NULL) WHERE r = 1 AND sim >= 0.95),
    fresh AS (SELECT * FROM q WHERE n NOT IN (SELECT n FROM hit)),
    folds AS (SELECT id AS memory, batch, n, source FROM hit, (SELECT unnest([0, 1]) AS batch) UNION ALL SELECT 'new-' || n, 1, n, source FROM fresh WHERE v IS NOT NULL),
    told AS (SELECT memory, count(*) AS hits, string_agg(source, ';' ORDER BY batch, n) AS sources FROM folds GROUP BY 1),
    stored AS (SELECT id AS memory, recall_hits FROM s UNION ALL SELECT 'new-' || n, 0 FROM fresh UNION ALL SELECT 'new-' || (n + 1000000), 0 FROM fresh WHERE v IS NULL)
    SELECT memory, recall_hits + coalesce(hits, 0) AS recall_hits, coalesce(sources, '') AS sources FROM stored LEFT JOIN told USING (memory)"""


@query(INTO_STORE)
def remember_into_store(t: Tables) -> DataFrame:
    """All memories asked again, twice, into a store that holds them; then compacted and read back."""
    store = scratch_path(t.spark, "memory-store")
    n = F.substring("id", 5, 12).cast("bigint")
    held = t.memories.select("id", "repo_key", "question", F.when(n % 17 > 0, F.col("vector").cast("array<double>")).alias("vector"), "recall_hits")
    memory_store.create_store(held, store)
    again = asked_again(t).select(F.col("query_id").alias("id"), F.col("vector").alias("asked"))
    asked = t.memories.join(again, "id").select(
        n.alias("seq"), "repo_key", "question", F.when(n % 19 > 0, F.col("asked")).alias("vector"),
        F.when(n % 3 > 0, text("=src", n % 3)).alias("source"), "origin_agent", "user_id",
    )
    for batch, shift in ((0, 0), (1, 1_000_000)):
        memory_store.remember_into_store(asked.withColumn("seq", F.col("seq") + shift), store, batch)
    memory_store.compact(t.spark, store)
    log = t.spark.read.parquet(f"{store}/write_log").where("outcome = 'inserted'")
    names = log.select(F.col("resulting_memory_id").alias("id"), text("=new-", "seq").alias("new"))
    told = (
        memory_store.read_sources(t.spark, store).groupBy(F.col("memory_id").alias("id"))
        .agg(F.sort_array(F.collect_list(F.struct("batch", "seq", "source"))).alias("s"))
    )
    kept = memory_store.read_store(t.spark, store).join(names, "id", "left").join(told, "id", "left")
    return kept.select(
        F.coalesce("new", "id").alias("memory"), "recall_hits",
        F.coalesce(F.array_join("s.source", ";"), F.lit("")).alias("sources"),
    )


def replies_of(t: Tables) -> DataFrame:
    claim = lambda n: F.struct(
        text(f"=claim {n} of ", "o_orderkey").alias("claim"),
        (F.col("o_custkey") % (n + 2) != 0).alias("supported"),
        F.when(F.col("o_orderkey") % 2 == 0, text("=a.py:", "o_custkey")).otherwise("null").alias("citation"),
    )
    blank = F.struct(F.lit(" ").alias("claim"), F.lit(True).alias("supported"), F.lit("x").alias("citation"))
    body = F.to_json(F.struct(F.array(claim(0), blank, claim(1), claim(2)).alias("claims")))
    form = F.col("o_orderkey") % 4
    reply = (
        F.when(form == 0, body)
        .when(form == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\n")))
        .when(form == 2, F.concat(F.lit("The result is "), body, F.lit(" as asked.")))
        .otherwise("cannot tell")
    )
    return t.raw("orders").select(
        F.col("o_orderkey").alias("query_id"), reply.alias("reply"), "o_orderstatus",
        F.when(F.col("o_orderstatus") == "P", " ").otherwise("answer").alias("answer"),
        F.when(F.col("o_custkey") % 10 == 3, 0).otherwise(5).alias("n_candidates"),
        (F.col("o_totalprice") / 500000).alias("score"),
    )


CLAIMS_SQL = """SELECT o_orderkey AS query_id, p AS position, 'claim ' || p || ' of ' || o_orderkey AS claim, o_custkey % (p + 2) <> 0 AS supported,
    CASE WHEN o_orderkey % 2 = 0 THEN 'a.py:' || o_custkey END AS citation FROM orders, (SELECT unnest([0, 1, 2]) AS p) WHERE o_orderkey % 4 <> 3"""
VERIFIED_SQL = f"""SELECT o_orderkey AS query_id, CASE WHEN o_orderstatus = 'P' THEN 'empty answer' WHEN o_custkey % 10 = 3 THEN 'no candidates to verify against' END AS skip_reason,
    o_totalprice / 500000 AS score, CASE WHEN o_orderstatus = 'P' OR o_custkey % 10 = 3 THEN 0 ELSE coalesce(n, 0) END AS n_claims,
    CASE WHEN o_orderstatus = 'P' OR o_custkey % 10 = 3 THEN 0 ELSE coalesce(bad, 0) END AS unsupported_count
    FROM orders LEFT JOIN (SELECT query_id, count(*) AS n, count(*) FILTER (NOT supported) AS bad FROM ({CLAIMS_SQL}) GROUP BY 1) c ON c.query_id = o_orderkey"""


@query(CLAIMS_SQL)
def claim_table(t: Tables) -> DataFrame:
    return re_.claim_table(replies_of(t)).drop("reason")


@query(f"SELECT query_id, skip_reason, n_claims, unsupported_count FROM ({VERIFIED_SQL})")
def verifier_result(t: Tables) -> DataFrame:
    return re_.verifier_result(replies_of(t)).select(
        "query_id", "skip_reason", F.size("claims").cast("bigint").alias("n_claims"),
        F.col("unsupported_count").cast("bigint").alias("unsupported_count"),
    )


@query(f"""SELECT query_id, round(least(1, greatest(0, score * greatest(0.2::DOUBLE, 1 - 0.3::DOUBLE * unsupported_count))), 4) AS score, unsupported_count, 'verifier checked ' || n_claims || ' claims' AS checked,
    CASE WHEN unsupported_count > 0 THEN 'verifier flagged ' || unsupported_count || ' unsupported claim(s) - confidence x ' || printf('%.2f', greatest(0.2, 1 - 0.3 * unsupported_count))
    ELSE 'all claims supported by cited evidence' END AS verdict FROM ({VERIFIED_SQL})""")
def verified_confidence(t: Tables) -> DataFrame:
    replies = replies_of(t)
    confidence = replies.select(
        "query_id", "score", F.lit(3).alias("evidence_count"), F.col("score").alias("retrieval_strength"),
        F.lit(0.0).alias("causal_confidence"), F.array(F.lit("top")).alias("derivation"),
    )
    out = re_.verified_confidence(confidence, re_.verifier_result(replies))
    return out.select(
        "query_id", F.round("score", 4).alias("score"), F.col("unsupported_count").cast("bigint").alias("unsupported_count"),
        F.col("derivation")[1].alias("checked"), F.col("derivation")[2].alias("verdict"),
    )
