"""SQL counterparts, for DuckDB, of the corpus queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {}

SQL["op4_decontamination"] = f"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
tests AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
        FROM bw WHERE len(w) > 0)),
places AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM dw, (SELECT DISTINCT size FROM tests) WHERE len(w) >= size)),
found AS (SELECT r, i, size, item_id FROM places JOIN tests USING (size, s)),
hit AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM found)) GROUP BY r),
names AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, cast(item_id AS VARCHAR) AS item FROM found) GROUP BY r)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN names USING (r)
"""

_BUCKET = "((v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0))"

SQL["op6_quality_rules"] = f"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5)),
twice AS (SELECT r, s FROM win GROUP BY r, s HAVING count(*) > 1),
repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest(range(i, i + 5)) AS p FROM win JOIN twice USING (r, s)) GROUP BY r),
lines AS (
  SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM dw),
base AS (
  SELECT r, doc_id, coalesce('+' || lang, '-') || chr(31) || coalesce('+' || source, '-') AS key,
         coalesce('+' || lang, '-') AS key_lang,
         cast(len(w) AS BIGINT) AS n_words, cast(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         cast(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         cast(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, cast(len(l) AS BIGINT) AS n_lines
  FROM dw JOIN lines USING (r) LEFT JOIN repeated USING (r)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
metrics AS (
  SELECT r, key, key_lang, base_failed, 'word_length' AS metric, word_chars * 100 // n_words AS v, 10 AS narrow
  FROM judged WHERE n_words > 0
  UNION ALL SELECT r, key, key_lang, base_failed, 'symbols', n_symbols * 1000 // n_words, 10
  FROM judged WHERE n_words > 0
  UNION ALL SELECT r, key, key_lang, base_failed, 'dup_lines', n_dup_lines * 1000 // n_lines, 40
  FROM judged WHERE n_words > 0 AND n_lines > 0
  UNION ALL SELECT r, key, key_lang, base_failed, 'repeats', n_repeat_words * 1000 // n_words, 10
  FROM judged WHERE n_words > 0),
sketch AS (
  SELECT level, spot, metric, bucket, count(*) AS n FROM (
    SELECT 0 AS level, key AS spot, metric, {_BUCKET} AS bucket FROM metrics WHERE NOT base_failed
    UNION ALL SELECT 1, key_lang, metric, {_BUCKET} FROM metrics WHERE NOT base_failed
    UNION ALL SELECT 2, '*', metric, {_BUCKET} FROM metrics WHERE NOT base_failed)
  GROUP BY level, spot, metric, bucket),
tails AS (
  SELECT level, spot, metric, max(total) AS total, min(CASE WHEN 100 * seen >= 5 * total THEN bucket END) AS lo,
         min(CASE WHEN 100 * seen >= 50 * total THEN bucket END) AS mid,
         min(CASE WHEN 100 * seen >= 95 * total THEN bucket END) AS hi
  FROM (SELECT *, sum(n) OVER (PARTITION BY level, spot, metric ORDER BY bucket) AS seen,
               sum(n) OVER (PARTITION BY level, spot, metric) AS total FROM sketch)
  GROUP BY level, spot, metric),
chosen AS (
  SELECT m.r, m.v, m.narrow, coalesce(a.lo, b.lo, c.lo) AS lo, coalesce(a.mid, b.mid, c.mid) AS mid,
         coalesce(a.hi, b.hi, c.hi) AS hi
  FROM metrics m
  LEFT JOIN tails a ON a.level = 0 AND a.spot = m.key AND a.metric = m.metric AND a.total >= 200
  LEFT JOIN tails b ON b.level = 1 AND b.spot = m.key_lang AND b.metric = m.metric AND b.total >= 200
  LEFT JOIN tails c ON c.level = 2 AND c.metric = m.metric),
outside AS (
  SELECT DISTINCT r FROM chosen
  WHERE v < lo - 4 * greatest(mid - lo, narrow) OR v > hi + 4 * greatest(hi - mid, narrow))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND o.r IS NULL AS kept
FROM judged j LEFT JOIN outside o ON o.r = j.r
"""

SQL["op7_near_duplicates"] = f"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM dw WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.s = y.s
    AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * shared >= 80 * (sa.n + sb.n - shared)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM dw UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT dw.doc_id, coalesce(n, 0) AS n_shingles, least(dw.doc_id, c) AS component_id, c = dw.doc_id AS kept
FROM dw LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = dw.doc_id
"""


def mixing_sql(entropy: float) -> str:
    """The mix of ``documents`` whose entropy is at least this share of the highest possible."""
    return f"""
WITH dw AS (
  SELECT doc_id, source, coalesce('+' || source, '-') AS key, coalesce(cast(doc_id AS VARCHAR), '-') AS id,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS t FROM documents),
d AS (SELECT *, substr(md5(id), 1, 3) AS block FROM dw),
totals AS (SELECT key, sum(t) AS tokens, sum(t) / (SELECT sum(t) FROM d) AS share FROM d GROUP BY key HAVING sum(t) > 0),
powers AS (
  SELECT i, key, tokens, share, round(share ** (i / 1024.0) * 1099511627776.0)::HUGEINT AS p,
         round(share ** (i / 1024.0) * ln(share) * 1099511627776.0)::HUGEINT AS q FROM totals, range(0, 1025) g(i)),
steps AS (
  SELECT i, ln(sum(p) / 1099511627776.0) - (i / 1024.0) * (sum(q) / 1099511627776.0) / (sum(p) / 1099511627776.0) AS h,
         max(share ** (i / 1024.0) / share) / (sum(p) / 1099511627776.0) AS most, count(*) AS n
  FROM powers GROUP BY i),
chosen AS (
  SELECT greatest((SELECT coalesce(max(i), 0) FROM steps WHERE h >= {entropy} * ln(n) - 1e-9),
                  (SELECT coalesce(min(i), 1024) FROM steps WHERE most <= 4.0 + 1e-9)) AS i),
weights AS (
  SELECT key, tokens, CASE WHEN i = 1024 THEN tokens::HUGEINT ELSE p END AS part FROM powers JOIN chosen USING (i)),
budgets AS (
  SELECT key, tokens, part::DOUBLE / (SELECT sum(part) FROM weights)::DOUBLE AS weight,
         cast(part * (SELECT sum(t) FROM d)::HUGEINT // (SELECT sum(part)::HUGEINT FROM weights) AS BIGINT) AS budget
  FROM weights),
plan AS (SELECT key, weight, budget // tokens AS epochs, budget % tokens AS rest FROM budgets),
blocks AS (
  SELECT key, block, spot, tokens, sum(tokens) OVER (PARTITION BY key ORDER BY spot, block) AS upto, rest FROM (
    SELECT d.key, block, md5(d.key || '|' || block || '|' || epochs) AS spot, sum(t) AS tokens, any_value(rest) AS rest
    FROM d JOIN plan USING (key) GROUP BY ALL)),
edge AS (
  SELECT key, spot AS edge_at, block, rest - upto + tokens AS room FROM blocks WHERE upto > rest
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY spot, block) = 1),
inside AS (
  SELECT key, h, sum(t) OVER (PARTITION BY key ORDER BY h) AS upto, room FROM (
    SELECT d.key, md5(id || '|' || epochs) AS h, t, room FROM d JOIN edge USING (key, block) JOIN plan USING (key))),
last AS (SELECT key, max(h) AS edge_doc FROM inside WHERE upto <= room GROUP BY key),
uses AS (
  SELECT d.*, weight, CASE WHEN epochs IS NULL THEN 1 ELSE epochs + CASE
      WHEN md5(d.key || '|' || d.block || '|' || epochs) < edge_at THEN 1
      WHEN md5(d.key || '|' || d.block || '|' || epochs) = edge_at
           AND md5(id || '|' || epochs) <= coalesce(edge_doc, '') THEN 1 ELSE 0 END END AS copies
  FROM d LEFT JOIN plan USING (key) LEFT JOIN edge ON edge.key = d.key LEFT JOIN last ON last.key = d.key)
SELECT doc_id, source, t AS n_tokens, epoch, round(weight, 6) AS weight,
       substr(md5(key || '|' || block || '|' || epoch), 1, 8) || substr(md5(id || '|' || epoch), 1, 8) AS place
FROM (SELECT *, unnest(range(0, cast(copies AS BIGINT))) AS epoch FROM uses)
"""


SQL["op10_mixing"] = mixing_sql(0.998)

SQL["op13_fill_in_middle"] = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         sha256('1:' || coalesce(cast(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w, cast('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
         cast('0x' || substr(h, 9, 8) AS BIGINT) AS h2, cast('0x' || substr(h, 17, 8) AS BIGINT) AS h3,
         cast('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, cast(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS lo,
         greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS hi,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, array_to_string(w[1:lo], '') AS prefix, array_to_string(w[lo + 1:hi], '') AS middle,
         array_to_string(w[hi + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN cast(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN cast(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def clustering_sql(k: int = 16, rounds: int = 3) -> str:
    """Clusters of ``embeddings`` by comparing every vector with every centroid."""
    steps = [f"""
kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = 64),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS m FROM kept WHERE vec_id IS NOT NULL
  ORDER BY sha256('1:' || vec_id), v LIMIT {k})"""]
    for t in range(rounds + 1):
        steps.append(f"""
far{t} AS (
  SELECT r, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
  FROM kept, c{t}),
near{t} AS (SELECT r, min(struct_pack(d := d, c := c)) AS b FROM far{t} GROUP BY r)""")
        if t < rounds:
            steps.append(f"""
new{t} AS (
  SELECT c, list(cast(floor_of AS BIGINT) ORDER BY i) AS m FROM (
    SELECT b.c AS c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_of
    FROM near{t} JOIN (SELECT r, unnest(v) AS x, unnest(range(1, 65)) AS i FROM kept) USING (r) GROUP BY 1, 2) GROUP BY c),
c{t + 1} AS (SELECT c, coalesce(new{t}.m, c{t}.m) AS m FROM c{t} LEFT JOIN new{t} USING (c))""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, cast(b.c AS INTEGER) AS cluster, b.d AS distance,
       cast(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, cast(sum(b.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM near{rounds} JOIN kept USING (r) JOIN c{rounds} ON c = b.c
"""


SQL["op11_centroids"] = clustering_sql()

SQL["op12_ngram_join"] = f"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM dw WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.s = y.s
    AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * shared >= 80 * (sa.n + sb.n - shared)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM dw UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT dw.doc_id, coalesce(n, 0) AS n_shingles, least(dw.doc_id, c) AS component_id
FROM dw LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = dw.doc_id
"""
