"""DuckDB SQL that the queries must equal, where SQL can express them."""

from __future__ import annotations

from .license_index import WORDINGS

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

#: Weights 1, 2, 3 in turn, at most three times a source; whole copies, then the order sample up to the word budget.
_MIX = """
sized AS (SELECT {columns}, source, coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))) AS row_key, CAST({words} AS BIGINT) AS size FROM {table}),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) FILTER (WHERE size > 0) AS n FROM sized GROUP BY source),
weighted AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM totals),
filled AS (SELECT *, cap / w AS ratio, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
solved AS (SELECT level FROM filled WHERE level <= ratio ORDER BY ratio, source ASC NULLS LAST LIMIT 1),
goal AS (SELECT source, source_size, n, least(cap, coalesce((SELECT level FROM solved) * w, cap)) AS target FROM filled),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS copies, CAST(source_size AS DOUBLE) / greatest(n, 1) AS mean FROM goal),
budgeted AS (SELECT *, CASE WHEN copies < 3 THEN target - copies * source_size ELSE 0.0 END AS budget FROM plan),
drawn AS (SELECT s.*, b.source_size, b.target, b.copies, b.budget, (CAST(('0x' || substr(md5('mix:' || row_key), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
  least(CASE WHEN b.source_size > 0 THEN b.budget / b.source_size ELSE 0.0 END * least(greatest(size / b.mean, 0.5::DOUBLE), 2.0::DOUBLE), 0.999::DOUBLE) AS p FROM sized s JOIN budgeted b ON s.source IS NOT DISTINCT FROM b.source),
ranked AS (SELECT *, CASE WHEN size > 0 AND budget > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM drawn),
lined AS (SELECT *, coalesce(sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q ASC NULLS LAST, row_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM ranked),
mixed AS (SELECT *, CASE WHEN size > 0 THEN copies + CASE WHEN q IS NOT NULL AND line + size / 2.0::DOUBLE <= budget THEN 1 ELSE 0 END ELSE 0 END AS taken_copies FROM lined)
"""

ORACLE: dict[str, str] = {
    "op6_pareto_mixing": "WITH " + _MIX.format(columns="doc_id", words=_WORDS, table="documents") + "SELECT doc_id, size, source_size, target, CAST(taken_copies * size AS BIGINT) AS taken FROM mixed",
}

#: Every two places with one line, along their diagonals: stretches of such pairs of 50 words at least; the later place of each pair goes.
_LINES = r"""
raw AS (SELECT doc_id, text, unnest(str_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS idx FROM {table}),
l AS MATERIALIZED (SELECT doc_id, idx, line, w, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS pos FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM raw) WHERE w > 0),
pair AS (SELECT a.doc_id AS d, a.pos AS p, b.doc_id AS e, a.pos - b.pos AS diagonal, a.w FROM l a JOIN l b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.pos < a.pos))),
stretch AS (SELECT *, p - row_number() OVER (PARTITION BY d, e, diagonal ORDER BY p) AS island FROM pair),
span AS (SELECT DISTINCT d, lo, hi FROM (SELECT d, e, diagonal, island, min(p) AS lo, max(p) AS hi FROM stretch GROUP BY ALL HAVING sum(w) >= 50)),
gone AS (SELECT DISTINCT l.doc_id, l.idx FROM span JOIN l ON l.doc_id = span.d AND l.pos BETWEEN span.lo AND span.hi),
left_over AS (SELECT r.doc_id, coalesce(string_agg(r.line, chr(10) ORDER BY r.idx) FILTER (WHERE g.idx IS NULL), '') AS text_kept, count(g.idx) AS lines_gone FROM raw r LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.idx = r.idx GROUP BY r.doc_id)
"""
ORACLE["op3_line_dedup"] = "WITH " + _LINES.format(table="documents") + r"SELECT doc_id, lines_gone, text_kept, lines_gone > 0 AND NOT regexp_matches(text_kept, '[^\x20\x09-\x0D]') AS emptied FROM left_over"

#: Conversations with one opening in couples, others against a foreign reply; the common prefix is looked for turn by turn.
ORACLE["op7_preference_format"] = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
head AS (SELECT conv_id, arg_min(role || chr(31) || text, i) AS opening, count(*) AS n FROM t GROUP BY conv_id),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY opening ORDER BY conv_id) + 1) // 2 AS couple FROM head),
couples AS (SELECT opening, couple, count(*) AS c, min(conv_id) AS a, max(conv_id) AS b, arg_min(n, conv_id) AS na, arg_max(n, conv_id) AS nb FROM numbered GROUP BY opening, couple),
reply AS (SELECT conv_id, max(i) AS i, arg_max(text, i) AS text FROM t WHERE role = 'assistant' GROUP BY conv_id),
foreigner AS (SELECT conv_id, i, coalesce(lead(conv_id) OVER (ORDER BY conv_id DESC), max(conv_id) OVER ()) AS other FROM reply),
pair AS (SELECT CASE WHEN na >= nb THEN a ELSE b END AS x, CASE WHEN na >= nb THEN b ELSE a END AS y, CAST(NULL AS BIGINT) AS upto FROM couples WHERE c = 2
  UNION ALL SELECT conv_id, other, i FROM foreigner JOIN couples ON c = 1 AND a = conv_id),
chosen AS (SELECT x, y, t.i, role, text FROM pair JOIN t ON conv_id = x WHERE upto IS NULL OR t.i <= upto),
rejected AS (SELECT x, y, t.i, role, text FROM pair JOIN t ON conv_id = y WHERE upto IS NULL
  UNION ALL SELECT x, y, t.i, role, text FROM pair JOIN t ON conv_id = x WHERE t.i < upto
  UNION ALL SELECT x, y, upto, 'assistant', reply.text FROM pair JOIN reply ON conv_id = y WHERE upto IS NOT NULL),
prefix AS (SELECT x, y, coalesce(min(i) FILTER (WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text) - 1, count(*)) AS n FROM chosen c FULL JOIN rejected r USING (x, y, i) GROUP BY x, y),
c AS (SELECT x, y, n, coalesce(string_agg(turn, '' ORDER BY i) FILTER (WHERE i <= n), '') AS prompt, coalesce(string_agg(turn, '' ORDER BY i) FILTER (WHERE i > n), '') AS said, coalesce(string_agg(mask, ',' ORDER BY i) FILTER (WHERE i > n), '') AS mask
  FROM (SELECT *, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS turn, (length(role) + 5) || ':0,' || (length(text) + 9) || CASE role WHEN 'assistant' THEN ':1' ELSE ':0' END AS mask FROM chosen) JOIN prefix USING (x, y) GROUP BY x, y, n),
r AS (SELECT x, y, coalesce(string_agg(turn, '' ORDER BY i) FILTER (WHERE i > n), '') AS said, coalesce(string_agg(mask, ',' ORDER BY i) FILTER (WHERE i > n), '') AS mask
  FROM (SELECT *, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS turn, (length(role) + 5) || ':0,' || (length(text) + 9) || CASE role WHEN 'assistant' THEN ':1' ELSE ':0' END AS mask FROM rejected) JOIN prefix USING (x, y) GROUP BY x, y)
SELECT x AS chosen_id, y AS rejected_id, n AS n_common, prompt, c.said AS chosen, r.said AS rejected, c.mask AS chosen_mask, r.mask AS rejected_mask FROM c JOIN r USING (x, y)
"""

#: All pairs of documents that share a shingle, by size of intersection and union; components by the closure of their links.
ORACLE["op4_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s),
t AS MATERIALIZED (SELECT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(s) AS x FROM s)),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS node, a AS root FROM edge UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.node WHERE e.b > r.root)
SELECT n.doc_id, n.n AS n_shingles, coalesce(least(min(r.root), n.doc_id), n.doc_id) AS component_id FROM n LEFT JOIN reach r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""

#: Flags of every document, every order of the filters against each part's flags, and the sums over all orders.
ORACLE["op12_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flag AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM d),
known AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
cell AS MATERIALIZED (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic FROM flag LEFT JOIN known USING (doc_id) GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x) JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM orders, range(1, 6) r(step)),
met AS (SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS has, before <> '' AND regexp_matches(fails, '[' || before || '.]') AS gone FROM cell, steps),
told AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT has AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE has AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (WHERE has AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE fails = own), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE has AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE has AND NOT gone), 0) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM told
"""


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)


def _license_sql() -> str:
    """Every word of every document at its place; beginnings by counting looked-up words, keys and scores by joins with the words in place."""
    wording = [(t, x.label, x.base, x.rare, x.least, x.slack) for t, x in enumerate(WORDINGS)]
    word = [(t, q, w) for t, x in enumerate(WORDINGS) for q, w in enumerate(x.words)]
    key = [(t, k, f" {x.text} ".split(f" {phrase} ")[0].count(" ") + i, i, w) for t, x in enumerate(WORDINGS) for k, phrase in enumerate(x.keys or (x.text,)) for i, w in enumerate(phrase.split())]
    return rf"""
WITH wording(t, label, base, rare, least, slack) AS ({_values(wording)}), word(t, q, w) AS ({_values(word)}), key(t, k, q, i, w) AS ({_values(key)}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
tok AS MATERIALIZED (SELECT r, w, p FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM d) WHERE w IN (SELECT w FROM word)),
df AS (SELECT w, count(DISTINCT r) AS n FROM tok GROUP BY w),
idf AS (SELECT w, n, round(ln(((SELECT count(*) FROM d) + 1) / (coalesce(n, 0) + 1)::DOUBLE), 6) AS idf FROM (SELECT DISTINCT w FROM word) LEFT JOIN df USING (w)),
live AS (SELECT t FROM key LEFT JOIN df USING (w) GROUP BY t HAVING count(*) = count(n)),
asked AS (SELECT t, q, w FROM (SELECT t, q, w, row_number() OVER (PARTITION BY t ORDER BY idf DESC, q) AS i FROM word JOIN live USING (t) JOIN idf USING (w) WHERE n > 0) JOIN wording USING (t) WHERE i <= rare),
begins AS (SELECT r, t, p - q AS s FROM tok JOIN asked USING (w) JOIN wording USING (t) GROUP BY r, t, s, least HAVING count(*) >= least),
held AS (SELECT r, b.t, s, k, shift FROM begins b JOIN wording USING (t) JOIN range(-100, 101) g(shift) ON abs(shift) <= slack JOIN key ON key.t = b.t JOIN tok USING (r, w) WHERE p = s + key.q + shift GROUP BY r, b.t, s, k, shift HAVING count(*) = (SELECT count(*) FROM key y WHERE y.t = b.t AND y.k = any_value(key.k))),
verified AS (SELECT r, t, s FROM held GROUP BY r, t, s HAVING count(DISTINCT k) = (SELECT count(DISTINCT k) FROM key y WHERE y.t = held.t)),
inside AS (SELECT v.r, v.t, s, sum(idf) AS matched FROM verified v JOIN word ON word.t = v.t JOIN tok ON tok.r = v.r AND tok.w = word.w AND p = s + q JOIN idf ON idf.w = word.w GROUP BY ALL),
place AS (SELECT r, label, base, s, CASE WHEN whole > 0 THEN round(matched / whole, 6) WHEN base THEN 1.0 ELSE 0.0 END AS score FROM inside JOIN wording USING (t) JOIN (SELECT t, sum(idf) AS whole FROM word JOIN idf USING (w) GROUP BY t) USING (t))
SELECT doc_id, CAST(any_value(len(ws)) AS BIGINT) AS n_words, count(*) FILTER (WHERE base) AS n_base, CAST(min(s) FILTER (WHERE base) AS BIGINT) AS first_word, CAST(max(s) FILTER (WHERE base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, CAST(coalesce(max(score), 0.0) AS DOUBLE) AS score FROM d LEFT JOIN place USING (r) GROUP BY r, doc_id
"""


ORACLE["op11_license_index"] = _license_sql()


def _means_sql(clusters: int, rounds: int) -> str:
    """Every distance in every round."""
    steps = []
    for i in range(rounds + 1):
        apart = "list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, v, nearest.d AS distance, nearest.k AS k FROM (SELECT vec_id, any_value(v) AS v, min(struct_pack(d := {apart}, k := k)) AS nearest FROM v, c{i} GROUP BY vec_id))")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT k, list(f ORDER BY place) AS c FROM (SELECT k, place, (s - ((s % n) + n) % n) // n AS f FROM (SELECT k, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i}) GROUP BY k, place)) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))""")
    fit = "len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE)))"
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE {fit}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h LIMIT {clusters})),
{", ".join(steps)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)
"""


ORACLE["op13_drake_means"] = _means_sql(16, 3)
