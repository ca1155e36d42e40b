"""Chunkers over conversations as documents: a section a turn, a paragraph a line. SQL packs by recursion, a piece a step."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunk
from .catalog import query
from .queries import table


def documents(spark, sf_dir) -> DataFrame:
    """(doc_id, text, sections) of conversations; the text is that of its sections with blank lines between."""
    c = table(spark, sf_dir, "conversations").withColumn("content", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    section = F.struct(F.col("role").alias("title"), "content", F.lit(1).alias("level"), F.col("turn").cast("int").alias("position"))
    rows = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", section.alias("s")))).alias("x"))
    return rows.select("doc_id", F.array_join(F.transform("x", lambda x: x["s"]["content"]), "\n\n").alias("text"), F.transform("x", lambda x: x["s"]).alias("sections"))


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def _sentences(x: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all({x}, '[^。！？；.!?;\n]*[。！？；.!?;\n]|[^。！？；.!?;\n]+$'), lambda s: {_trim('s')}), lambda s: s <> '')"


def _paragraphs(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({x}, '\n\n+'), lambda s: {_trim('s')}), lambda s: s <> '')"


def _pieces(name: str, source: str, keys: str, pieces: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT {keys}, unnest(x) AS piece, generate_subscripts(x, 1) AS i FROM (SELECT {keys}, {pieces} AS x FROM {source}))"


def _after(n: int, ends: str) -> str:
    """What a chunk leaves for the next one: behind the last sentence end in the second half of its last n characters, else all of them."""
    last, at = f"right(done, {n})", f"length(regexp_extract(right(done, {n}), '(?s)^(.*[{ends}])', 1)) - 1"
    return f"CASE WHEN {at} > {n // 2} THEN {_trim(f'substr({last}, {at} + 2)')} ELSE {_trim(last)} END"


def _pack(name: str, pieces: str, keys: tuple[str, ...], most: int, joint: str = "''", overlap: str = "''") -> str:
    k, same = ", ".join(keys), " AND ".join(f"r.{x} = p.{x}" for x in keys)
    kept = ", ".join(f"r.{x}" for x in keys)
    full = f"length(r.cur) > 0 AND length(r.cur) + length(p.piece) > {most}"
    step = f"SELECT {kept}, p.i, p.piece, r.cur, {full} AS full_, {_trim('r.cur')} AS done, r.k FROM {name}_r r JOIN {pieces} p ON {same} AND p.i = r.i + 1"
    return f"""{name}_r AS (SELECT DISTINCT {k}, 0::BIGINT AS i, '' AS cur, 0::BIGINT AS k, NULL::VARCHAR AS out FROM {pieces}
  UNION ALL SELECT {k}, i, CASE WHEN full_ THEN {overlap} ELSE cur END || piece || {joint}, CASE WHEN full_ THEN k + 1 ELSE k END, CASE WHEN full_ THEN done END FROM ({step})),
{name} AS MATERIALIZED (SELECT {k}, k - 1 AS k, out AS content FROM {name}_r WHERE out IS NOT NULL
  UNION ALL SELECT {k}, k, {_trim('cur')} FROM (SELECT *, max(i) OVER (PARTITION BY {k}) AS top FROM {name}_r) WHERE i = top AND {_trim('cur')} <> '')"""


_SECTIONS = "sec AS MATERIALIZED (SELECT conv_id AS doc_id, turn, role AS title, replace(text, chr(10), chr(10) || chr(10)) AS content FROM conversations)"
_TEXTS = "txt AS MATERIALIZED (SELECT doc_id, string_agg(content, chr(10) || chr(10) ORDER BY turn) AS text FROM sec GROUP BY doc_id)"
_BREAK = "chr(10) || chr(10)"


def _rows(name: str, f, sql: str) -> None:
    query(name, "WITH RECURSIVE " + _SECTIONS + ", " + _TEXTS + ", " + sql)(lambda spark, sf_dir: chunk.chunked(documents(spark, sf_dir), f, sections_col="sections"))


_rows(
    "chunk_semantic",
    lambda t, s, n: chunk.semantic(t, s, n, 200, 40),
    f"""{_pieces('p', "(SELECT * FROM sec WHERE length(content) > 200)", 'doc_id, turn', _sentences('content'))}, {_pack('packed', 'p', ('doc_id', 'turn'), 200, overlap=_after(40, '。！？.!?'))},
parts AS (SELECT doc_id, turn, 0 AS k, content FROM sec WHERE length(content) <= 200 AND {_trim('content')} <> '' UNION ALL SELECT * FROM packed),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, k) - 1 AS chunk_index FROM parts)
SELECT doc_id, doc_id || '_chunk_' || chunk_index AS chunk_id, n.content, chunk_index, count(*) OVER (PARTITION BY doc_id, turn) AS total_chunks, title, 'chunk' AS level, CAST(NULL AS VARCHAR) AS parent_id FROM n JOIN sec USING (doc_id, turn)""",
)
_rows(
    "chunk_parent_child",
    lambda t, s, n: chunk.parent_child(t, n, 200, 50, 15),
    f"""{_pieces('p', "(SELECT * FROM txt WHERE length(text) > 400)", 'doc_id', _paragraphs('text'))}, {_pack('packed', 'p', ('doc_id',), 400, _BREAK)},
parent AS MATERIALIZED (SELECT doc_id, k, content FROM packed UNION ALL SELECT doc_id, 0, {_trim('text')} FROM txt WHERE length(text) <= 400 AND {_trim('text')} <> ''),
{_pieces('c', "(SELECT * FROM parent WHERE length(content) > 100)", 'doc_id, k AS pk', _sentences('content'))}, {_pack('kids', 'c', ('doc_id', 'pk'), 100, overlap="right(done, 15)")},
child AS (SELECT doc_id, pk, k, content FROM kids UNION ALL SELECT doc_id, k, 0, content FROM parent WHERE length(content) <= 100),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pk, k) - 1 AS i FROM child)
SELECT doc_id, doc_id || '_parent_' || k AS chunk_id, content, k AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, CAST(NULL AS VARCHAR) AS title, 'parent' AS level, CAST(NULL AS VARCHAR) AS parent_id FROM parent
UNION ALL SELECT doc_id, doc_id || '_child_' || i, content, i, count(*) OVER (PARTITION BY doc_id), NULL, 'child', doc_id || '_parent_' || pk FROM n""".replace("SELECT doc_id, k AS pk, unnest(x)", "SELECT doc_id, pk, unnest(x)"),
)
_rows(
    "chunk_multi",
    lambda t, s, n: chunk.multi(t, s, n, 300, 150, 100),
    f"""{_pieces('para', 'sec', 'doc_id, turn', _paragraphs('content'))}, {_pack('one', 'para', ('doc_id', 'turn'), 300, _BREAK)},
{_pieces('within', "(SELECT doc_id, turn, i AS j, piece AS content FROM para WHERE length(piece) > 150)", 'doc_id, turn, j', _sentences('content'))}, {_pack('two', 'within', ('doc_id', 'turn', 'j'), 150)},
{_pieces('sent', 'sec', 'doc_id, turn', _sentences('content'))}, {_pack('three', 'sent', ('doc_id', 'turn'), 100)},
every AS (SELECT doc_id, 'section' AS level, turn, 0 AS j, k, content FROM one UNION ALL SELECT doc_id, 'paragraph', turn, j, k, content FROM two UNION ALL SELECT doc_id, 'paragraph', turn, i, 0, piece FROM para WHERE length(piece) <= 150 UNION ALL SELECT doc_id, 'sentence', turn, 0, k, content FROM three),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, level ORDER BY turn, j, k) - 1 AS i FROM every)
SELECT doc_id, doc_id || '_' || level || '_' || i AS chunk_id, content, i AS chunk_index, count(*) OVER (PARTITION BY doc_id, level) AS total_chunks, CAST(NULL AS VARCHAR) AS title, level, CAST(NULL AS VARCHAR) AS parent_id FROM n""",
)
_rows(
    "chunk_legacy",
    lambda t, s, n: chunk.legacy(t, n, 300, 40),
    f"""{_pieces('p', 'txt', 'doc_id', _paragraphs('text'))}, {_pack('packed', 'p', ('doc_id',), 300, _BREAK, _after(40, '。？！'))}
SELECT doc_id, doc_id || '_chunk_' || k AS chunk_id, content, k AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, CAST(NULL AS VARCHAR) AS title, 'chunk' AS level, CAST(NULL AS VARCHAR) AS parent_id FROM packed""",
)
_rows(
    "chunk_summary",
    lambda t, s, n: chunk.summary_index(t, s, n, 200, 60),
    f"""{_pieces('p', "(SELECT * FROM sec WHERE length(content) > 200)", 'doc_id, turn', _paragraphs('content'))}, {_pack('packed', 'p', ('doc_id', 'turn'), 200, _BREAK)},
parts AS (SELECT doc_id, turn, 0 AS k, content FROM sec WHERE length(content) <= 200 AND {_trim('content')} <> '' UNION ALL SELECT * FROM packed),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, k) - 1 AS i FROM parts)
SELECT doc_id, doc_id || '_chunk_' || i || '_summary' AS chunk_id, CASE WHEN length(content) > 60 THEN left(content, 60) || '...' ELSE content END AS content, i AS chunk_index, CAST(NULL AS BIGINT) AS total_chunks, content AS title, 'summary' AS level, doc_id || '_chunk_' || i AS parent_id FROM n""",
)
# stands for a model that answers all but the last of each request
_rows(
    "chunk_contextual",
    lambda t, s, n: chunk.contextual(t, s, n, 2, lambda text, part: [f"about {len(c)} of {len(text)}" for c in part[:-1]]),
    f"""n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS c FROM sec WHERE {_trim('content')} <> '')
SELECT doc_id, doc_id || '_chunk_' || i || '_ctx' AS chunk_id, CASE WHEN i % 2 = 0 AND i + 1 < c THEN 'about ' || length(content) || ' of ' || length(text) ELSE '' END || chr(10) || content AS content, i AS chunk_index, c AS total_chunks, title, 'chunk' AS level, CAST(NULL AS VARCHAR) AS parent_id FROM n JOIN txt USING (doc_id)""",
)


def _model(part: str) -> str | None:
    """Stands for a model: sentences as a JSON list, and no answer to every third length."""
    return None if len(part) % 3 == 0 else "said: " + json.dumps(part.split(". "))


_rows(
    "chunk_propositions",
    lambda t, s, n: chunk.propositions(t, n, 300, 80, _model),
    f"""seg AS (SELECT doc_id, text, 0::BIGINT AS pos, 0::BIGINT AS i, NULL::VARCHAR AS part FROM txt WHERE {_trim('text')} <> ''
  UNION ALL SELECT doc_id, text, stop, i + 1, substr(text, pos + 1, stop - pos) FROM (SELECT doc_id, text, pos, i, CASE WHEN length(text) <= 300 OR pos + 300 >= length(text) THEN length(text) WHEN last > pos + 150 THEN last + 1 ELSE pos + 300 END AS stop
    FROM (SELECT *, length(regexp_extract(substr(text, 1, pos + 301), '(?s)^(.*[。\n])', 1)) - 1 AS last FROM seg WHERE pos < length(text)))),
items AS (SELECT doc_id, i, unnest(x) AS content, generate_subscripts(x, 1) AS j FROM (SELECT doc_id, i, CASE WHEN length(part) % 3 = 0 THEN [part] ELSE list_filter(list_transform(str_split(part, '. '), lambda s: {_trim('s')}), lambda s: s <> '' AND length(s) <= 80) END AS x FROM seg WHERE i > 0)),
n AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS k FROM items)
SELECT doc_id, doc_id || '_prop_' || k AS chunk_id, content, k AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, CAST(NULL AS VARCHAR) AS title, 'prop' AS level, CAST(NULL AS VARCHAR) AS parent_id FROM n""",
)
