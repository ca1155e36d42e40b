"""Further operators as registered queries over the driver's tables, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import budget, evaluate, graph, index, ingest, logs, memory, postings, retrieve, search, upload
from ..operators.tables import new_path
from ..sources import documents as sources
from ..sources import monitoring
from ..streaming.uploads import current_status, start_uploads
from .catalog import query
from .queries import _BM25, _VEC, EACH, K, NOW, _keyword, _keyword_alone, _query_vectors, _store, _vector, table

_TRIM = r"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"

# Files and parsers

_NAMES = ("a.txt", "b.MD", "c.html", "d.pdf", "e.docx", "f.xlsx", "g.exe", "h")
_MIMES = ("text/plain; charset=utf-8", "TEXT/MARKDOWN", None, "application/pdf", "image/png")


def _files(spark, sf_dir) -> DataFrame:
    """Documents as files whose names and types follow from the id."""
    d = table(spark, sf_dir, "documents")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % n + 1).cast("int"))
    content = F.when(F.col("doc_id") % 50 == 0, F.lit(b"")).otherwise(F.coalesce("text", F.lit("")).cast("binary"))
    return d.select("doc_id", "source", pick(_NAMES, len(_NAMES)).alias("file_name"), pick(_MIMES, len(_MIMES)).alias("mime_type"), content.alias("content"))


_SQL_FILES = "files AS (SELECT doc_id, source, CASE WHEN doc_id % 50 = 0 THEN '' ELSE coalesce(text, '') END AS content, ([" + ", ".join(f"'{x}'" for x in _NAMES) + f"])[doc_id % {len(_NAMES)} + 1] AS file_name, ([" + ", ".join("NULL" if x is None else f"'{x}'" for x in _MIMES) + f"])[doc_id % {len(_MIMES)} + 1] AS mime_type FROM documents)"
_EXT = r"lower(regexp_extract(file_name, '\.([^.]*)$', 1))"


@query("parser_dispatch", f"WITH {_SQL_FILES}, m AS (SELECT *, {_EXT} AS ext, lower(coalesce(mime_type, '')) AS m FROM files) SELECT doc_id, CASE WHEN contains(m, 'markdown') OR ext IN ('md', 'markdown', 'mdown', 'mkd') THEN 'markdown' WHEN contains(m, 'html') OR ext IN ('html', 'htm') THEN 'html' WHEN contains(m, 'pdf') OR ext = 'pdf' THEN 'pdf' WHEN ext = 'docx' THEN 'docx' WHEN ext = 'xlsx' THEN 'xlsx' WHEN ext IN ('doc', 'xls') THEN 'binary' ELSE 'txt' END AS parser FROM m")
def parser_dispatch(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", sources.parser_of(F.col("file_name"), F.col("mime_type")).alias("parser"))


@query("upload_validation", f"WITH {_SQL_FILES} SELECT doc_id, CASE WHEN content = '' THEN 'empty' WHEN {_EXT} NOT IN ({', '.join(repr(e) for e in ingest.EXTENSIONS)}) THEN 'extension' WHEN trim(split_part(lower(coalesce(mime_type, '')), ';', 1)) NOT IN ('', {', '.join(repr(e) for e in ingest.MIME_TYPES)}) THEN 'mime type' END AS reject_reason FROM files")
def upload_validation(spark, sf_dir):
    return ingest.validated(_files(spark, sf_dir)).select("doc_id", "reject_reason")


@query("file_extension", f"WITH {_SQL_FILES} SELECT doc_id, {_EXT} AS extension FROM files")
def file_extension(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", T.extension(F.col("file_name")).alias("extension"))


@query("txt_sections", r"""SELECT doc_id, i - 1 AS position, p AS content FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '\n\n+'), lambda x: regexp_replace(x, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), lambda x: x <> '') AS ps FROM documents))""")
def txt_sections(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    files = d.select("doc_id", F.lit("a.log").alias("file_name"), F.lit(None).cast("string").alias("mime_type"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return sources.parsed(files).select("doc_id", F.explode("sections").alias("s")).select("doc_id", F.col("s.position").cast("long").alias("position"), "s.content")


@query("markdown_sections", rf"""SELECT conv_id, turn AS position, role AS title, 2 AS level, {_TRIM.format(x="'## ' || role || chr(10) || regexp_replace(text, '(^|\n)#+', '\\1', 'g')")} AS content FROM conversations""")
def markdown_sections(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("## "), "role", F.lit("\n"), F.regexp_replace("text", r"(^|\n)#+", "$1"))
    rows = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n").alias("t"), F.array_sort(F.collect_list("turn")).alias("turns"))
    files = rows.select("doc_id", "turns", F.lit("a.md").alias("file_name"), F.lit(None).cast("string").alias("mime_type"), F.col("t").cast("binary").alias("content"))
    got = sources.parsed(files).select(F.col("doc_id").alias("conv_id"), "turns", F.explode("sections").alias("s"))
    return got.select("conv_id", F.get("turns", F.col("s.position")).alias("position"), "s.title", "s.level", "s.content")


@query("paged_sections", r"SELECT conv_id, turn AS position, '第 ' || (turn + 1) || ' 页' AS title, regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS content FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, text FROM conversations)")
def paged_sections(spark, sf_dir):
    import pandas as pd

    c = table(spark, sf_dir, "conversations")
    rows = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\f").alias("t"))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([{"conv_id": i, "position": s["position"], "title": s["title"], "content": s["content"]} for i, t in zip(pdf["conv_id"], pdf["t"], strict=True) for s in sources.parse_pdf_text(t)["sections"]], columns=["conv_id", "position", "title", "content"])

    return rows.mapInPandas(run, "conv_id long, position long, title string, content string")


# Uploads


def _one_vector(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count(" "))] for t in texts]


def _chunker(t, s, n):
    from ..operators import chunk

    return chunk.semantic(t, [], n, 400, 0)


@query("upload_status", f"""WITH {_SQL_FILES}, v AS (SELECT doc_id, source, content, CASE WHEN content = '' THEN 'empty' WHEN {_EXT} NOT IN ({', '.join(repr(e) for e in ingest.EXTENSIONS)}) THEN 'extension' WHEN trim(split_part(lower(coalesce(mime_type, '')), ';', 1)) NOT IN ('', {', '.join(repr(e) for e in ingest.MIME_TYPES)}) THEN 'mime type' END AS reason, CASE WHEN {_EXT} IN ('docx', 'xlsx') THEN 'office' WHEN NOT contains(lower(coalesce(mime_type, '')), 'markdown') AND ({_EXT} = 'pdf' OR contains(lower(coalesce(mime_type, '')), 'pdf')) AND {_EXT} NOT IN ('md', 'html') THEN 'pdf' ELSE 'text' END AS kind, lower(coalesce(mime_type, '')) AS m FROM files),
d AS (SELECT *, row_number() OVER (PARTITION BY sha256(content), source ORDER BY doc_id) > 1 AS duplicate FROM v)
SELECT doc_id, CASE WHEN reason IS NOT NULL OR duplicate THEN 'rejected' WHEN contains(m, 'markdown') THEN 'parsed' WHEN kind = 'text' THEN 'parsed' ELSE 'failed' END AS status, CASE WHEN reason IS NOT NULL THEN reason WHEN duplicate THEN 'duplicate' END AS message FROM d""")
def upload_status(spark, sf_dir):
    out = upload.upload(_files(spark, sf_dir), None, _chunker, _one_vector, ("source",))["status"]
    # a parsed file is a success, or a warning with its reason
    parsed = F.col("status").isin(upload.SUCCESS, upload.WARNING)
    return out.select("doc_id", F.when(parsed, "parsed").otherwise(F.col("status")).alias("status"), F.when(F.col("status") == upload.REJECTED, F.col("message")).alias("message"))


@query("upload_stream", r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER (PARTITION BY coalesce(text, ''), coalesce(source, '') ORDER BY doc_id) > 1 AS copy FROM documents),
n AS (SELECT *, length(regexp_replace(t, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) AS n FROM d)
SELECT doc_id, CASE WHEN t = '' OR copy THEN 'rejected' WHEN n = 0 THEN 'warning' WHEN contains(t, 'ß') THEN 'failed' ELSE 'success' END AS status, CASE WHEN t = '' THEN 'empty' WHEN copy THEN 'duplicate' WHEN n = 0 THEN 'empty' WHEN contains(t, 'ß') THEN 'no vector' END AS message FROM n""")
def upload_stream(spark, sf_dir):
    """documents as a stream of uploads with a status each; texts with a certain letter get no vector."""
    store = new_path(spark, "uploads")

    def embed(texts):
        if any("ß" in t for t in texts):
            raise RuntimeError("no vector")
        return [[float(len(t))] for t in texts]

    d = table(spark, sf_dir, "documents")
    rows = spark.readStream.schema(d.schema).parquet(f"{sf_dir}/documents.parquet*")
    files = rows.select("doc_id", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.lit(None).cast("string").alias("mime_type"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    start_uploads(files, f"{store}/store", f"{store}/checkpoint", _chunker, embed, ("source",)).awaitTermination()
    return current_status(spark, f"{store}/store").select("doc_id", "status", "message")


@query("document_status", r"SELECT doc_id, CASE WHEN n < 20 THEN 'warning' ELSE 'success' END AS status, CASE WHEN n < 20 THEN 0 ELSE 1 END AS chunk_count FROM (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) AS n FROM documents)")
def document_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ingest.document_status(d, d.where(F.length(T.trimmed(F.col("text"))) >= 20)).select("doc_id", "status", F.col("chunk_count").cast("int").alias("chunk_count"))


@query("document_deleted", "SELECT doc_id FROM documents WHERE NOT (doc_id = 5 AND lang = (SELECT lang FROM documents WHERE doc_id = 5))")
def document_deleted(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lang = d.where("doc_id = 5").select("lang").first()
    return ingest.without_document(d, 5, scope={"lang": lang.lang if lang else None}).select("doc_id")


@query("chunk_enrichment", "SELECT c.conv_id, turn, lang, source FROM conversations c JOIN documents d ON d.doc_id = c.conv_id")
def chunk_enrichment(spark, sf_dir):
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn")
    return ingest.enriched(chunks, table(spark, sf_dir, "documents"), columns=("lang", "source")).select(F.col("doc_id").alias("conv_id"), "turn", "lang", "source")


@query("batch_embedding", r"SELECT conv_id, turn, CASE WHEN regexp_replace(text, '\s+', '', 'g') = '' THEN [] ELSE [length(text)::FLOAT, (length(text) - length(replace(text, ' ', '')))::FLOAT] END AS embedding FROM conversations")
def batch_embedding(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("content"))
    return ingest.embedded(rows, _one_vector).select("conv_id", "turn", "embedding")


@query("embedding_cache", "SELECT count(*) AS asked, count(*) FILTER (WHERE text IN (SELECT text FROM documents WHERE doc_id % 2 = 0)) AS hits, round(count(*) FILTER (WHERE text IN (SELECT text FROM documents WHERE doc_id % 2 = 0)) / count(*)::DOUBLE, 6) AS rate FROM documents")
def embedding_cache(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    empty = spark.createDataFrame([], "key string, embedding array<float>")
    _, cache, _ = upload.embedded_by_cache(rows.where("doc_id % 2 = 0"), empty, "m", _one_vector)
    return upload.embedded_by_cache(rows, cache, "m", _one_vector)[2]


@query("provider_failures", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'QUOTA' WHEN event_id % 6 = 1 THEN 'RATE_LIMITED' WHEN event_id % 6 IN (2, 3) THEN 'AUTH' WHEN event_id % 6 = 4 THEN 'PROVIDER' ELSE 'UNKNOWN' END AS kind FROM events")
def provider_failures(spark, sf_dir):
    status = F.element_at(F.array(*[F.lit(x) for x in (429, 429, 401, 403, 503, 404)]), (F.col("event_id") % 6 + 1).cast("int"))
    body = F.when(F.col("event_id") % 6 == 0, "Quota exceeded").otherwise("no")
    return table(spark, sf_dir, "events").select("event_id", evaluate.failure_kind(status, body).alias("kind"))


# Retrieval


@query("keyword_index", r"SELECT doc_id AS id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents)) GROUP BY doc_id, term")
def keyword_index(spark, sf_dir):
    return index.keyword_index(table(spark, sf_dir, "documents")).where("term is not null").select("id", "term", "tf", "dl")


@query("index_search", f"WITH {_BM25} SELECT query_id, id, score, rank FROM bm")
def index_search(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").where(F.col("item_id") % EACH == 0).select(F.col("item_id").alias("query_id"), "text")
    return index.index_search(index.keyword_index(table(spark, sf_dir, "documents")), asked, K)


@query("index_upsert_count", "SELECT count(*) - count(*) FILTER (WHERE doc_id % 7 = 0) AS documents FROM documents")
def index_upsert_count(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    built = index.index_added(index.keyword_index(d), d.where("doc_id % 3 = 0"))
    return index.index_count(index.index_removed(built, d.where("doc_id % 7 = 0").select(F.col("doc_id").alias("id"))))


@query("stored_metadata", "SELECT doc_id, lang, source, CAST(NULL AS VARCHAR) AS hidden FROM documents")
def stored_metadata(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    m = index.stored_metadata(F.create_map(F.lit("lang"), "lang", F.lit("_source"), "source", F.lit("_x"), F.lit("y")))
    return d.select("doc_id", m.alias("m")).select("doc_id", F.try_element_at("m", F.lit("lang")).alias("lang"), F.try_element_at("m", F.lit("source")).alias("source"), F.try_element_at("m", F.lit("_x")).alias("hidden"))


@query("fuzzy_terms", r"WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]+')) AS term FROM part), q AS (SELECT p_partkey AS query_id, substr(lower(regexp_extract(p_name, '[\p{L}\p{N}_]+')), 2) AS asked FROM part WHERE p_partkey % 20 = 0) SELECT DISTINCT query_id, asked, term FROM q JOIN v ON damerau_levenshtein(asked, term) <= CASE WHEN length(asked) <= 2 THEN 0 WHEN length(asked) <= 5 THEN 1 ELSE 2 END WHERE asked <> ''")
def fuzzy_terms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = p.select(F.explode(retrieve.analysed(F.col("p_name"))).alias("term"))
    # the first word of a name without its first letter
    q = p.where(F.col("p_partkey") % EACH == 0).select(F.col("p_partkey").alias("query_id"), F.substring(F.lower(F.regexp_extract("p_name", r"[\p{L}\p{N}_]+", 0)), 2, 1000).alias("text"))
    return retrieve.fuzzy_terms(q, words)


@query("reranked", f"WITH {_VEC} SELECT query_id, id, score, rank FROM (SELECT query_id, id, -score AS score, row_number() OVER (PARTITION BY query_id ORDER BY -score DESC, rank) - 1 AS rank FROM l2) WHERE rank < 4")
def reranked(spark, sf_dir):
    return retrieve.rerank(_vector(spark, sf_dir, "l2"), 4, lambda d: d.withColumn("new_score", -F.col("score"))).select("query_id", "id", "score", "rank")


@query("search_traces", f"WITH {_BM25} SELECT query_id, count(*) AS retrieval_topk, string_agg(id || ':' || left(coalesce(text, ''), 200), '|' ORDER BY rank) AS sources, 'hybrid' AS retrieval_type FROM bm JOIN documents ON doc_id = id GROUP BY query_id")
def search_traces(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    got = search.searched_with_trace(_keyword(spark, sf_dir), texts, "t", "u", F.current_timestamp())
    return got.select("query_id", "retrieval_topk", F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["id"], F.coalesce(s["snippet"], F.lit("")))), "|").alias("sources"), "retrieval_type")


_FUSED = """lists AS (SELECT query_id, 0 AS path, rank, id, score FROM l2 UNION ALL SELECT query_id, 1, rank, id, score FROM bm),
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS score, min(struct_pack(path := path, rank := rank)) AS seen, any_value(score ORDER BY path) AS own_score, any_value(rank ORDER BY path) AS own_rank FROM lists GROUP BY query_id, id),
several AS (SELECT query_id, count(DISTINCT path) > 1 AS s FROM lists GROUP BY 1),
hits AS (SELECT query_id, id, CASE WHEN s THEN score ELSE own_score END AS score, CASE WHEN s THEN rank ELSE own_rank END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) - 1 AS rank FROM fused) JOIN several USING (query_id) WHERE CASE WHEN s THEN rank ELSE own_rank END < 10)"""


@query("composed_search", f"WITH {_VEC}, {_BM25}, {_FUSED}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS r, count(*) OVER (PARTITION BY query_id) AS n FROM hits) SELECT query_id, id, score, rank, CASE WHEN least(n, 6) <= 2 THEN r WHEN r % 2 = 0 THEN r // 2 ELSE least(n, 6) - 1 - (r - 1) // 2 END AS position FROM best WHERE r < 6")
def composed_search(spark, sf_dir):
    return _composed(spark, sf_dir)[0].select("query_id", "id", "score", "rank", "position")


def _composed(spark, sf_dir):
    """A search over two paths that work, one that fails when it is planned and one whose rows fail."""
    asked = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("query_id"), F.lit("text").alias("text"))

    def broken(q):
        raise RuntimeError("a path that fails")

    def failing(q):
        return q.select("query_id", F.lit(1).cast("long").alias("id"), F.raise_error(F.lit("a row that fails")).cast("double").alias("score"), F.lit(0).cast("long").alias("rank"))

    paths = {"vector": lambda q: _vector(spark, sf_dir, "l2"), "keyword": lambda q: _keyword_alone(spark, sf_dir), "broken": broken, "failing": failing}
    return search.searched(asked, paths, 6, fused_k=10)


@query("composed_stages", f"""WITH {_VEC}, {_BM25}, {_FUSED}, n AS (SELECT query_id, count(*) AS n FROM hits GROUP BY query_id)
SELECT 'rewrite' AS stage, (SELECT count(*) FROM q) AS hits, CAST(NULL AS VARCHAR) AS error UNION ALL SELECT 'vector', (SELECT count(*) FROM l2), NULL UNION ALL SELECT 'keyword', (SELECT count(*) FROM bm), NULL UNION ALL SELECT 'broken', 0, 'a path that fails'
UNION ALL SELECT 'failing', 0, 'a row that fails' UNION ALL SELECT 'retrieve', (SELECT CAST(sum(CASE WHEN s THEN n ELSE least(n, 6) END) AS BIGINT) FROM n JOIN several USING (query_id)), NULL UNION ALL SELECT 'rerank', (SELECT CAST(sum(least(n, 6)) AS BIGINT) FROM n), NULL UNION ALL SELECT 'order', (SELECT CAST(sum(least(n, 6)) AS BIGINT) FROM n), NULL""")
def composed_stages(spark, sf_dir):
    said = F.regexp_extract("error", "a (path|row) that fails", 0)
    return _composed(spark, sf_dir)[1].select("stage", "hits", said.alias("error"))


@query("detailed_search", f"WITH {_VEC}, {_BM25}, {_FUSED} SELECT query_id, 'vector' AS path, id, score, rank FROM l2 UNION ALL SELECT query_id, 'keyword', id, score, rank FROM bm UNION ALL SELECT query_id, 'fused', id, score, rank FROM hits")
def detailed_search(spark, sf_dir):
    return search.detailed({"vector": _vector(spark, sf_dir, "l2"), "keyword": _keyword_alone(spark, sf_dir)}, K)


@query("batch_search", f"""WITH {_BM25.replace(f"WHERE item_id % {EACH} = 0", "WHERE item_id IN (SELECT item_id FROM benchmark ORDER BY item_id LIMIT 10) AND item_id % 4 = 0")}
SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN (SELECT count(*) FROM bm WHERE query_id = item_id) ELSE 0 END AS hits, CASE item_id % 4 WHEN 1 THEN 'blank query' WHEN 2 THEN 'odd query' WHEN 3 THEN 'a row that fails' END AS error FROM benchmark ORDER BY item_id LIMIT 10""")
def batch_search(spark, sf_dir):
    """Keyword searches of a batch, of which some are blank, some fail when they are planned and some while they run."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 4 == 1, " ").otherwise(F.col("text")).alias("text"))
    # before the batch, whose queries run side by side
    index = postings.stored_postings(spark, f"{sf_dir}/documents.parquet")

    def keyword(one):
        asked = one.first()
        if asked is not None and asked.query_id % 4 == 2:
            raise ValueError("odd query")
        found = postings.whole_search(index, one, K)
        return found if asked is None or asked.query_id % 4 == 0 else found.withColumn("score", F.raise_error(F.lit("a row that fails")).cast("double"))

    outcomes = search.batch_search(items, keyword, seconds=None)[1]
    return outcomes.select("query_id", "hits", F.regexp_extract("error", "blank query|odd query|a row that fails", 0).alias("error"))


@query("rewritten_queries", "SELECT item_id AS query_id, text AS asked, CASE WHEN length(text) % 2 = 0 THEN text ELSE 'about ' || length(text) END AS text FROM benchmark")
def rewritten_queries(spark, sf_dir):
    def model(t: str) -> str | None:
        if len(t) % 4 == 0:
            raise RuntimeError("no answer")
        return None if len(t) % 2 == 0 else f" about {len(t)} "

    return search.rewritten(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), model).select("query_id", "asked", "text")


# Knowledge graph


def _parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))


@query("entities_by_name", "SELECT p_partkey AS entity_id FROM part WHERE contains(p_name, 'a')")
def entities_by_name(spark, sf_dir):
    return graph.by_name(_parts(spark, sf_dir), "a").select("entity_id")


@query("entities_by_type", "SELECT p_partkey AS entity_id FROM part WHERE p_type = (SELECT min(p_type) FROM part) ORDER BY p_partkey LIMIT 5")
def entities_by_type(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return graph.by_type(p, p.agg(F.min("type")).first()[0], 5).select("entity_id")


@query("text_matches", r"WITH q AS (SELECT p_partkey AS query_id, regexp_extract(p_name, '\S+') || ' ' || p_partkey AS text FROM part WHERE p_partkey % 20 = 0), w AS (SELECT query_id, text AS word, 0 AS pl FROM q UNION ALL SELECT query_id, x, i FROM (SELECT query_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT query_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: length(t) > 1) AS l FROM q))), h AS (SELECT query_id, p_partkey AS entity_id, min(pl) AS pl FROM w JOIN part ON contains(p_name, word) WHERE word <> '' GROUP BY ALL) SELECT query_id, entity_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pl, entity_id) - 1 AS rank FROM h) WHERE rank < 5")
def text_matches(spark, sf_dir):
    p = _parts(spark, sf_dir)
    q = p.where(F.col("entity_id") % EACH == 0).select(F.col("entity_id").alias("query_id"), F.concat(F.regexp_extract("name", r"\S+", 0), F.lit(" "), F.col("entity_id").cast("string")).alias("text"))
    return graph.text_matches(p, q, 5)


def _nations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.col("n_name").alias("name"), F.lit("nation").alias("type"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("up"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("entity_id"), F.col("r_name").alias("name"), F.lit("region").alias("type"))
    return n.drop("up").unionByName(r), n.select(F.col("entity_id").alias("source_id"), F.col("up").alias("target_id"))


_GRAPH = "ent AS (SELECT 'n' || n_nationkey AS id, n_name AS name, 'nation' AS type FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, 'region' FROM region), e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation)"


@query("graph_search", f"WITH {_GRAPH} SELECT 1 AS query_id, string_agg(name || '(' || type || ')', ', ' ORDER BY id) AS content, 0.5::DOUBLE AS score FROM ent WHERE id = 'r1' OR id IN (SELECT a FROM e WHERE b = 'r1')")
def graph_search(spark, sf_dir):
    entities, edges = _nations(spark, sf_dir)
    return graph.graph_search(entities, edges, spark.createDataFrame([(1, "r1")], "query_id int, entity_id string"))


@query("graph_search_typed", f"WITH {_GRAPH} SELECT 1 AS query_id, string_agg(name || '(' || type || ')', ', ' ORDER BY id) AS content FROM ent WHERE id = 'n1' OR id IN (SELECT b FROM e WHERE a = 'n1')")
def graph_search_typed(spark, sf_dir):
    entities, edges = _nations(spark, sf_dir)
    return graph.graph_search(entities, edges, spark.createDataFrame([(1, "r1"), (1, "n1")], "query_id int, entity_id string"), kind="nation").select("query_id", "content")


@query("graph_counts", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS entities, (SELECT count(*) FROM nation) AS relations")
def graph_counts(spark, sf_dir):
    return graph.counts(*_nations(spark, sf_dir))


@query("subgraph_of_text", f"WITH {_GRAPH}, c AS (SELECT id FROM ent WHERE contains(name, 'IA') ORDER BY id LIMIT 1) SELECT node FROM (SELECT id AS node FROM c UNION SELECT b FROM e JOIN c ON a = id UNION SELECT a FROM e JOIN c ON b = id)")
def subgraph_of_text(spark, sf_dir):
    return graph.subgraph_of_text(*_nations(spark, sf_dir), "IA")[0].select("node")


@query("entity_upsert", "SELECT p_partkey AS entity_id, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part")
def entity_upsert(spark, sf_dir):
    from ..operators import relational

    p = _parts(spark, sf_dir).withColumn("updated_at", F.lit(1))
    return relational.upserted(p, p.where("entity_id % 5 = 0").withColumn("name", F.upper("name")), "entity_id", "updated_at").select("entity_id", "name")


@query("relation_upsert", "SELECT o_orderkey AS relation_id, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 2 ELSE 1 END AS updated_at FROM orders")
def relation_upsert(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("relation_id"), F.col("o_custkey").alias("source_id"), F.col("o_custkey").alias("target_id"), F.lit(1).alias("updated_at"))
    known = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("entity_id"))
    return graph.save_relations(edges, edges.where("relation_id % 3 = 0").withColumn("updated_at", F.lit(2)), known).select("relation_id", "updated_at")


@query("graph_schema", "SELECT 'duplicate id' AS fault, (SELECT count(*) FROM (SELECT label FROM embeddings GROUP BY label HAVING count(*) > 1)) AS n UNION ALL SELECT 'dimension', count(*) FROM embeddings WHERE len(embedding) <> 32")
def graph_schema(spark, sf_dir):
    return graph.schema_faults(table(spark, sf_dir, "embeddings").withColumn("entity_id", F.col("label")), 32)


def _extract(texts: DataFrame) -> DataFrame:
    """Stands for a model: an entity a turn, a relation to the turn's text length, and no answer to system turns."""
    reply = F.concat(F.lit('```json\n{"entities": [{"name": "'), F.col("role"), F.lit('", "type": "ROLE"}, {"name": "c'), (F.col("document_id") % 3).cast("string"), F.lit('", "type": "CONV"}], "relations": [{"source": "'), F.col("role"), F.lit('", "target": "c'), (F.col("document_id") % 3).cast("string"), F.lit('"}, {"source": "nobody", "target": "c0"}]}\n```'))
    return texts.withColumn("reply", F.when(F.col("role") == "system", "none").otherwise(reply))


def _built(spark, sf_dir):
    return graph.build_graph(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "document_id"), _extract, "turn")


@query("graph_build_entities", "SELECT DISTINCT role AS name, 'ROLE' AS type, role || '|ROLE' AS entity_id FROM conversations WHERE role <> 'system' UNION SELECT DISTINCT 'c' || (conv_id % 3), 'CONV', 'c' || (conv_id % 3) || '|CONV' FROM conversations WHERE role <> 'system'")
def graph_build_entities(spark, sf_dir):
    return _built(spark, sf_dir)[0].select("name", "type", "entity_id")


@query("graph_build_job", "SELECT conv_id AS document_id, count(*) AS total, count(*) AS done, (count(*) + 4) // 5 AS batches, CASE WHEN bool_and(role = 'system') THEN 'FAILED' ELSE 'COMPLETED' END AS state FROM conversations GROUP BY 1")
def graph_build_job(spark, sf_dir):
    return _built(spark, sf_dir)[2].select("document_id", "total", F.col("done").cast("long").alias("done"), F.col("batches").cast("long").alias("batches"), "state")


# Memory


def _facts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory_id"), F.coalesce("text", F.lit("")).alias("content"), F.col("lang").alias("tenant_id"), F.when(F.col("doc_id") % 5 == 0, "EPISODE").otherwise("FACT").alias("type"))


@query("memory_unseen", "WITH f AS (SELECT doc_id, coalesce(text, '') AS c, lang FROM documents) SELECT min(doc_id) AS memory_id FROM f WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM f s WHERE s.doc_id % 2 = 0 AND s.c = f.c AND s.lang = f.lang) GROUP BY c, lang")
def memory_unseen(spark, sf_dir):
    f = _facts(spark, sf_dir)
    store = f.where("memory_id % 2 = 0").select(T.digest(F.col("content")).alias("content_hash"), "tenant_id", F.lit(1).alias("status"))
    return memory.unseen(f.where("memory_id % 2 = 1"), store, ["tenant_id"], "memory_id").select("memory_id")


@query("memory_stored", "SELECT doc_id AS memory_id, CASE WHEN doc_id % 5 = 0 THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS importance, 1 AS status, TIMESTAMP '2024-03-02' AS expires_at FROM documents")
def memory_stored(spark, sf_dir):
    return memory.stored(_facts(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), 30).select("memory_id", "importance", "status", "expires_at")


_SIM = "list_cosine_similarity(n.embedding::DOUBLE[], s.embedding::DOUBLE[])"


@query("memory_conflicts", f"WITH p AS (SELECT n.vec_id AS memory_id, s.vec_id AS old_id, {_SIM} AS sim FROM embeddings n JOIN embeddings s ON n.label = s.label WHERE n.vec_id % 20 = 0 AND s.vec_id % 20 <> 0), b AS (SELECT memory_id, arg_max(old_id, struct_pack(sim := sim, o := -old_id)) AS old_id, max(sim) AS sim FROM p GROUP BY memory_id) SELECT vec_id AS memory_id, old_id, CASE WHEN old_id IS NULL THEN 'ADD' ELSE 'UPDATE' END AS action FROM embeddings LEFT JOIN (SELECT * FROM b WHERE sim > 0.4) ON memory_id = vec_id WHERE vec_id % 20 = 0")
def memory_conflicts(spark, sf_dir):
    rows = _store(spark, sf_dir).withColumn("tenant_id", F.col("label")).withColumn("user_id", F.col("label")).withColumn("content", F.lit("c"))
    got = memory.conflicts(rows.where("memory_id % 20 = 0"), rows.where("memory_id % 20 <> 0"), lambda d: d.withColumn("action", F.lit("UPDATE")), 0.3, 0.4)
    return got.select("memory_id", "old_id", "action")


#: What new rows near to a stored one do, by their ids.
_ACTIONS = ("UPDATE", "DELETE", "KEEP", "MERGE")


@query("memory_resolved", f"""WITH p AS (SELECT n.vec_id AS memory_id, s.vec_id AS old_id, {_SIM} AS sim FROM embeddings n JOIN embeddings s ON n.label = s.label WHERE n.vec_id % 20 = 0 AND s.vec_id % 20 <> 0),
b AS (SELECT memory_id, arg_max(old_id, struct_pack(sim := sim, o := -old_id)) AS old_id, max(sim) AS sim FROM p GROUP BY memory_id),
d AS (SELECT vec_id AS memory_id, old_id, CASE WHEN old_id IS NULL THEN 'ADD' ELSE ({list(_ACTIONS)})[vec_id // 20 % 4 + 1] END AS action FROM embeddings LEFT JOIN (SELECT * FROM b WHERE sim > 0.3) ON memory_id = vec_id WHERE vec_id % 20 = 0)
SELECT vec_id AS memory_id, 'm' || coalesce((SELECT max(memory_id) FROM d WHERE action = 'UPDATE' AND old_id = vec_id), vec_id) AS content FROM embeddings WHERE vec_id % 20 <> 0 AND vec_id NOT IN (SELECT old_id FROM d WHERE action = 'DELETE')
UNION ALL SELECT memory_id, 'm' || memory_id FROM d WHERE action NOT IN ('UPDATE', 'KEEP')""")
def memory_resolved(spark, sf_dir):
    rows = _store(spark, sf_dir).withColumn("tenant_id", F.col("label")).withColumn("user_id", F.col("label")).withColumn("content", F.concat(F.lit("m"), F.col("memory_id").cast("string"))).withColumn("content_hash", T.digest(F.col("content")))
    action = F.element_at(F.array(*[F.lit(x) for x in _ACTIONS]), (F.floor(F.col("memory_id") / 20) % 4 + 1).cast("int"))
    old = rows.where("memory_id % 20 <> 0")
    return memory.resolved(old, memory.conflicts(rows.where("memory_id % 20 = 0"), old, lambda d: d.withColumn("action", action), 0.2, 0.3)).select("memory_id", "content")


@query("memory_merged", f"""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.25 AND (a.vec_id + b.vec_id) % 3 <> 0),
one AS (SELECT list_reduce(list_prepend(struct_pack(gone := []::STRUCT(a BIGINT, b BIGINT)[], a := 0::BIGINT, b := 0::BIGINT), list(struct_pack(gone := []::STRUCT(a BIGINT, b BIGINT)[], a := a, b := b) ORDER BY a, b)),
  lambda s, x: struct_pack(gone := CASE WHEN list_contains(list_transform(s.gone, lambda g: g.b), x.a) OR list_contains(list_transform(s.gone, lambda g: g.b), x.b) THEN s.gone ELSE list_append(s.gone, struct_pack(a := x.a, b := x.b)) END, a := x.a, b := x.b)).gone AS gone FROM p),
taken AS (SELECT g.a AS a, g.b AS b FROM (SELECT unnest(gone) AS g FROM one))
SELECT vec_id AS memory_id, CASE WHEN vec_id IN (SELECT b FROM taken) THEN 0 ELSE 1 END AS status, coalesce('both ' || vec_id || ' ' || (SELECT max(b) FROM taken WHERE a = vec_id), 'm' || vec_id) AS content FROM embeddings""")
def memory_merged(spark, sf_dir):
    """Near memories of an owner with a decision for each pair; the SQL visits pairs one after another."""
    rows = _store(spark, sf_dir).withColumn("content", F.concat(F.lit("m"), F.col("memory_id").cast("string"))).withColumn("content_hash", T.digest(F.col("content")))
    rows = rows.withColumn("scope", F.lit("/")).withColumn("expires_at", F.lit(None).cast("timestamp_ntz"))
    decide = lambda d: d.withColumn("merge", (F.col("a") + F.col("b")) % 3 != 0).withColumn("content", F.concat_ws(" ", F.lit("both"), "a", "b"))
    return memory.consolidated(rows, F.lit(NOW).cast("timestamp_ntz"), decide, ("label",), 0.25)[0].select("memory_id", "status", "content")


def _memories(spark, sf_dir) -> DataFrame:
    rows = ingest.hashed(table(spark, sf_dir, "documents"))
    return rows.select(F.col("doc_id").alias("memory_id"), "content_hash", F.col("source").alias("scope"), F.col("lang").alias("tenant_id"), F.col("source").alias("user_id"), F.lit(1).alias("status"), F.col("n_chars").alias("created_at"), F.when(F.col("doc_id") % 6 == 0, F.col("n_chars")).alias("expires_at"))


_DUP = "d AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 6 = 0 THEN n_chars END AS expires_at, CASE WHEN row_number() OVER (PARTITION BY sha256(coalesce(text, '')), source ORDER BY n_chars DESC, doc_id DESC) > 1 THEN 0 ELSE 1 END AS status FROM documents)"


@query("memory_consolidated", f"WITH {_DUP} SELECT doc_id AS memory_id, status FROM d WHERE expires_at IS NULL OR expires_at >= 500")
def memory_consolidated(spark, sf_dir):
    return memory.consolidated(_memories(spark, sf_dir), F.lit(500))[0].select("memory_id", "status")


@query("memory_nightly", f"WITH {_DUP} SELECT count(*) FILTER (WHERE status = 0) AS duplicates, 0::BIGINT AS merged, count(*) FILTER (WHERE expires_at < 500) AS expired, count(DISTINCT lang || ' ' || source) AS owners FROM d")
def memory_nightly(spark, sf_dir):
    return memory.nightly(_memories(spark, sf_dir), F.lit(500))[1]


@query("memory_without_vectors", "WITH n AS (SELECT * FROM documents WHERE lang = 'en' AND source = 'src1' ORDER BY n_chars DESC, doc_id DESC LIMIT 12), s AS (SELECT doc_id, list_cosine_similarity([length(text)::DOUBLE, 100.0::DOUBLE], [5.0::DOUBLE, 100.0::DOUBLE]) AS sem FROM n) SELECT doc_id AS memory_id, round(sem, 6) AS semantic FROM s WHERE sem >= 0.05 ORDER BY sem DESC, doc_id LIMIT 4")
def memory_without_vectors(spark, sf_dir):
    store = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content"), F.col("lang").alias("tenant_id"), F.col("source").alias("user_id"), F.lit("/").alias("scope"), F.lit(1).alias("status"), F.lit(0.5).alias("importance"), F.col("n_chars").alias("created_at"))
    embed = lambda d: d.withColumn("embedding", F.array(F.length("content").cast("double"), F.lit(100.0))).drop("created_at").withColumn("created_at", F.lit(NOW).cast("timestamp_ntz"))
    got = memory.recent_without_vectors(store, "en", "src1", None, F.lit(NOW).cast("timestamp_ntz"), embed, "xxxxx", 4, semantic=0.05, least=0.0)
    return got.select("memory_id", "semantic")


@query("memory_lines", "SELECT vec_id AS query_id, string_agg((r + 1) || '. [' || floor(c * 100 + 0.5)::INT || '%相关] m' || r, chr(10) ORDER BY r) AS lines FROM (SELECT vec_id, unnest(range(3)) AS r, vec_id % 100 / 100.0::DOUBLE AS c FROM embeddings) GROUP BY vec_id")
def memory_lines(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rank"), ((F.col("vec_id") % 100) / 100.0).alias("composite")).withColumn("memory_id", F.col("rank"))
    texts = spark.range(3).select(F.col("id").cast("int").alias("memory_id"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("content"))
    return memory.recalled_lines(e, texts)


@query("parsed_facts", """SELECT event_id, 'a fact of ' || event_type || ' number ' || event_id AS content, CASE WHEN event_id % 2 = 0 THEN 'EPISODE' ELSE 'FACT' END AS type FROM events""")
def parsed_facts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    item = F.concat(F.lit('{"content": "a fact of '), "event_type", F.lit(" number "), F.col("event_id").cast("string"), F.lit('", "type": "'), F.when(F.col("event_id") % 2 == 0, "episode").otherwise("odd"), F.lit('"}'))
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n["), item, F.lit(', {"content": "short"}]\n```'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"facts": ['), item, F.lit("]}"))).otherwise(item)
    return memory.parsed_facts(e.select("event_id", reply.alias("reply"))).select("event_id", "content", "type")


@query("parsed_decisions", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'KEEP' WHEN 2 THEN 'UPDATE' ELSE 'KEEP' END AS action FROM events")
def parsed_decisions(spark, sf_dir):
    reply = F.element_at(F.array(*[F.lit(x) for x in ('{"action": "delete"}', '{"action": "UPDATE", "content": " "}', '{"action": "UPDATE", "content": "new"}', '{"action": "odd"}')]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", memory.parsed_decision(reply)["action"].alias("action"))


@query("parsed_importance", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.5::DOUBLE ELSE event_id % 10 / 10.0::DOUBLE END AS importance FROM events")
def parsed_importance(spark, sf_dir):
    reply = F.when(F.col("event_id") % 3 == 0, "none").otherwise(F.concat(F.lit("about 0."), (F.col("event_id") % 10).cast("string"), F.lit("!")))
    return table(spark, sf_dir, "events").select("event_id", memory.importance_of(reply).alias("importance"))


# Logs and metrics


@query("loki_decode", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS timestamp, event_type AS level, 'unknown' AS source, 'user' || user_id AS service_name, 'event ' || event_id AS message FROM (SELECT *, date_trunc('second', ts) AS t FROM events)".replace("strftime(ts,", "strftime(t,"))
def loki_decode(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    nanos = F.concat(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"), F.lit("000000000"))
    value = F.array(nanos, F.concat(F.lit("event "), F.col("event_id").cast("string")))
    streams = e.groupBy("event_type", "user_id").agg(F.collect_list(value).alias("values"))
    stream = F.create_map(F.lit("level"), "event_type", F.lit("service"), F.concat(F.lit("user"), F.col("user_id").cast("string")))
    replies = streams.select(F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.array(F.struct(stream.alias("stream"), "values")).alias("result")).alias("data"))).alias("body"))
    got = monitoring.loki_rows(replies)
    return got.select(F.regexp_extract("message", r"(\d+)", 1).cast("long").alias("event_id"), "timestamp", "level", "source", "service_name", "message")


@query("prometheus_alerts", "SELECT event_type AS alert_name, 'firing' AS state, 'unknown' AS severity, 'u' || user_id AS service_name, 'value ' || event_id AS description FROM events")
def prometheus_alerts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    labels = F.create_map(F.lit("alertname"), "event_type", F.lit("service"), F.concat(F.lit("u"), F.col("user_id").cast("string")))
    alert = F.struct(labels.alias("labels"), F.create_map(F.lit("description"), F.concat(F.lit("value "), F.col("event_id").cast("string"))).alias("annotations"), F.lit("firing").alias("state"))
    body = F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.array(alert).alias("alerts")).alias("data")))
    return monitoring.prometheus_alerts(e.select(body.alias("body"))).select("alert_name", "state", "severity", "service_name", "description")


@query("prometheus_points", "SELECT 'u' || user_id AS job, event_id::VARCHAR AS timestamp, event_type AS value FROM events")
def prometheus_points(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    point = F.array(F.col("event_id").cast("string"), F.col("event_type"))
    series = e.groupBy("user_id").agg(F.collect_list(point).alias("values")).select(F.struct(F.create_map(F.lit("job"), F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("metric"), "values").alias("r"))
    replies = series.select(F.to_json(F.struct(F.struct(F.lit("matrix").alias("resultType"), F.array("r").alias("result")).alias("data"))).alias("body"))
    return monitoring.prometheus_points(replies).select(F.col("metric")["job"].alias("job"), "timestamp", "value")


@query("log_keywords", "SELECT event_id FROM events WHERE contains(lower(event_type || ' user' || user_id || ' ' || 'region r' || (event_id % 7)), 'click') AND contains(lower(event_type || ' user' || user_id || ' region r' || (event_id % 7)), 'r3')")
def log_keywords(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    meta = F.create_map(F.lit("region"), F.concat(F.lit("region r"), (F.col("event_id") % 7).cast("string")))
    return e.where(logs.has_keywords("CLICK r3", F.col("event_type"), F.concat(F.lit("user"), F.col("user_id").cast("string")), metadata=meta)).select("event_id")


@query("log_topics", "SELECT topic, n FROM (VALUES ('system-metrics', 3), ('application-logs', 3), ('database-slow-query', 2), ('system-events', 3), ('odd', 0)) t(topic, n)")
def log_topics(spark, sf_dir):
    sample, out = monitoring.sample_logs(spark), None
    for topic in (*logs.TOPICS, "odd"):
        one = logs.topic_logs(sample, topic, None, 0).agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(topic).alias("topic"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("log_selectors", """SELECT * FROM (VALUES ('application-logs', '{level=~"ERROR|WARN"} |= "a\\"b"', 100), ('odd', '{job=~".*"}', 7)) t(topic, selector, store_limit)""")
def log_selectors(spark, sf_dir):
    rows = [("application-logs", logs.topic_selector("application-logs", 'a"b'), logs.store_limit(0)), ("odd", logs.topic_selector("odd"), logs.store_limit(7))]
    return spark.createDataFrame(rows, "topic string, selector string, store_limit int")


@query("range_minutes", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 9) * 1440 WHEN 1 THEN (event_id % 9) * 60 WHEN 2 THEN event_id % 9 ELSE 60 END AS minutes FROM events")
def range_minutes(spark, sf_dir):
    unit = F.element_at(F.array(F.lit("d"), F.lit("h"), F.lit("m"), F.lit("x")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", T.range_minutes(F.concat((F.col("event_id") % 9).cast("string"), unit)).cast("long").alias("minutes"))


@query("iso_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 1000 = 0 THEN 'Z' ELSE '.' || lpad((event_id % 1000)::VARCHAR, 3, '0') || 'Z' END AS at FROM events")
def iso_timestamps(spark, sf_dir):
    nanos = F.concat((F.unix_timestamp(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000).cast("string"), F.lit("000123"))
    return table(spark, sf_dir, "events").select("event_id", T.iso_of_nanos(nanos).alias("at"))


# Evaluation, reports and text functions


@query("evaluation_off", "SELECT doc_id, 1.0::DOUBLE AS overall, true AS acceptable FROM labels")
def evaluation_off(spark, sf_dir):
    return evaluate.answer_quality(table(spark, sf_dir, "labels").select("doc_id"), enabled=False)


@query("parsed_scores", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN least(1.0::DOUBLE, event_id % 17 / 10.0::DOUBLE) WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN event_id % 10 / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS score, CASE event_id % 4 WHEN 0 THEN least(1.0::DOUBLE, event_id % 17 / 10.0::DOUBLE) WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN event_id % 10 / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS hallucinated FROM events WHERE event_id % 4 < 3")
def parsed_scores(spark, sf_dir):
    i = F.col("event_id")
    reply = F.when(i % 4 == 0, F.concat(F.lit("score: "), F.format_number((i % 17) / 10.0, 1))).when(i % 4 == 1, "none").otherwise(F.concat(F.lit("幻觉比例：0."), (i % 10).cast("string")))
    return table(spark, sf_dir, "events").where("event_id % 4 < 3").select("event_id", evaluate.score_of(reply).alias("score"), evaluate.hallucination_of(reply).alias("hallucinated"))


@query("reports", "SELECT kind, count(*) AS n, count(*) FILTER (WHERE empty) AS empty FROM (SELECT (['decision', 'chat', 'retrieval', 'tool_call', 'memory_recall'])[event_id % 5 + 1] AS kind, user_id % 4 = 0 AS empty FROM events) GROUP BY kind")
def reports(spark, sf_dir):
    e, out = table(spark, sf_dir, "events"), None
    for i, kind in enumerate(search.REPORTS):
        one = search.report(kind, e.where(F.col("event_id") % 5 == i), F.col("user_id"), F.col("ts"), count=F.col("user_id") % 4, score=F.col("value"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("empty"), 1)).alias("empty"))


@query("truncated", "SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS short, left(text, 100) AS capped FROM documents")
def truncated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncated(F.col("text"), 50).alias("short"), budget.stream_cap(F.col("text"), 100).alias("capped"))


@query("audit_text", "SELECT doc_id, left(coalesce(text, ''), 1024) AS stored FROM documents")
def audit_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.bounded_utf16(F.col("text")).alias("stored"))


@query("mask_message", "SELECT event_id, 'call 138****' || lpad((event_id % 100)::VARCHAR, 2, '0') || ' key sk-**** end' AS masked FROM events")
def mask_message(spark, sf_dir):
    said = F.concat(F.lit("call 138123456"), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"), F.lit(" key sk-abcdefgh"), F.col("event_id").cast("string"), F.lit(" end"))
    return table(spark, sf_dir, "events").select("event_id", T.mask_message(said).alias("masked"))


@query("reply_parts", """SELECT conv_id, turn, '["' || role || '"]' AS items, role AS inner_text FROM conversations""")
def reply_parts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.json_array(F.concat(F.lit('so: ["'), "role", F.lit('"] done'))).alias("items"), T.unfenced(F.concat(F.lit("```json\n"), "role", F.lit("\n```"))).alias("inner_text"))


@query("html_clean", rf"SELECT page_id, {_TRIM.format(x=r"regexp_replace(regexp_replace(html, '[\t\n\x0b\f\r ]+', ' ', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')")} AS cleaned FROM pages")
def html_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_html(F.col("html")).alias("cleaned"))


@query("pdf_clean", rf"SELECT doc_id, {_TRIM.format(x=r"regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+$', '')")} AS cleaned FROM documents")
def pdf_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_pdf(F.col("text")).alias("cleaned"))


@query("short_ids", "SELECT doc_id, left(md5(coalesce(text, '')), 16) AS short FROM documents")
def short_ids(spark, sf_dir):
    h = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 16))
    return table(spark, sf_dir, "documents").select("doc_id", T.short_uuid(dashed).alias("short"))


@query("zone_clock", "SELECT true AS well_formed")
def zone_clock(spark, sf_dir):
    return spark.range(1).select(T.now_in("Asia/Shanghai").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$").alias("well_formed"))
