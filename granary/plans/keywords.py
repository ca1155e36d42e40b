"""Registered keyword searches over stored postings, and over texts themselves, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fuzzy, postings, retrieve
from ..operators.tables import written
from .catalog import query
from .queries import _BM25, _TOK, EACH, K, table


def _index(spark, sf_dir) -> postings.Postings:
    return postings.stored_postings(spark, f"{sf_dir}/documents.parquet")


def _items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where(F.col("item_id") % EACH == 0).select(F.col("item_id").alias("query_id"), "text")


@query("keyword_blocks", rf"""WITH d AS (SELECT doc_id AS id, {_TOK.format(t="coalesce(text, '')")} AS w FROM documents), stats AS (SELECT avg(len(w)) AS mean FROM d),
tf AS (SELECT id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY id, term)
SELECT term, count(*) AS df, CAST(ceil(count(*) / {postings.BLOCK}) AS BIGINT) AS blocks, round(max(tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS top FROM tf, stats GROUP BY term""")
def keyword_blocks(spark, sf_dir) -> DataFrame:
    """Built anew at each call."""
    return postings.build_postings(table(spark, sf_dir, "documents")).terms.select("term", "df", "blocks", F.round("top", 6).alias("top"))


@query("bm25_texts", f"WITH {_BM25} SELECT query_id, id, score, rank FROM bm")
def bm25_texts(spark, sf_dir) -> DataFrame:
    """Without an index: one pass over the texts."""
    return retrieve.bm25_search(table(spark, sf_dir, "documents"), _items(spark, sf_dir), K)


@query("bm25_pruned", f"WITH {_BM25} SELECT query_id, id, score, rank FROM bm")
def bm25_pruned(spark, sf_dir) -> DataFrame:
    return postings.pruned_search(_index(spark, sf_dir), _items(spark, sf_dir), K)


@query("bm25_pruned_facts")
def bm25_pruned_facts(spark, sf_dir) -> DataFrame:
    """Blocks and postings of each query's terms, and those that were read."""
    return postings.pruned_scores(_index(spark, sf_dir), written(postings.query_terms(_items(spark, sf_dir)), "asked"), K)[1]


#: Five words of an item from its second one on, each with its second and third letters swapped where it has four.
_MISSPELT = r"CASE WHEN length(w) >= 4 THEN substr(w, 1, 1) || substr(w, 3, 1) || substr(w, 2, 1) || substr(w, 4) ELSE w END"


def _misspelt(spark, sf_dir) -> DataFrame:
    words = F.slice(retrieve.analysed(F.col("text")), 2, 5)
    swapped = F.transform(words, lambda w: F.when(F.length(w) >= 4, F.concat(F.substring(w, F.lit(1), F.lit(1)), F.substring(w, F.lit(3), F.lit(1)), F.substring(w, F.lit(2), F.lit(1)), F.substring(w, F.lit(4), F.length(w)))).otherwise(w))
    return _items(spark, sf_dir).select("query_id", F.array_join(swapped, " ").alias("text"))


#: DuckDB's distance counts bytes; letters beyond ASCII stand as capitals, which no term has.
_ONE_BYTE = "translate({x}, 'ßàáâäçèéêëíîïñóôöúûü', 'ABCDEFGHIJKLMNOPQRST')"
_APART = f"damerau_levenshtein({_ONE_BYTE.format(x='asked')}, {_ONE_BYTE.format(x='term')})"
_FUZZY = rf"""d AS MATERIALIZED (SELECT doc_id AS id, {_TOK.format(t="coalesce(text, '')")} AS w FROM documents), stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
tf AS MATERIALIZED (SELECT id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY id, term), df AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS MATERIALIZED (SELECT DISTINCT query_id, {_MISSPELT} AS asked FROM (SELECT item_id AS query_id, unnest(({_TOK.format(t='text')})[2:6]) AS w FROM benchmark WHERE item_id % {EACH} = 0)),
near AS (SELECT asked, term, 1 - {_APART} / least(length(asked), length(term)) AS boost FROM (SELECT DISTINCT asked FROM asked) JOIN df ON abs(length(asked) - length(term)) <= 2 AND {_APART} <= CASE WHEN length(asked) <= 2 THEN 0 WHEN length(asked) <= 5 THEN 1 ELSE 2 END),
best AS MATERIALIZED (SELECT asked, term, boost FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY boost DESC, term) AS i FROM near WHERE boost > 0) WHERE i <= 50),
terms AS MATERIALIZED (SELECT query_id, term, sum(boost) AS boost FROM asked JOIN best USING (asked) GROUP BY query_id, term)"""


@query("fuzzy_expansions", f"WITH {_FUZZY} SELECT query_id, term, round(boost, 6) AS boost FROM terms")
def fuzzy_expansions(spark, sf_dir) -> DataFrame:
    return fuzzy.fuzzy_query_terms(_index(spark, sf_dir))(_misspelt(spark, sf_dir)).withColumn("boost", F.round("boost", 6))


@query("fuzzy_search", f"""WITH {_FUZZY}, scored AS (SELECT query_id, id, round(sum(boost * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score FROM terms JOIN df USING (term) JOIN tf USING (term), stats GROUP BY query_id, id)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM scored) WHERE rank < {K}""")
def fuzzy_search(spark, sf_dir) -> DataFrame:
    index = _index(spark, sf_dir)
    return postings.whole_search(index, _misspelt(spark, sf_dir), K, fuzzy.fuzzy_query_terms(index))
