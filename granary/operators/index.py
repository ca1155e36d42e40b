"""Stored keyword indexes: postings for BM25 as a table that is built once and read by every search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .retrieve import analysed, in_blocks, top_k

# Keyword index: a row a document (term null, dl its length) and a row a document and term.

POSTINGS = "id, term, tf, dl, metadata"


def stored_metadata(metadata: Column) -> Column:
    """Metadata as it is stored: keys that begin with _ are dropped, but _source is kept as source and _file_name as fileName."""
    # Keys that are renamed.
    names = {"_source": "source", "_file_name": "fileName"}
    kept = F.map_filter(metadata, lambda k, v: ~k.startswith("_") | k.isin(*names))

    def name(k: Column) -> Column:
        out = k
        for a, b in names.items():
            out = F.when(k == a, F.lit(b)).otherwise(out)
        return out

    return F.transform_keys(kept, lambda k, v: name(k))


def keyword_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", metadata: Column | None = None, analyser: Callable[[Column], Column] = analysed) -> DataFrame:
    """Postings of docs (id, term, tf, dl, metadata): one pass that counts each document's terms in its own task. analyser: from a text to its terms; see segment.spaced for texts
    whose ideographs were cut into words.

    The row without a term stands for the document, so N and the mean length are sums over the index. Texts are not needed afterwards. Written with
    partitions or buckets by term, a search reads its own terms only.
    """
    meta = F.lit(None).cast("map<string,string>") if metadata is None else stored_metadata(metadata)
    place = lambda term, tf, dl: F.struct(term.alias("term"), tf.cast("long").alias("tf"), dl.alias("dl"))

    def counted(sorted_: Column) -> Column:
        """Of sorted words each once, with how often it is there: from where it begins to where the next one does."""
        n = F.size(sorted_)
        begins = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (n > 0) & ((i == 0) | (F.get(sorted_, i) != F.get(sorted_, i - 1))))
        return let(begins, lambda at: F.transform(at, lambda i, j: place(F.get(sorted_, i), F.coalesce(F.get(at, j + 1), n) - i, n)))

    # words are sorted and counted inside their row, so nothing is shuffled; the first place stands for the document
    places = let(F.sort_array(analyser(F.col(text_col))), lambda w: F.concat(F.array(place(F.lit(None).cast("string"), F.lit(None), F.size(w))), counted(w)))
    own = docs.select(F.col(id_col).alias("id"), meta.alias("metadata"), F.explode(places).alias("_p"))
    return own.select("id", "_p.term", "_p.tf", "_p.dl", F.when(F.col("_p.term").isNull(), F.col("metadata")).alias("metadata"))


def index_added(index: DataFrame, docs: DataFrame, replace: bool = True, **options) -> DataFrame:
    """index with docs: an id that it has is replaced; without replace it is there twice, as an appending store keeps it."""
    new = keyword_index(docs, **options)
    old = index.join(new.where("term is null").select("id").distinct(), "id", "left_anti") if replace else index
    return old.unionByName(new)


def index_removed(index: DataFrame, ids: DataFrame) -> DataFrame:
    """index without the documents of ids (id)."""
    return index.join(ids.select("id"), "id", "left_anti")


def index_count(index: DataFrame) -> DataFrame:
    return index.where("term is null").agg(F.count(F.lit(1)).alias("documents"))


def index_search(index: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank) by BM25 from an index; see retrieve.bm25_scores for the formula."""
    terms = queries.select("query_id", F.explode(F.array_distinct(analysed(F.col("text")))).alias("term"))
    stats = index.where("term is null").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"))

    def block(some: DataFrame) -> DataFrame:
        found = index.where("term is not null").join(F.broadcast(some), "term")
        df = index.where("term is not null").join(F.broadcast(some.select("term").distinct()), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        rows = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
        return rows.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))

    return top_k(in_blocks(terms, block), k, "score", False, "id")


def written_vectors(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Vectors, contents and metadata as files by cell; a commit is atomic, so there is nothing to flush."""
    (rows.write.mode(mode).partitionBy("cell") if "cell" in rows.columns else rows.write.mode(mode)).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
