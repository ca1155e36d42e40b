"""Vector and keyword retrieval for a stated set of queries, and the multi-path search over them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .tables import written

#: A query set is sent to every task only up to this many rows.
MOST_QUERIES = 4096

_TOKEN = r"[一-鿿]|[\p{L}\p{N}_&&[^一-鿿]]+"


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays, in doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is zero. Arrays of different length are an error."""
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double"))
    return F.coalesce(same, F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def in_blocks(queries: DataFrame, search, key: str = "query_id") -> DataFrame:
    """search(block) where a block of queries has a bounded size, unioned over as many blocks as there must be."""
    n = queries.count()
    if n <= MOST_QUERIES:
        return search(queries)
    parts = -(-2 * n // MOST_QUERIES)
    out = None
    for i in range(parts):
        one = search(queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i))
        out = one if out is None else out.unionByName(one)
    return out


def top_k(rows: DataFrame, k: int, score: str, ascending: bool, tie: str, group: str = "query_id") -> DataFrame:
    """The k best rows of each query with their rank from 0. Spark limits each task's groups before the shuffle."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    w = Window.partitionBy(group).orderBy(order, F.col(tie).asc())
    return rows.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).where(F.col("rank") < k)


def vector_search(corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding", skip_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank): exact nearest rows of corpus for queries (query_id, query_vec).

    The score is the distance for l2 (smaller is better), the similarity for cosine, to six digits; a row or query whose vector is null, or whose
    similarity is not defined, has none. Scope filters belong on corpus and are pushed to its scan.
    """
    rows = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v"))
    return top_k(nearest(rows, queries, k, metric, "id", "_v", skip_self, 6), k, "score", metric == "l2", "id")


def vectors_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A matrix of an Arrow column of lists without nulls; lists of different lengths are an error."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = set(pc.list_value_length(column).to_pylist()) if len(column) else {0}
    if len(sizes) > 1:
        raise ValueError(f"vectors differ in length: {sorted(sizes)}")
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def nearest(rows: DataFrame, queries: DataFrame, k: int, metric: str, id_col: str, vec_col: str, skip_self: bool = False, digits: int | None = None) -> DataFrame:
    """rows without their vectors but with query_id and score: of each batch of rows those that can be among the k best of a query, ties by id included.

    A batch meets a block of queries in one matrix product, which tells which pairs can count; only their scores are then worked out one by one. Each batch
    leaves k rows a query, whatever the number of rows alike, so neither pairs nor vectors are shuffled; the caller ranks what is left. Queries go to the tasks
    in blocks of a bounded number.
    """
    kept = rows.where(F.col(vec_col).isNotNull())
    others = [c for c in rows.columns if c != vec_col]

    def block(some: DataFrame) -> DataFrame:
        asked = some.select("query_id", "query_vec").where("query_vec is not null").toArrow()
        ids, q = asked["query_id"].combine_chunks(), vectors_of(asked["query_vec"])

        def run(batches):
            for b in batches:
                if b.num_rows and len(q):
                    x = vectors_of(b.column(vec_col))
                    if x.shape[1] != q.shape[1]:
                        raise ValueError(f"vectors differ in length: {x.shape[1]} and {q.shape[1]}")
                    own = b.column(id_col)
                    for i in range(0, len(q), _TOGETHER):
                        some_ids = ids[i : i + _TOGETHER]
                        at, row, score = _best_pairs(x, q[i : i + _TOGETHER], k, metric, own, some_ids if skip_self else None, digits)
                        yield pa.RecordBatch.from_arrays([some_ids.take(pa.array(at)), *[b.column(c).take(pa.array(row)) for c in others], pa.array(score)], names=["query_id", *others, "score"])

        types = ", ".join(f"`{c}` {t}" for c, t in [("query_id", some.schema["query_id"].dataType.simpleString()), *[x for x in rows.dtypes if x[0] in others], ("score", "double")])
        return kept.mapInArrow(run, types)

    return in_blocks(queries.select("query_id", "query_vec"), block)


#: So many queries are in one product, which bounds its size.
_TOGETHER = 256
#: A pair whose score by matrix products is this near to the k-th best one is worked out again; the error of such a score is far smaller.
_NEAR = 1e-5


def _best_pairs(x: np.ndarray, q: np.ndarray, k: int, metric: str, own: pa.Array, asked: pa.Array | None, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of pairs that can be among the k best of x for each row of q; asked: ids of queries whose own row does not count."""
    with np.errstate(all="ignore"):
        if metric == "l2":
            rough = np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)[None], 0))
        else:
            rough = -(q @ x.T) / np.sqrt((q * q).sum(1)[:, None] * (x * x).sum(1)[None])
    rough[~np.isfinite(rough)] = np.inf
    if asked is not None:
        names = pc.index_in(own, asked)
        same = np.flatnonzero(pc.is_valid(names).to_numpy(zero_copy_only=False))
        rough[names.take(pa.array(same)).to_numpy(zero_copy_only=False), same] = np.inf
    limit = np.partition(rough, k - 1, axis=1)[:, k - 1] if rough.shape[1] > k else np.full(len(q), np.inf)
    scale = np.maximum(np.abs(np.where(np.isfinite(limit), limit, 0)), 1)
    at, row = np.nonzero((rough <= (limit + _NEAR * scale)[:, None]) & np.isfinite(rough))
    with np.errstate(all="ignore"):
        score = np.concatenate([_scores(x[row[i : i + 50_000]], q[at[i : i + 50_000]], metric) for i in range(0, len(at), 50_000)]) if len(at) else np.zeros(0)
    if digits is not None:
        score = np.copysign(np.floor(np.abs(score) * 10**digits + 0.5) / 10**digits, score) + 0.0
    place = np.empty(len(own), np.int64)
    place[pc.sort_indices(own).to_numpy()] = np.arange(len(own))
    order = np.lexsort((place[row], score if metric == "l2" else -score, at))
    first = np.searchsorted(at[order], np.arange(len(q)))
    order = order[np.arange(len(order)) - first[at[order]] < k]
    return at[order], row[order], score[order]


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.sqrt(((x - q) ** 2).sum(1))
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(1)))


def analysed(text: Column) -> Column:
    """Lower-cased words; CJK ideographs stand alone. Texts without ideographs are split at what is no letter or digit, which costs less."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # a text of ASCII alone, which two lengths tell, is not looked through
    return F.when((F.octet_length(low) > F.char_length(low)) & low.rlike("[一-鿿]"), F.regexp_extract_all(low, F.lit(_TOKEN), F.lit(0))).otherwise(F.array_remove(F.split(low, r"[^\p{L}\p{N}_]+"), ""))


def bm25_scores(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, score) of every document that has a term of a query (query_id, text).

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); N, df and the mean length are of all docs. A query's terms count once each.
    Query terms are known before the corpus is read, in blocks of a bounded number, so only their places leave a document's words. Texts are read once:
    these places and the documents' lengths are kept as a table, from which N, df and the scores come.
    """
    every = queries.select("query_id", F.explode(F.array_distinct(analysed(F.col("text")))).alias("term"))

    def block(terms: DataFrame) -> DataFrame:
        asked = [r.term for r in terms.select("term").distinct().collect()]
        place = lambda w, t, n: F.struct(F.size(w).alias("dl"), t.alias("term"), n.alias("tf"))
        # the first element stands for the document itself; words and hits are worked out once
        counted = lambda w: let(F.filter(w, lambda x: x.isin(asked) if asked else F.lit(False)), lambda h: F.transform(F.array_distinct(h), lambda t: place(w, t, F.size(F.filter(h, lambda x: x == t)))))
        places = let(analysed(F.col(text_col)), lambda w: F.concat(F.array(place(w, F.lit(None).cast("string"), F.lit(0))), counted(w)))
        own = written(docs.select(F.col(id_col).alias("id"), F.explode(places).alias("p")).select("id", "p.*"), "places")
        seen = {r.term: (r.n, r.s) for r in own.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("s")).collect()}
        n, total = seen.pop(None, (0, 0))
        mean = (total or 0) / n if n else 1.0
        weighed = terms.sparkSession.createDataFrame([(t, math.log(1 + (n - c + 0.5) / (c + 0.5))) for t, (c, _) in seen.items()], "term string, idf double")
        weighed = terms.join(F.broadcast(weighed), "term")
        tf = own.where("term is not null")
        part = F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(mean or 1.0)))
        return tf.join(F.broadcast(weighed), "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))

    # blocks are of queries, so that a query's terms stay together
    return in_blocks(every, block)


def bm25_search(docs: DataFrame, queries: DataFrame, k: int = 10, **options) -> DataFrame:
    """(query_id, id, score, rank): the best documents by BM25; nothing for a query without known terms."""
    return top_k(bm25_scores(docs, queries, **options), k, "score", False, "id")


def _shorter(term: Column, n: Column) -> Column:
    """The term and what is left of it without one letter, and without two where n is 2."""
    one = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    first = F.when((n >= 1) & (F.length(term) > 0), one(term)).otherwise(F.array().cast("array<string>"))
    second = F.when(n >= 2, F.flatten(F.transform(first, lambda t: F.when(F.length(t) > 0, one(t)).otherwise(F.array().cast("array<string>"))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(term), first, second))


def fuzzy_terms(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Query terms and the terms of vocabulary (term) within the automatic edit distance: 0 up to two letters, 1 up to five, else 2.

    A swap of two neighbouring letters is one edit. Terms at such a distance share what is left after as many letters are taken away
    on either side (a swap: one on either), so candidates come from an equi-join of these; each is checked.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(analysed(F.col("text")))).alias("asked"))
    size = F.length("asked")
    q = q.withColumn("allowed", F.when(size <= 2, 0).when(size <= 5, 1).otherwise(2))
    left = q.select("query_id", "asked", "allowed", F.explode(_shorter(F.col("asked"), F.col("allowed"))).alias("rest"))
    # of the vocabulary only what is near enough in length to be met
    right = vocabulary.select("term").distinct().withColumn("most", F.when(F.length("term") <= 1, 0).when(F.length("term") <= 3, 1).otherwise(2))
    right = right.select("term", F.explode(_shorter(F.col("term"), F.col("most"))).alias("rest"))
    near = left.join(right, "rest").select("query_id", "asked", "allowed", "term").distinct()
    swaps = F.exists(F.sequence(F.lit(1), F.greatest(F.length("asked") - 1, F.lit(1))), lambda i: F.levenshtein(F.concat(F.substring("asked", F.lit(1), i - 1), F.substring("asked", i + 1, F.lit(1)), F.substring("asked", i, F.lit(1)), F.substring("asked", i + 2, F.length("asked"))), F.col("term")) <= F.col("allowed") - 1)
    return near.where((F.levenshtein("asked", "term") <= F.col("allowed")) | ((F.col("allowed") >= 1) & (F.length("asked") >= 2) & swaps)).select("query_id", "asked", "term")


def multi_path(paths: list[DataFrame], fuse, k: int, fused_k: int = 10) -> DataFrame:
    """Fuses the paths that have rows for a query; a query with one such path keeps its scores, up to k.

    paths: (query_id, id, score, rank); fuse: from the union (with path) and the names of columns to carry to (query_id, id, score, rank) and
    these. The ranked lists flow through one fusion, each read once.
    """
    union = None
    for i, p in enumerate(paths):
        one = p.select("query_id", "id", F.col("score").cast("double").alias("score"), "rank").withColumn("path", F.lit(i))
        union = one if union is None else union.unionByName(one)
    w = Window.partitionBy("query_id")
    union = union.withColumn("several", F.min("path").over(w) != F.max("path").over(w)).withColumn("own_score", F.col("score")).withColumn("own_rank", F.col("rank"))
    fused = fuse(union, ["several", "own_score", "own_rank"])
    pick = lambda a, b: F.when(F.col("several"), F.col(a)).otherwise(F.col(b)).alias(a)
    return fused.where(F.when(F.col("several"), F.col("rank") < fused_k).otherwise(F.col("own_rank") < k)).select("query_id", "id", pick("score", "own_score"), pick("rank", "own_rank"))


def rerank(candidates: DataFrame, k: int, scorer=None) -> DataFrame:
    """At most k rows a query: as they are where there are no more; else by scorer (a function of DataFrame that adds new_score), or the first k."""
    n = Window.partitionBy("query_id")
    counted = candidates.withColumn("_n", F.count(F.lit(1)).over(n))
    few = counted.where(F.col("_n") <= k).select(candidates.columns)
    many = counted.where(F.col("_n") > k).select(candidates.columns)
    if scorer is None:
        return few.unionByName(many.where(F.col("rank") < k))
    w = n.orderBy(F.desc("new_score"), "rank")
    best = scorer(many).where("new_score is not null").withColumn("_r", F.row_number().over(w) - 1).where(F.col("_r") < k)
    best = best.withColumn("score", F.col("new_score")).withColumn("rank", F.col("_r").cast("long"))
    return few.unionByName(best.select(candidates.columns))


def traced(results: DataFrame, texts: DataFrame, kind: str = "hybrid") -> DataFrame:
    """A trace row a query: its sources in order, with the first 200 characters of each."""
    rows = results.join(texts.select("id", F.substring("text", 1, 200).alias("snippet")), "id", "left")
    source = F.struct("rank", F.col("id").alias("id"), "snippet", "score")
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources"), F.count(F.lit(1)).alias("retrieval_topk")).withColumn("retrieval_type", F.lit(kind))
