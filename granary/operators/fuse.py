"""Fusion of ranked lists. Rank and path order are columns, so ties fall as in a stable list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hit_key(metadata: Column, content: Column) -> Column:
    """documentId#chunkIndex, or documentId, or the hash of the content."""
    doc, chunk = metadata["documentId"], metadata["chunkIndex"]
    return F.when(doc.isNotNull() & chunk.isNotNull(), F.concat_ws("#", doc, chunk)).when(doc.isNotNull(), doc).otherwise(F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256))


def _weight(weights: dict[int, float] | None) -> Column:
    known = F.lit(1.0)
    for path, w in (weights or {}).items():
        known = F.when(F.col("path") == path, F.lit(float(w))).otherwise(known)
    return known


def _ranked(scored: DataFrame, limit: int | None) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")
    out = scored.withColumn("rank", (F.row_number().over(w) - 1).cast("long"))
    out = out if limit is None else out.where(F.col("rank") < limit)
    return out.drop("seen")


def reciprocal_rank(lists: DataFrame, k: int = 60, weights: dict[int, float] | None = None, limit: int | None = 10, payload: list[str] = ()) -> DataFrame:
    """(query_id, id, score, rank, *payload) of lists (query_id, path, rank, id, *payload).

    score = sum of weight / (k + rank + 1) with ranks from 0 (a key twice in a list adds twice); a path
    without weight has 1. Payload is of the first list that has the key; ties go to the key seen first.
    """
    seen = F.struct("path", "rank")
    keep = [F.min_by(c, seen).alias(c) for c in payload]
    scored = lists.groupBy("query_id", "id").agg(F.round(F.sum(_weight(weights) / (k + F.col("rank") + 1)), 9).alias("score"), F.min(seen).alias("seen"), *keep)
    return _ranked(scored, limit)


def normalised(lists: DataFrame, weights: dict[int, float] | None = None, smaller_is_better: set[int] = frozenset(), limit: int | None = 10, payload: list[str] = ()) -> DataFrame:
    """Sum of weighted scores, each brought to 0..1 in its query and path; equal scores count 1.

    Paths in smaller_is_better (distances) are turned round.
    """
    w = Window.partitionBy("query_id", "path")
    low, high = F.min("score").over(w), F.max("score").over(w)
    unit = F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))
    turned = F.when((high != low) & F.col("path").isin(*smaller_is_better), 1 - unit).otherwise(unit) if smaller_is_better else unit
    rows = lists.withColumn("_s", turned * _weight(weights))
    seen = F.struct("path", "rank")
    keep = [F.min_by(c, seen).alias(c) for c in payload]
    scored = rows.groupBy("query_id", "id").agg(F.round(F.sum("_s"), 6).alias("score"), F.min(seen).alias("seen"), *keep)
    return _ranked(scored, limit)


def lost_in_the_middle(hits: DataFrame) -> DataFrame:
    """hits (query_id, rank from 0) with position: best at both ends; up to two rows keep their place."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    i = F.col("rank")
    moved = F.when(i % 2 == 0, F.floor(i / 2)).otherwise(n - 1 - F.floor((i - 1) / 2))
    return hits.withColumn("position", F.when(n <= 2, i).otherwise(moved).cast("long"))


def weighted_order(hits: DataFrame, head: float = 0.4, tail: float = 0.4) -> DataFrame:
    """hits with position: the head's rows, then the rest, then those that follow the head.

    head and tail are shares of a query's rows, rounded half up, one row at least each; if they overlap the tail is cut.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    i = F.col("rank")
    h = F.greatest(F.floor(n * F.lit(head) + 0.5), F.lit(1))
    t = F.greatest(F.floor(n * F.lit(tail) + 0.5), F.lit(1))
    t = F.when(h + t > n, n - h).otherwise(t)
    at = F.when(i < h, i).when(i < h + t, n - t + (i - h)).otherwise(i - t)
    return hits.withColumn("position", at.cast("long"))


def sentence_window(hits: DataFrame, n: int = 2) -> DataFrame:
    """hits (sentence, sentences: the document's) with content, window_start, window_end, hit_index, original.

    The hit is the equal sentence, else the first that contains it or that it contains; it becomes itself and n
    sentences on both sides, joined by line breaks. A hit that is not found keeps its text.
    """
    at = F.array_position("sentences", F.col("sentence"))
    near = F.transform("sentences", lambda s, i: F.when(F.contains(s, F.col("sentence")) | F.contains(F.col("sentence"), s), i))
    first = F.array_min(F.filter(near, lambda x: x.isNotNull()))
    i = F.when(at > 0, at - 1).otherwise(first).cast("int")
    out = hits.withColumn("hit_index", i)
    start = F.greatest(F.col("hit_index") - n, F.lit(0))
    end = F.least(F.col("hit_index") + n, F.size("sentences") - 1)
    text = F.array_join(F.slice("sentences", start + 1, end - start + 1), "\n")
    return out.withColumn("window_start", start).withColumn("window_end", end).withColumn("original", F.col("sentence")).withColumn("content", F.when(F.col("hit_index").isNull(), F.col("sentence")).otherwise(text))
