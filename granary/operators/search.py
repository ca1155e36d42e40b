"""The composed search: rewrite, paths, fusion, rerank and order, with counts and times of its stages; batches and facts of what happened."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from . import fuse
from .evaluate import guarded
from .retrieve import multi_path, rerank, traced
from .tables import written

#: Most queries of a batch.
BATCH = 10


def rewritten(queries: DataFrame, model: Callable[[str], str | None] | None, text: str = "text", most: int = 500) -> DataFrame:
    """queries with asked (the text as it came) and its rewriting by a guarded model; a failing or missing model leaves the text.

    The same shell serves hypothetical answers and step-back questions, by another model. Queries are a small, stated set.
    """
    kept = queries.withColumn("asked", F.col(text))
    if model is None:
        return kept

    def run(batches):
        for pdf in batches:
            said = [guarded(lambda t=t: model(t), most=most, sleep=lambda _: None) if isinstance(t, str) else None for t in pdf[text]]
            yield pdf.assign(**{text: [s if s is not None else t for s, t in zip(said, pdf[text], strict=True)]})

    return kept.mapInPandas(run, kept.schema)


def ran(spark: SparkSession, tasks: dict[str, Callable[[], DataFrame]], seconds: float | None = None, at_once: int = 8) -> dict[str, tuple[DataFrame | None, int, float, str | None]]:
    """For each task its result as a table, its rows, its seconds and why it has none: tasks run side by side, each to its end, so that rows that fail fail here.

    Rows are counted as they are written (observe), not by a second run. A task that is not done after `seconds` is cancelled and counts as failed; the others' results stay.
    """

    def one(name: str, tag: str) -> tuple[DataFrame, int]:
        spark.sparkContext.addJobTag(tag)
        try:
            seen = Observation()
            return written(tasks[name]().observe(seen, F.count(F.lit(1)).alias("n")), "stage"), seen.get["n"]
        finally:
            spark.sparkContext.removeJobTag(tag)

    out: dict[str, tuple[DataFrame | None, int, float, str | None]] = {}
    pool = ThreadPoolExecutor(at_once)
    begun = time.perf_counter()
    tags = {name: f"search-{uuid.uuid4().hex}" for name in tasks}
    waiting = {name: pool.submit(inheritable_thread_target(spark)(one), name, tags[name]) for name in tasks}
    for name, task in waiting.items():
        try:
            table, n = task.result(None if seconds is None else max(0.0, begun + seconds - time.perf_counter()))
            out[name] = table, n, time.perf_counter() - begun, None
        except TimeoutError:
            task.cancel()
            spark.sparkContext.cancelJobsWithTag(tags[name])
            out[name] = None, 0, time.perf_counter() - begun, f"not done after {seconds:g} s"
        except Exception as e:  # noqa: BLE001  whatever a path fails with, the others' hits stay
            out[name] = None, 0, time.perf_counter() - begun, (str(e) or type(e).__name__)[:500]
    pool.shutdown(wait=False, cancel_futures=True)
    return out


def searched(queries: DataFrame, paths: dict[str, Callable[[DataFrame], DataFrame]] | list[Callable[[DataFrame], DataFrame]], k: int = 10, model=None, scorer=None, rrf_k: int = 60, fused_k: int = 10, seconds: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, stages): rewriting, paths, fusion, rerank and lost-in-the-middle order for a set of queries.

    paths: functions from queries (query_id, text, ...) to (query_id, id, score, rank), by name. They run side by side; one that fails, when it is planned or while it runs, or that is not
    done after `seconds`, is left out and the others' hits stay. hits: (query_id, id, score, rank, position), none if no path has an end.
    stages: (stage, hits, seconds, error), one for each path too. Each stage's result is a table that the next one reads, so nothing is worked out twice.
    """
    spark, marks = queries.sparkSession, []

    def stage(name: str, f: Callable[[], DataFrame]) -> DataFrame:
        table, n, took, error = ran(spark, {name: f})[name]
        marks.append((name, n, took, error))
        if table is None:
            raise RuntimeError(error)
        return table

    asked = stage("rewrite", lambda: rewritten(queries, model))
    named = paths if isinstance(paths, dict) else {f"path {i}": p for i, p in enumerate(paths)}
    shaped = lambda path: path(asked).select("query_id", "id", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"))
    found = ran(spark, {name: lambda p=p: shaped(p) for name, p in named.items()}, seconds)
    marks += [(name, n, took, error) for name, (_, n, took, error) in found.items()]
    lists = [table for table, *_ in found.values() if table is not None]
    told = lambda: spark.createDataFrame(marks, "stage string, hits long, seconds double, error string")
    if not lists:
        return spark.createDataFrame([], "query_id long, id long, score double, rank long, position long"), told()
    fused = stage("retrieve", lambda: multi_path(lists, lambda u, more: fuse.reciprocal_rank(u, rrf_k, limit=None, payload=more), k, fused_k))
    best = stage("rerank", lambda: rerank(fused, k, scorer))
    placed = stage("order", lambda: fuse.lost_in_the_middle(best))
    return placed, told()


def detailed(paths: dict[str, DataFrame], k: int = 10, rrf_k: int = 60) -> DataFrame:
    """(query_id, path, id, score, rank): each path's own hits beside the fused ones, which are made where several paths have hits."""
    own = None
    for name, p in paths.items():
        one = p.select("query_id", F.lit(name).alias("path"), "id", F.col("score").cast("double").alias("score"), "rank").where(F.col("rank") < k)
        own = one if own is None else own.unionByName(one)
    fused = multi_path(list(paths.values()), lambda u, more: fuse.reciprocal_rank(u, rrf_k, limit=None, payload=more), k, k)
    return own.unionByName(fused.select("query_id", F.lit("fused").alias("path"), "id", "score", "rank"))


def searched_with_trace(hits: DataFrame, texts: DataFrame, tenant: str, owner: str, now: Column, reranked: bool = False) -> DataFrame:
    """The trace rows of a search in one scope: sources with snippets, type rerank or hybrid; a blank scope is an error."""
    from .relational import valid_scope

    if not valid_scope(tenant, owner):
        raise ValueError("a scope needs a tenant and an owner")
    return traced(hits, texts, "rerank" if reranked else "hybrid").withColumn("tenant_id", F.lit(tenant)).withColumn("owner_user_id", F.lit(owner)).withColumn("create_time", now)


def batch_search(queries: DataFrame, search: Callable[[DataFrame], DataFrame], order: str = "query_id", most: int = BATCH, seconds: float | None = 15.0) -> tuple[DataFrame, DataFrame]:
    """(hits, outcomes): the first `most` queries in their order; a row a query (query_id, hits, error).

    The limit is the batch's own rule. Each query is a search of its own, side by side with the others: one that is blank, fails or is not done after `seconds` has its error and does not
    stop the others.
    """
    spark = queries.sparkSession
    first = queries.orderBy(order).limit(most).collect()
    one = lambda r: spark.createDataFrame([r], queries.schema)
    asked = {str(i): r for i, r in enumerate(first) if r["text"] is not None and r["text"].strip()}
    found = ran(spark, {i: lambda r=r: search(one(r)) for i, r in asked.items()}, seconds, most)
    told = [(r["query_id"], *(found[str(i)][1::2] if str(i) in asked else (0, "blank query"))) for i, r in enumerate(first)]
    hits = None
    for table, *_ in found.values():
        if table is not None:
            hits = table if hits is None else hits.unionByName(table)
    kind = queries.schema["query_id"].dataType.simpleString()
    return search(queries.limit(0)) if hits is None else hits, spark.createDataFrame(told, f"query_id {kind}, hits long, error string")


# Kinds of reports.
REPORTS = ("decision", "chat", "retrieval", "tool_call", "memory_recall")


def report(kind: str, rows: DataFrame, session: Column, at: Column, **fields: Column) -> DataFrame:
    """Facts (kind, session_id, at, empty, fields_json) of one of the five kinds of reports, to be appended to one table.

    empty tells that the field count is 0 or missing; a null score counts as 0.
    """
    if kind not in REPORTS:
        raise ValueError(f"{kind} is no kind of report")
    known = {k: F.coalesce(v, F.lit(0.0)) if k == "score" else v for k, v in fields.items()}
    count = known.get("count")
    empty = F.lit(None).cast("boolean") if count is None else F.coalesce(count, F.lit(0)) == 0
    return rows.select(F.lit(kind).alias("kind"), session.cast("string").alias("session_id"), at.alias("at"), empty.alias("empty"), F.to_json(F.struct(*[v.alias(k) for k, v in known.items()])).alias("fields_json"))
