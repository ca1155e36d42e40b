"""The composed search and batches when parts of them fail or do not end."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from granary.operators import search


def path(score=1.0, n=3):
    return lambda q: q.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("query_id", (F.col("i") + 10).cast("long").alias("id"), (F.lit(score) - F.col("i") / 10).alias("score"), F.col("i").alias("rank"))


def broken(q):
    raise ValueError("not planned")


def failing(q):
    return q.select("query_id", F.lit(1).cast("long").alias("id"), F.raise_error(F.lit("failed on the way")).cast("double").alias("score"), F.lit(0).alias("rank"))


def endless(q):
    def wait(batches):
        for b in batches:
            time.sleep(60)
            yield b

    return q.select("query_id", F.lit(1).cast("long").alias("id"), F.lit(1.0).alias("score"), F.lit(0).alias("rank")).mapInPandas(wait, "query_id long, id long, score double, rank int")


def queries(spark, texts=("a", "b")):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_a_path_that_fails_leaves_the_others(spark):
    hits, stages = search.searched(queries(spark), {"one": path(), "broken": broken, "failing": failing}, 3)
    assert {(r.query_id, r.id, r.rank) for r in hits.collect()} == {(q, 10 + i, i) for q in (0, 1) for i in range(3)}
    told = {r.stage: (r.hits, r.error) for r in stages.collect()}
    assert told["one"] == (6, None) and told["broken"] == (0, "not planned") and "failed on the way" in told["failing"][1]
    assert told["rewrite"] == (2, None) and told["retrieve"] == told["rerank"] == told["order"] == (6, None)


def test_a_path_that_does_not_end_is_left_out(spark):
    begun = time.perf_counter()
    hits, stages = search.searched(queries(spark), {"endless": endless, "one": path()}, 3, seconds=8)
    assert hits.count() == 6 and time.perf_counter() - begun < 40
    assert {r.stage: r.error for r in stages.collect()}["endless"] == "not done after 8 s"
    # what was cancelled holds no task any more
    time.sleep(1)
    assert not [s for s in spark.sparkContext.statusTracker().getActiveStageIds()]


def test_no_path_no_hits(spark):
    hits, stages = search.searched(queries(spark), [broken, failing], 3)
    assert hits.count() == 0 and hits.columns == ["query_id", "id", "score", "rank", "position"]
    assert [r.stage for r in stages.collect()] == ["rewrite", "path 0", "path 1"]


def test_a_batch_tells_each_error(spark):
    def one(q):
        return path()(q) if q.first() is None or q.first().text == "a" else failing(q) if q.first().text == "row" else broken(q)

    hits, told = search.batch_search(queries(spark, ("a", " ", "row", None, "plan", "a", *"xxxxx", "a")), one, seconds=60)
    rows = {r.query_id: (r.hits, r.error) for r in told.collect()}
    assert sorted(rows) == list(range(10)) and rows[0] == rows[5] == (3, None) and rows[1] == rows[3] == (0, "blank query")
    assert rows[4] == (0, "not planned") and "failed on the way" in rows[2][1] and {r.query_id for r in hits.collect()} == {0, 5}
    assert search.batch_search(queries(spark, (" ",)), one)[0].count() == 0
