"""Vector search by block products, quantised cells and neighbour graphs, against brute force."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import memory, neighbours, retrieve, tables, vectors

SCHEMA = "vec_id long, embedding array<double>"


def clustered(n=600, width=16, centres=20, spread=0.25, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, width))[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, width))


def frame(spark, x, more=()):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + list(more), SCHEMA).repartition(7)


def asked(df, each=20):
    return df.where((F.col("vec_id") % each == 0) & F.col("embedding").isNotNull()).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def brute(x, each, k, metric):
    out = {}
    for i in range(0, len(x), each):
        s = np.sqrt(((x - x[i]) ** 2).sum(1)) if metric == "l2" else -(x @ x[i]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[i]))
        order = sorted((round(float(v), 6), j) for j, v in enumerate(s) if j != i)[:k]
        out[i] = [j for _, j in order]
    return out


def hits(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    return got


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_block_products_equal_brute_force(spark, metric):
    x = clustered()
    x[200:400] = x[100]  # a third of the rows alike
    df = frame(spark, x, [(9000, None)])
    assert hits(retrieve.vector_search(df, asked(df), 5, metric, skip_self=True)) == brute(x, 20, 5, metric)


def test_rows_alike_leave_k_rows_a_batch(spark):
    df = frame(spark, np.ones((3000, 4))).coalesce(1)
    rows = retrieve.nearest(df, asked(df, 1000), 5, "l2", "vec_id", "embedding")
    assert rows.count() == 3 * 5 and {r.vec_id for r in rows.collect()} <= set(range(3000))


def test_vectors_without_a_score(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0])], SCHEMA)
    q = spark.createDataFrame([(1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0])], "query_id long, query_vec array<double>")
    assert [(r.query_id, r.id, r.score) for r in retrieve.vector_search(df, q, 5, "cosine").collect()] == [(1, 2, 0.707107)]
    assert {r.id for r in retrieve.vector_search(df, q, 5, "l2").where("query_id = 1").collect()} == {1, 2}
    assert retrieve.vector_search(df, q.limit(0), 5).count() == 0 and retrieve.vector_search(df.limit(0), q, 5).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        retrieve.vector_search(df, spark.createDataFrame([(1, [1.0])], "query_id long, query_vec array<double>"), 5).collect()


def test_recall_carries_its_columns(spark):
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    store = frame(spark, np.eye(4)).select(F.col("vec_id").alias("memory_id"), "embedding", F.lit(1).alias("status"), F.lit(0.5).alias("importance"), now.alias("created_at"))
    q = spark.createDataFrame([(7, [1.0, 0.0, 0.0, 0.0])], "query_id long, query_vec array<double>")
    assert [(r.query_id, r.memory_id, r.composite) for r in memory.recall(store, q, now).collect()] == [(7, 0, 0.9)]


@pytest.fixture(scope="module")
def built(spark):
    x = clustered()
    x[200:400] = x[100]
    df = frame(spark, x, [(9000, None)])
    quantiser = vectors.trained(df, parts=4, codes=32)
    return x, df, quantiser, vectors.build_index(df, quantiser)


def test_quantised_search(spark, built):
    x, df, quantiser, index = built
    assert len(quantiser.centres) == 25 and quantiser.books.shape == (4, 32, 4)
    assert index.table(spark, "codes").count() == index.table(spark, "vectors").count() == len(x)
    exact = retrieve.vector_search(df, asked(df), 5, "l2", skip_self=True)
    # all cells and candidates: the exact search
    every = vectors.quantised_search(index, asked(df), 5, 25, len(x), skip_self=True)
    assert hits(every) == hits(exact)
    some = vectors.quantised_search(index, asked(df), 5, 5, 60, skip_self=True)
    facts = vectors.search_facts(index, asked(df), some, exact, 5, 60).first()
    assert facts.recall >= 0.9 and facts.codes_read < 0.6 and facts.vectors_read <= 0.1
    # scores are those of the vectors
    truth = {(r.query_id, r.id): r.score for r in retrieve.vector_search(df, asked(df), len(x), "l2", skip_self=True).collect()}
    assert all(truth[r.query_id, r.id] == r.score for r in some.collect())


def test_index_does_not_depend_on_partitions(spark, built):
    x, df, quantiser, _ = built
    again = vectors.trained(df.repartition(2).sortWithinPartitions(F.desc("vec_id")), parts=4, codes=32)
    assert (again.centres == quantiser.centres).all() and (again.books == quantiser.books).all()


def test_an_index_learnt_from_a_share_has_every_row(spark, built):
    x, df, _, _ = built
    few = vectors.trained(df, parts=4, codes=32, sample=150)
    assert (few.centres == vectors.trained(df.repartition(3), parts=4, codes=32, sample=150).centres).all() and len(few.centres) <= 25
    assert vectors.build_index(df, few).table(spark, "codes").count() == len(x)


def test_shelves_that_are_not_probed_are_not_read(spark, built):
    x, df, quantiser, index = built
    one = asked(df).limit(1)
    plan = vectors.candidates(index, one, 1, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shelf" in plan or "PartitionFilters: [(shelf" in plan or "shelf" in plan.split("PartitionFilters")[1][:60]
    assert "PushedFilters: [IsNotNull(cell), EqualTo(cell" in plan
    assert vectors.quantised_search(index, one.limit(0), 5, 1, 10).count() == 0


def test_neighbour_graph(spark):
    x = clustered(800)
    df = frame(spark, x, [(9000, None), (9001, [0.0] * 16)])
    graph = neighbours.neighbour_graph(df, 12)
    everyone = df.where("vec_id < 9000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    exact = retrieve.vector_search(df, everyone, 12, "cosine", skip_self=True)
    assert vectors.recall_of(graph.select(F.col("id").alias("query_id"), F.col("nb").alias("id")), exact).first().recall > 0.9
    assert graph.groupBy("id").count().agg(F.max("count")).first()[0] == 12 and graph.where("id = nb or id >= 9000").isEmpty()
    walk = neighbours.graph_walk(df, neighbours.linked(graph, 12), asked(df), 40, 10, skip_self=True)
    found, truth = neighbours.nearest_of(walk, 5, skip_self=True), retrieve.vector_search(df, asked(df), 5, "cosine", skip_self=True)
    facts = neighbours.walk_facts(walk, found, truth, 800).first()
    assert facts.recall >= 0.9 and facts.rows_touched < 0.6
    scores = {(r.query_id, r.id): r.score for r in retrieve.vector_search(df, asked(df), 800, "cosine", skip_self=True).collect()}
    assert all(abs(scores[r.query_id, r.id] - r.score) < 1e-9 for r in found.collect())


def test_a_round_of_a_walk_keeps_what_is_new_and_the_beam(spark):
    """What has left the beam is not written again in later rounds."""
    df = frame(spark, clustered(800))
    links = tables.written(neighbours.linked(neighbours.neighbour_graph(df, 8), 8), "links")
    folder = Path(tables.shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("walk-*"))
    walk = neighbours.graph_walk(df, links, asked(df), 8, 2, entries=64, skip_self=True)
    rounds = [spark.read.parquet(str(p)).count() for p in set(folder.glob("walk-*")) - before]
    assert len(rounds) > 3 and walk.count() == walk.select("query_id", "id").distinct().count()
    assert sum(rounds) <= walk.count() + len(rounds) * asked(df).count() * 8


def test_a_checked_walk_is_exact(spark):
    """Random directions, a narrow walk over few links: it misses hits, which the check adds."""
    df = frame(spark, np.random.default_rng(5).normal(size=(600, 16)), [(9000, None), (9001, [0.0] * 16)])
    walk = neighbours.graph_walk(df, neighbours.linked(neighbours.neighbour_graph(df, 3), 3), asked(df), 12, 2, entries=8, skip_self=True)
    rows = lambda x: {(r.query_id, r.id, r.score, r.rank) for r in x.collect()}
    want = rows(retrieve.vector_search(df, asked(df), 5, "cosine", skip_self=True))
    assert rows(neighbours.nearest_of(walk, 5, skip_self=True)) != want
    assert rows(neighbours.checked(walk, df, asked(df), 5, skip_self=True)) == want


def test_neighbours_of_rows_alike_and_of_none(spark):
    x = np.ones((300, 4))
    x[200:] = np.random.default_rng(1).normal(size=(100, 4))
    df = frame(spark, x)
    graph = neighbours.neighbour_graph(df, 4, rounds=3)
    assert graph.count() == 1200
    none = neighbours.neighbour_graph(df.limit(0), 4)
    assert none.count() == 0 and neighbours.graph_walk(df.limit(0), neighbours.linked(none, 4), asked(df), 8, 4).count() == 0


def test_queries_meet_codes_in_parts(spark, monkeypatch):
    """The candidates do not depend on how many queries meet a batch at once, and no more pairs than these queries' are held."""
    df = frame(spark, clustered(500))
    index = vectors.build_index(df, vectors.trained(df, cells=10, parts=4, codes=16))
    rows = lambda: {tuple(r) for r in vectors.candidates(index, asked(df), 5, 12, skip_self=True).collect()}
    monkeypatch.setattr(vectors, "TOGETHER", 10_000)
    whole = rows()
    monkeypatch.setattr(vectors, "TOGETHER", 3)
    assert rows() == whole and len(whole) == 12 * asked(df).count()
