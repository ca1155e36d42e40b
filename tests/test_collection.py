"""The stored vector collection, and neighbourhoods around hubs."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from granary.operators import graph
from granary.sources import collection as C


def rows(spark, documents, chunks=3, text="text", dimension=4):
    data = [(f"{d}-{i}", d, f"{text} {d} {i}", [float(d), float(i), 0.0, 1.0][:dimension], {"k": str(i)}, "t" if d % 2 else "s", "u") for d in documents for i in range(chunks)]
    return spark.createDataFrame(data, "id string, document_id long, content string, embedding array<double>, metadata map<string, string>, tenant_id string, owner_user_id string").withColumn("embedding", F.col("embedding").cast("array<float>"))


def ids(spark, c):
    return sorted(r.id for r in C.rows_of(spark, c).collect())


@pytest.fixture
def made(spark, tmp_path):
    return C.created(spark, C.Collection(f"{tmp_path}/c", 4, "cosine", cells=16))


def test_declaration(spark, made):
    assert C.opened(spark, made.path) == made and C.created(spark, made) == made and ids(spark, made) == []
    with pytest.raises(ValueError, match="declared otherwise"):
        C.created(spark, C.Collection(made.path, 5))


def test_a_failed_task_leaves_no_row(spark, made):
    C.inserted(rows(spark, range(5)), made)
    before = ids(spark, made)
    bad = rows(spark, range(5, 200)).unionByName(rows(spark, [999], dimension=3)).repartition(8)
    with pytest.raises(Exception, match="dimension is not declared"):
        C.inserted(bad, made)
    with pytest.raises(Exception, match="without an id"):
        C.inserted(rows(spark, [7]).withColumn("id", F.when(F.col("content") != "text 7 1", F.col("id"))), made)
    assert ids(spark, made) == before and len(before) == 15


def files(c):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{c.path}/rows") for f in names if f.endswith(".parquet")}


def test_a_delete_rewrites_its_cells_only(spark, made):
    C.inserted(rows(spark, range(40)), made)
    was = files(made)
    touched = C.document_deleted(spark, made, 7, tenant_id="t")
    assert 1 <= len(touched) <= 3 and ids(spark, made) == sorted(f"{d}-{i}" for d in range(40) if d != 7 for i in range(3))
    now = files(made)
    for path, time in was.items():
        cell = int(path.split("cell=")[1].split("/")[0])
        assert (now.get(path) == time) == (cell not in touched)
    # another scope's document stays
    assert C.document_deleted(spark, made, 8, tenant_id="t") == [] and len(ids(spark, made)) == 117


def test_an_emptied_cell_goes(spark, made):
    C.inserted(rows(spark, [1], 1), made)
    assert len(C.document_deleted(spark, made, 1)) == 1 and ids(spark, made) == [] and not files(made)


def test_upsert_and_clear(spark, made):
    C.inserted(rows(spark, range(10)), made)
    C.upserted(rows(spark, [3, 50], 2, "new"), made)
    got = {r.id: r.content for r in C.rows_of(spark, made).collect()}
    assert len(got) == 32 and got["3-0"] == "new 3 0" and got["3-2"] == "text 3 2" and got["50-1"] == "new 50 1" and len(ids(spark, made)) == 32
    C.cleared(spark, made)
    assert ids(spark, made) == []


def test_neighbourhoods_around_hubs(spark):
    pairs = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(200, 240)] + [(5, 200), (5, 5)]
    edges = spark.createDataFrame(pairs, "source_id long, target_id long")
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for c in (0, 5, 77, 203, 999):
        seen, front = {c: 0}, [c]
        for hop in (1, 2, 3):
            front = [b for b in {b for a in front for b in near.get(a, ())} if b not in seen]
            seen |= dict.fromkeys(front, hop)
        want |= {(c, n, h) for n, h in seen.items()}
    centres = spark.createDataFrame([(c,) for c in (0, 5, 77, 203, 999)], "entity_id long")
    for hub in (10, 10_000):
        assert {tuple(r) for r in graph.k_hop(edges, centres, 3, hub).collect()} == want


def test_neighbourhoods_of_centres_with_one_neighbour_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS", 100)
    pairs = [(0, i) for i in range(1, 60)] + [(60, 61), (62, 62), (63, 63), (63, 0), (64, 0), (64, None), (65, None), (None, 0)]
    edges = spark.createDataFrame(pairs + pairs[:5], "source_id long, target_id long")
    near: dict[int | None, set[int | None]] = {}
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            if x is not None:
                near.setdefault(x, set()).add(y)
    ids = [*range(0, 66), 999]
    centres = spark.createDataFrame([(c,) for c in ids + ids[:9]], "entity_id long")
    for depth in (0, 1, 2, 3):
        want = []
        for c in ids:
            seen, front = {c: 0}, [c]
            for hop in range(1, depth + 1):
                front = [b for b in {b for a in front for b in near.get(a, ())} if b not in seen]
                seen |= dict.fromkeys(front, hop)
            want += [(c, n, h) for n, h in seen.items()]
        for hub in (10, 10_000):
            assert sorted(map(str, (tuple(r) for r in graph.k_hop(edges, centres, depth, hub).collect()))) == sorted(map(str, want))
    leaves = graph.k_hop(edges, spark.createDataFrame([(c,) for c in range(1, 60)], "entity_id long"), 2, 10)
    plan = leaves._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" not in plan and leaves.count() == 59 * 63


def test_neighbourhoods_take_little_place_when_written(spark, tmp_path):
    """Each of 1,801 leaves of a hub with all 6,000: the columns repeat themselves within a page, though runs of 1,801 do not end with a byte."""
    edges = spark.range(1, 6001).select(F.lit("hub").alias("source_id"), F.concat(F.lit("leaf"), F.col("id").cast("string")).alias("target_id"))
    centres = edges.limit(1801).select(F.col("target_id").alias("entity_id"))
    graph.k_hop(edges, centres, 2).write.parquet(str(tmp_path / "near"))
    assert spark.read.parquet(str(tmp_path / "near")).agg(F.count("*"), F.count_distinct("centre"), F.count_distinct("node"), F.sum("hops")).first()[:] == (1801 * 6001, 1801, 6001, 1801 * (1 + 2 * 5999))
    assert sum(f.stat().st_size for f in (tmp_path / "near").glob("*.parquet")) < 0.3 * 1801 * 6001
