"""Similarity joins around pivots and the memory operators on them, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import ingest, memory, near


def side(spark, x, keys=None, start=0):
    rows = [(start + i, [float(c) for c in v], int(keys[i]) if keys is not None else 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>, owner long").repartition(5)


def all_pairs(x, y, similar, kx=None, ky=None):
    u, w = (z / np.linalg.norm(z, axis=1)[:, None] for z in (x, y))
    s = u @ w.T
    same = np.ones_like(s, bool) if kx is None else np.asarray(kx)[:, None] == np.asarray(ky)[None]
    return {(int(a), int(b)) for a, b in zip(*np.nonzero((s > similar) & same), strict=True)}


def clustered(n, centres=60, width=24, spread=0.08, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, width))
    return c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, width))


@pytest.mark.parametrize("similar", [0.95, 0.5, -0.2])
def test_pairs_of_one_table(spark, similar):
    x = clustered(400)
    keys = np.arange(400) % 3
    df = side(spark, x, keys)
    pairs, _ = near.near_join(df, df, ["owner"], similar, itself=True)
    got = [(r.left_id, r.right_id) for r in pairs.collect()]
    want = {p for p in all_pairs(x, x, similar, keys, keys) if p[0] < p[1]}
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_of_two_tables_and_what_was_compared(spark):
    x, y = clustered(1500, seed=0), clustered(2500, seed=0)[1000:]
    pairs, compared = near.near_join(side(spark, x), side(spark, y, start=10_000), ["owner"], 0.95)
    got = [(r.left_id, r.right_id - 10_000) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(x, y, 0.95)
    assert compared.first().n < 0.1 * len(x) * len(y)


def test_large_groups_meet_tile_by_tile(spark, monkeypatch):
    monkeypatch.setattr(near, "TILE", 40)
    x = np.ones((300, 6)) + 0.01 * np.random.default_rng(2).normal(size=(300, 6))
    df = side(spark, x)
    pairs, compared = near.near_join(df, df, ["owner"], 0.999, itself=True)
    got = [(r.left_id, r.right_id) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == {p for p in all_pairs(x, x, 0.999) if p[0] < p[1]}


def test_a_wide_reach_takes_fewer_pivots(spark, monkeypatch):
    """Random directions and a reach over half the sphere: a row would have a place in nearly every cell."""
    x = np.random.default_rng(3).normal(size=(1000, 32))
    df, placed, made = side(spark, x), near._placed, []

    def kept(rows, pivots, *more, **options):
        out = placed(rows, pivots, *more, **options)
        if more[1] is not None and not options:
            made.append(out.count())
        return out

    monkeypatch.setattr(near, "_placed", kept)
    pairs, _ = near.near_join(df, df, ["owner"], 0.35, itself=True)
    got = [(r.left_id, r.right_id) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == {p for p in all_pairs(x, x, 0.35) if p[0] < p[1]}
    assert made[0] <= near.COPIES * 1000


def test_pairs_leave_a_task_in_batches(spark, monkeypatch):
    monkeypatch.setattr(near, "BATCH", 100)
    x = np.ones((200, 4)) + 0.001 * np.random.default_rng(4).normal(size=(200, 4))
    df = side(spark, x)
    assert near.near_join(df, df, ["owner"], 0.9, itself=True)[0].distinct().count() == 200 * 199 // 2


def test_rows_without_pairs(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [1.0, 0.1], None), (5, [1.0, 0.1], 1)], "id long, v array<double>, owner long")
    assert [(r.left_id, r.right_id) for r in near.near_join(df, df, ["owner"], 0.9, itself=True)[0].collect()] == [(1, 5)]
    assert near.near_join(df.limit(0), df, ["owner"], 0.9)[0].count() == 0 and near.near_join(df, df.limit(0), ["owner"], 0.9)[0].count() == 0


def test_classes_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(near, "TILE", 10)
    df = side(spark, np.repeat(np.eye(4), [50, 1, 30, 2], axis=0), np.arange(83) % 2)
    got = {r.id: r.representative for r in near.classes(df, ["owner"]).collect()}
    first = {}
    for i, (v, k) in enumerate(zip(np.repeat(np.arange(4), [50, 1, 30, 2]), np.arange(83) % 2, strict=True)):
        assert got[i] == first.setdefault((v, k), i)


def store(spark, vectors, **more):
    rows = [(i, [float(c) for c in v], 1, "t", "u", f"text {i}", "/", None) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "memory_id long, embedding array<double>, status int, tenant_id string, user_id string, content string, scope string, expires_at long").withColumns({"content_hash": F.sha2(F.col("content").cast("binary"), 256), "created_at": F.col("memory_id")})


def test_a_chain_keeps_its_ends(spark):
    """0-1 and 1-2 are near, 0-2 are not: 0 takes up 1, 2 stays. Three rows alike are one."""
    angle = np.radians([0, 20, 40, 180, 180, 180])
    rows = store(spark, np.stack([np.cos(angle), np.sin(angle)], axis=1))
    out, report = memory.consolidated(rows, F.lit(0), lambda d: d.withColumn("merge", F.lit(True)).withColumn("content", F.concat_ws("+", "a", "b")))
    assert {r.memory_id: (r.status, r.content) for r in out.collect()} == {0: (1, "0+1"), 1: (0, "text 1"), 2: (1, "text 2"), 3: (1, "3+5"), 4: (0, "text 4"), 5: (0, "text 5")}
    assert tuple(report.first()) == (0, 3, 0)
    again = {r.memory_id: r.content_hash for r in out.collect()}
    import hashlib

    assert again[0] == hashlib.sha256(b"0+1").hexdigest()


def test_each_copy_has_its_own_decisions(spark):
    """Rows with one embedding are near to what any of them is near to, and a pair's decision is not that of another pair."""
    angle = np.radians([90, 0, 0, 90, 110, 20, 20, 0, 35, 35])
    rows = store(spark, np.stack([np.cos(angle), np.sin(angle)], axis=1))
    decide = lambda d: d.withColumn("merge", (F.col("a") + F.col("b")) % 3 != 0)
    out, report = memory.consolidated(rows, F.lit(0), decide, similar=0.9)
    gone = set()
    for a in range(len(angle)):
        for b in range(a + 1, len(angle)):
            if np.cos(angle[a] - angle[b]) > 0.9 and (a + b) % 3 and a not in gone and b not in gone:
                gone.add(b)
    assert {r.memory_id for r in out.where("status = 0").collect()} == gone and tuple(report.first()) == (0, len(gone), 0)


def test_merges_equal_one_by_one_visits(spark):
    rng = np.random.default_rng(7)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (120, 2)) if a < b})
    gone, want = set(), set()
    for a, b in pairs:
        if a not in gone and b not in gone:
            gone.add(b)
            want.add((a, b))
    got = {(r.a, r.b) for r in memory.merged_into(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want
    long = [(i, i + 1) for i in range(9)]
    assert {(r.a, r.b) for r in memory.merged_into(spark.createDataFrame(long, "a long, b long")).collect()} == {(i, i + 1) for i in range(0, 9, 2)}


def test_a_row_is_taken_up_by_the_first_that_stays(spark):
    """3 is settled a round after 4, and takes up 5 before 4 does."""
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 5), (4, 5)], "a long, b long")
    assert {(r.a, r.b) for r in memory.merged_into(pairs).collect()} == {(1, 2), (3, 5)}


def test_without_a_decision_nothing_is_merged(spark):
    out, report = memory.consolidated(store(spark, np.ones((3, 2))), F.lit(0))
    assert out.where("status = 1").count() == 3 and tuple(report.first()) == (0, 0, 0)


def test_copies_of_one_content_do_not_meet(spark):
    """Neither operator joins rows by their content: no join of its plan has the hash of all rows as a key."""
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "x").otherwise(F.col("id").cast("string")).alias("content_hash"), F.lit("s").alias("scope"))
    existing = spark.createDataFrame([("x", "s", 0), ("4000", "s", 1), ("4001", "s", 0)], "content_hash string, scope string, deleted_flag int")
    got = ingest.split_duplicates(rows, existing, ["scope"], "doc_id")
    assert got.where("duplicate").count() == 3001 and got.where("duplicate_of_batch").count() == 2999
    kept = memory.without_duplicates(rows.select(F.col("doc_id").alias("memory_id"), "content_hash", "scope", F.lit(1).alias("status"), F.col("doc_id").alias("created_at")))
    assert [r.memory_id for r in kept.where("status = 1 and content_hash = 'x'").collect()] == [2999] and kept.where("status = 0").count() == 2999


def test_a_call_of_remembering(spark):
    """Equal in the scope: gone at once; near: a decision; equal in another scope: seen by the second check; else added."""
    import hashlib

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    schema = "memory_id long, content string, content_hash string, embedding array<double>, tenant_id string, user_id string, scope string, status int"
    row = lambda i, text, angle, scope="/", user="u", status=1: (i, text, digest(text), [float(np.cos(angle)), float(np.sin(angle))], "t", user, scope, status)
    old = spark.createDataFrame([row(1, "one", 0.0), row(2, "two", 2.0), row(3, "three", 4.0, "/a"), row(4, "gone", 5.0, status=0)], schema)
    new = spark.createDataFrame([row(10, "one", 0.0), row(11, "one again", 0.05), row(12, "two more", 2.05), row(13, "three", 1.0), row(14, "new", 3.0), row(15, "new", 3.0), row(16, "gone", 5.0), row(17, "one", 0.0, user="other")], schema)
    decide = lambda d: d.withColumn("action", F.when(F.col("old_id") == 1, "UPDATE").otherwise("DELETE"))
    store, told = memory.remembered(old, new, decide)
    assert {r.memory_id: (r.action, r.old_id) for r in told.collect()} == {11: ("UPDATE", 1), 12: ("DELETE", 2), 13: ("SEEN", None), 14: ("ADD", None), 16: ("ADD", None), 17: ("ADD", None)}
    assert {(r.memory_id, r.content) for r in store.collect()} == {(1, "one again"), (3, "three"), (4, "gone"), (12, "two more"), (14, "new"), (16, "gone"), (17, "one")}
