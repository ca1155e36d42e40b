"""License index, filter audit and bounded clustering against brute force on small tables with nulls, ties, repeated and very long rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import drake, filter_audit, license_index, queries

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
TEXTS = [
    (1, "Released under the MIT License. released UNDER-the mit\nlicense"),
    (2, "cc by nc by nc, Apache license; VERSION 2.0"),
    (3, None),
    (4, ""),
    (5, MIT.replace("associated documentation", "related papers").replace("merge", "")),
    (6, MIT.replace("without restriction", "with restriction")),
    (7, "under the mit licenses, under then the mit license K apache"),
    (8, "word " * 200_000 + "under the mit license"),
    (8, "word " * 200_000 + "under the mit license"),
    (None, "cc by nc"),
    (9, "ünder the mit license é under the mit licenseé"),
    (10, "Licensed under the GNU General Public License, version 3; gnu general public license version 2"),
]


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = lambda p, i: words[i : i + len(p)] == p
    return len(words), sorted((x.label, i) for x in license_index.WORDINGS if x.base for i in range(len(words)) if at(x.words, i))


def test_license_places(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("words", "places", "n_words", "w", "t")})
    got = license_index.license_scan(docs).collect()
    assert len(got) == len(TEXTS)
    want = Counter((i, *map(str, plain_scan(t))) for i, t in TEXTS)
    assert Counter((r.doc_id, str(r.n_words), str(sorted((p.label, p.start) for p in r.places if p.base))) for r in got) == want
    more = {r.doc_id: {p.label for p in r.places if not p.base} for r in got if r.doc_id is not None}
    # an edited copy with its key phrases is one, a copy without one of them is not
    assert more == {i: set() for i in range(1, 10)} | {5: {"mit"}, 10: {"gpl-3"}}
    assert 0.5 < next(p.score for r in got if r.doc_id == 5 for p in r.places) < 1
    assert all(p.score == 1 for r in got for p in r.places if p.base)
    assert license_index.license_scan(docs.limit(0)).count() == 0


def test_license_words_of_other_alphabets_stand(spark):
    df = spark.createDataFrame([("É\x00aB\x7fc_d-e9İ",)], "t string").select(license_index.license_words(F.col("t")).alias("w"))
    assert len(df.first().w) == 5


DOCS = [
    (1, "Copy me # now", "a"), (2, "Copy me # now", "b"), (3, "Copy me # now", None), (3, "Copy me # now", None), (None, "Copy me # now", "a"), (4, None, "a"), (5, "", "a"), (6, " \t", ""), (7, "ABC def " * 150, "b"), (8, " ".join(f"w{i}" for i in range(300)), "a"),
    (9, " ".join(f"w{i}" for i in range(300)), "b"), (10, "x " * 300_000, "b"), (11, "É é" * 100, "a"), (12, "A" + "b" * 49, "b"), (13, "A" + "b" * 48, "b"), (14, "a b " * 100 + "c", "a"), (0, "Copy me # now", "b"), (0, "other", "b"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, None, 1), (8, 1, 0), (9, 1, 1), (None, 1, 1), (99, 1, 1), (7, 0, 1)]


def plain_audit(docs, labels):
    fails = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in docs)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": smaller}
        fails.append((part or "", {k for k, v in f.items() if v}, any(q == 1 for j, q, _ in labels if j == i and i is not None), any(x == 1 for j, _, x in labels if j == i and i is not None)))
    out, shapley = [], Counter()
    for part in {f[0] for f in fails}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [f for f in fails if f[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                now = [f for f in left if x in f[1]]
                redundant = sum(x in f[1] for f in gone)
                left, gone = [f for f in left if x not in f[1]], gone + now
                shapley[part, x] += len(now)
                out.append((part, order, step, len(left), len(now), redundant, sum(f[0] == part and f[1] == {x} for f in fails), sum(f[2] for f in now), sum(f[3] for f in now)))
    return Counter((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_audit(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string").withColumns({c: F.lit("mine") for c in ("part", "mask", "id", "digest", "first", "cells", "quality", "w", "t")})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("mask", F.lit("mine"))
    got = filter_audit.filter_audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert Counter(tuple(r) for r in got.collect()) == plain_audit(DOCS, LABELS)
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    bare = filter_audit.filter_audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(bare) == (0, 0)


def plain_means(rows, clusters, rounds):
    """rows: (id, integer vector)."""
    known = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in rows)[:clusters]
    c = [list(v) for _, _, v in known]
    apart = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    for i in range(rounds + 1):
        own = [min(range(len(c)), key=lambda k: (apart(v, c[k]), k)) for _, v in rows]
        if i == rounds:
            break
        for k in range(len(c)):
            members = [v for (_, v), o in zip(rows, own, strict=True) if o == k]
            if members:
                c[k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    d = [apart(v, c[o]) for (_, v), o in zip(rows, own, strict=True)]
    each = Counter()
    for o, x in zip(own, d, strict=True):
        each[o] += x
    return Counter((i, o, x, each[o], sum(d), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for (i, _), o, x in zip(rows, own, d, strict=True))


def vectors(kind, n=300, width=64):
    rng = np.random.default_rng(5)
    if kind == "clusters":
        return (rng.normal(size=(12, width)) * 3)[rng.integers(0, 12, n)] + rng.normal(size=(n, width)) * 0.05
    if kind == "ties":
        return rng.integers(-1, 2, (n, width)) * (np.arange(width) < 3) / 4
    if kind == "equal":
        return np.ones((n, width))
    return rng.normal(size=(n, width)) * (10_000_000.0 / 64 if kind == "large" else 0.2)


@pytest.mark.parametrize("kind", ["clusters", "ties", "equal", "noise", "large"])
@pytest.mark.parametrize("clusters", [16, 5, 1])
def test_bounded_means_equal_plain_ones(spark, kind, clusters):
    x = vectors(kind)
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)] + [(7, list(map(float, x[0]))), (None, list(map(float, x[1])))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in ("cluster", "v", "distance", "near")}).repartition(5)
    found = drake.drake_means(drake.fixed_point(df), clusters, 3)
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found.collect()) == plain_means([(i, [math.floor(64 * c) for c in v]) for i, v in rows], clusters, 3)
    if kind == "clusters" and clusters == 16:
        # most rows are settled by their bounds
        assert found.agg(F.avg("looked")).first()[0] < 0.6 * clusters * 4


def test_vectors_that_do_not_count(spark):
    good = [0.5] * 64
    rows = [(1, good), (2, good[:-1]), (3, None), (4, [*good[:-1], None]), (5, [*good[:-1], float("nan")]), (6, [*good[:-1], float("-inf")]), (7, [*good[:-1], -0.001]), (8, [*good[:-1], 1e30]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept = {r.vec_id: r.v for r in drake.fixed_point(df).collect()}
    assert set(kept) == {1, 7} and kept[1] == [32] * 64 and kept[7][-1] == -1
    assert len(drake.drake_means(drake.fixed_point(df), 16, 3).collect()) == 2
    none = drake.drake_means(drake.fixed_point(df.limit(0)), 16, 3)
    assert none.count() == 0 and none.columns == drake.drake_means(drake.fixed_point(df), 16, 3).columns


def test_contract_columns(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op11_license_index(spark, str(tmp_path)).collect()}
    assert tuple(rows[1])[1:] == (10, 2, 1, 6, "mit", "mit", 1.0)
    assert tuple(rows[4])[1:] == (0, 0, None, None, "", "", 0.0)
    assert rows[2].base_labels == "apache-2,cc-by-nc" and rows[2].n_base == 2
