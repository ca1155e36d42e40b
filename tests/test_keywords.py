"""Stored postings, pruned search and fuzzy terms against plain counting."""

from __future__ import annotations

import math
import random
import re
import shutil
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from granary.operators import fuzzy, postings, retrieve
from granary.operators.index import keyword_index
from granary.operators.tables import join_counted, written
from granary.plans import catalog, operations  # noqa: F401  register the queries


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def plain_bm25(docs, queries, k):
    """docs: {id: text}; queries: {id: {term: boost}}."""
    tf = {i: Counter(words(t)) for i, t in docs.items()}
    df = Counter(w for c in tf.values() for w in c)
    mean = sum(sum(c.values()) for c in tf.values()) / len(docs)
    out = {}
    for q, terms in queries.items():
        s = {i: sum(b * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, b in terms.items() if c[w]) for i, c in tf.items() if any(c[w] for w in terms)}
        out[q] = [i for _, i in sorted((-round(x, 6), i) for i, x in s.items())[:k]]
    return {q: x for q, x in out.items() if x}


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = {i: " ".join(rng.choices(vocabulary, weights, k=rng.randint(5, 80))) for i in range(n)}
    docs |= {n: None, n + 1: "", n + 2: "!?", n + 3: "w300 " * 50_000}
    return docs | {n + 4 + i: docs[7] for i in range(200)}  # copies: equal scores


@pytest.fixture(scope="module")
def built(spark):
    docs = corpus()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(6)
    return docs, df, postings.build_postings(df, size=8)


QUERIES = {1: "w0 w1 w2 w350", 2: "w390 w391 w392", 3: "w0", 4: "absent", 5: "", 6: None, 7: "w0 w0 W5 w20 w77 w200 w301 absent", 8: "w300 w1"}


def found(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    return got


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_pruned_and_whole_searches_equal_plain_ones(spark, built, k):
    docs, df, index = built
    q = spark.createDataFrame(list(QUERIES.items()), "query_id long, text string")
    want = plain_bm25(docs, {i: dict.fromkeys(words(t), 1.0) for i, t in QUERIES.items()}, k)
    assert found(postings.pruned_search(index, q, k)) == want
    assert found(postings.whole_search(index, q, k)) == want
    assert found(retrieve.bm25_search(df, q, k)) == want


def test_a_rare_word_spares_the_frequent_ones(spark, built):
    docs, df, index = built
    asked = written(postings.query_terms(spark.createDataFrame([(1, "w0 w1 w2 w350")], "query_id long, text string")), "asked")
    facts = postings.pruned_scores(index, asked, 3)[1].first()
    assert facts.postings == sum(sum(w in words(t) for t in docs.values()) for w in ("w0", "w1", "w2", "w350"))
    assert facts.blocks_read < 0.6 * facts.blocks and facts.postings_read < 0.6 * facts.postings


def test_blocks_are_small_and_whole(spark, built):
    docs, df, index = built
    rows = index.blocks.select("term", "part", "n", F.size("hits").alias("s"), (F.col("top") == F.array_max(F.transform("hits", lambda h: h["weight"]))).alias("right")).collect()
    assert all(r.n == r.s and r.right for r in rows) and max(r.n for r in rows) < 40
    assert Counter({t.term: t.df for t in index.terms.collect()}) == Counter(w for t in docs.values() for w in set(words(t)))
    lexicon = [r.term for r in index.lexicon.collect()]
    assert sorted(lexicon) == sorted({w for t in docs.values() for w in words(t)})


def shuffled_rows(spark):
    """Rows that stages have written for a shuffle so far."""
    jvm = spark._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}


def test_postings_are_shuffled_once_and_together(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 90}" for j in range(90))) for i in range(3000)], "doc_id long, text string").repartition(4)
    docs = written(docs, "docs")
    before = shuffled_rows(spark)
    index = postings.build_postings(docs)
    moved = sum(n for stage, n in shuffled_rows(spark).items() if stage not in before)
    n = index.terms.agg(F.sum("df")).first()[0]
    assert n > 50_000 and moved < n / 10


@pytest.mark.parametrize("lane", [1, 40, 300])
def test_lanes_and_shares_of_a_task_change_no_block(spark, built, lane, monkeypatch):
    docs, df, index = built
    monkeypatch.setattr(postings, "_WORDS", 500)
    other = postings.build_postings(df, size=8, lane=lane)
    for name in ("terms", "blocks", "lexicon"):
        a, b = (getattr(x, name) for x in (index, other))
        assert a.count() == b.count() and a.exceptAll(b).count() == 0
    assert other.documents == index.documents == len(docs)


def test_ids_may_be_texts(spark):
    docs = {"b": "one two", "a\U0001f600": "two", "a\uffff": "two two three", "c": None}
    index = postings.build_postings(spark.createDataFrame(list(docs.items()), "doc_id string, text string"))
    got = {r.term: [h.id for h in r.hits] for r in index.blocks.collect()}
    assert got == {"one": ["b"], "two": ["a\uffff", "a\U0001f600", "b"], "three": ["a\uffff"]} and index.documents == 4


def test_stored_index_follows_its_table(spark, tmp_path):
    source = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(1, "one two")], "doc_id long, text string").write.parquet(source)
    first = postings.stored_postings(spark, source)
    assert postings.stored_postings(spark, source).path == first.path
    spark.createDataFrame([(2, "three")], "doc_id long, text string").write.mode("append").parquet(source)
    second = postings.stored_postings(spark, source)
    assert second.path != first.path and second.documents == 2 and {r.term for r in second.terms.collect()} == {"one", "two", "three"}


def test_words_are_counted_inside_their_row(spark):
    docs = {1: "b a b. A", 2: "", 3: None, 4: "one", 5: "x y z x"}
    rows = keyword_index(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.term): (r.tf, r.dl) for r in rows.collect()}
    want = {(i, w): (n, len(words(t))) for i, t in docs.items() for w, n in Counter(words(t)).items()}
    assert got == want | {(i, None): (None, len(words(t))) for i, t in docs.items()}


def test_searches_side_by_side_build_one_index(spark, tmp_path, monkeypatch):
    source, made, build = f"{tmp_path}/documents.parquet", [], postings.build_postings
    spark.createDataFrame([(1, "one two")], "doc_id long, text string").write.parquet(source)
    monkeypatch.setattr(postings, "build_postings", lambda *a, **b: made.append(build(*a, **b)) or made[-1])
    with ThreadPoolExecutor(4) as pool:
        paths = set(pool.map(lambda _: postings.stored_postings(spark, source).path, range(4)))
    assert len(paths) == len(made) == 1


def test_a_search_that_comes_alone_builds_no_index(spark, tmp_path):
    for name in ("documents", "benchmark", "embeddings"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    source = f"{tmp_path}/documents.parquet"
    for name in ("composed_search", "detailed_search"):
        alone = catalog.queries()[name](spark, str(tmp_path)).collect()
        assert alone and postings.found_postings(spark, source) is None
    postings.stored_postings(spark, source)
    assert postings.found_postings(spark, source) is not None
    assert sorted(catalog.queries()[name](spark, str(tmp_path)).collect()) == sorted(alone)


def test_texts_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5}") for i in range(60)], "doc_id long, text string").mapInArrow(seen, "doc_id long, text string")
    q = spark.createDataFrame([(1, "w1 w4"), (2, "absent")], "query_id long, text string")
    assert retrieve.bm25_search(docs, q, 5).count() == 5 and read.value == 60


def test_index_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    index = postings.build_postings(docs)
    assert index.documents == 0 and postings.whole_search(index, q).count() == 0 and postings.pruned_search(index, q).count() == 0


def plain_distance(a, b):
    """Edits with swaps of neighbours, between which letters may be edited."""
    big = len(a) + len(b)
    d = {(-1, -1): big}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = big, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = big, j
    last = {}
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            same = a[i - 1] == b[j - 1]
            if same:
                match = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_walks_of_the_dictionary(spark):
    rng = random.Random(4)
    terms = sorted({"".join(rng.choice("abcé\U0010ffff") for _ in range(rng.randint(0, 7))) for _ in range(1500)})
    for word in ("", "ca", "abcé", "bacb", "abcabca", "éa\U0010ffffb", "x"):
        for allowed in (0, 1, 2, 3):
            assert sorted(fuzzy.within(terms, word, allowed)) == [(i, n) for i, t in enumerate(terms) if (n := plain_distance(t, word)) <= allowed]


def test_fuzzy_search(spark, built):
    docs = {1: "quick brown fox", 2: "quikc brwon fxo", 3: "slow green turtle", 4: "browns and quack", 5: None}
    index = postings.build_postings(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    q = spark.createDataFrame([(1, "quick browm"), (2, "zzzzzz"), (3, "tutrle trutle")], "query_id long, text string")
    near = {(r.query_id, r.term): r.boost for r in fuzzy.fuzzy_query_terms(index)(q).collect()}
    want = {(1, "quick"), (1, "quikc"), (1, "quack"), (1, "brown"), (3, "turtle")}
    assert set(near) == want and near[1, "quick"] == 1 and near[1, "brown"] == near[1, "quikc"] == 0.8 and near[3, "turtle"] == pytest.approx(10 / 6)
    terms = {}
    for (i, t), b in near.items():
        terms.setdefault(i, {})[t] = b
    assert found(postings.whole_search(index, q, 10, fuzzy.fuzzy_query_terms(index))) == plain_bm25(docs, terms, 10)
    assert found(postings.pruned_search(index, q, 2, fuzzy.fuzzy_query_terms(index))) == plain_bm25(docs, terms, 2)


def test_hot_keys_stay_where_they_are(spark):
    rows = spark.range(3000).select((F.when(F.col("id") < 1000, 0).otherwise(F.col("id"))).alias("key"), "id")
    keyed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    got = join_counted(rows, keyed, ["key"], "n", hot=100)
    assert got.count() == 3000 and got.where("key = 0 and first = 0 and n = 1000").count() == 1000
