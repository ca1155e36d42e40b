"""Words of texts without spaces: what is learnt, the best cut against all cuts, and an index of words."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from granary.operators import postings, segment

WORDS = ["中国", "人民", "银行", "的", "在", "北京", "大学", "学生", "研究所", "和", "上海", "图书馆"]


def texts(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(WORDS, k=rng.randint(4, 12))) + rng.choice(["", "。ok ", " "]) + "".join(rng.choices(WORDS, k=3)) for _ in range(n)]


def cuts(run, longest):
    if not run:
        return [[]]
    return [[run[:i], *rest] for i in range(1, min(longest, len(run)) + 1) for rest in cuts(run[i:], longest)]


def test_words_are_learnt_and_cut(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())] + [(1000, None), (1001, ""), (1002, "no ideographs")], "doc_id long, text string").repartition(3)
    lexicon = segment.learnt(docs)
    found = {r.word for r in lexicon.collect()}
    assert {w for w in found if len(w) > 1} == {w for w in WORDS if len(w) > 1} and set("".join(WORDS)) <= found
    got = {r.doc_id: r.text for r in segment.segmented(docs, lexicon).collect()}
    assert got[1000] is None and got[1001] == "" and got[1002] == "no ideographs"
    assert all(set(t.replace("。ok", " ").split()) <= set(WORDS) for i, t in got.items() if i < 400)
    assert segment.learnt(docs.limit(0)).count() == 0


def test_best_cut_is_the_best_of_all_cuts():
    rng = random.Random(3)
    for _ in range(300):
        weights = {"".join(rng.choice("甲乙丙") for _ in range(rng.randint(1, 4))): -float(rng.randint(1, 9)) for _ in range(8)}
        run = "".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 9)))
        unknown = min(weights.values()) - 0.7
        allowed = [c for c in cuts(run, 4) if all(len(w) == 1 or w in weights for w in c)]
        value = lambda c: (round(sum(weights.get(w, unknown) for w in c), 6), -len(c), [len(w) for w in c])  # noqa: B023, E731
        assert segment.best_cut(run, weights, 4, unknown) == max(allowed, key=value)


def test_an_index_of_words(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    lexicon = segment.learnt(docs)
    index = postings.build_postings(segment.segmented(docs, lexicon), analyser=segment.spaced)
    terms = {r.term for r in index.terms.collect()}
    assert "图书馆" in terms and "图" not in terms and "ok" in terms
    q = segment.segmented(spark.createDataFrame([(1, "图书馆")], "query_id long, text string"), lexicon)
    hits = postings.whole_search(index, q, 1000, lambda x: postings.query_terms(x, segment.spaced))
    assert {r.id for r in hits.collect()} == {i for i, t in enumerate(texts()) if "图书馆" in t}
    assert docs.where(F.contains("text", F.lit("图书馆"))).count() == hits.count()
