"""Edge cases of all operators and of the pipeline's stages: nulls, empty tables, long texts, repeated rows, clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import contamination, imatch, linedup, mixing, ngram_join, pii_bootstrap, preference, pseudo_lm, quality_fm, toxicity_crf

LONG = "\n".join(f"line {i} with some words w{i % 977} and user{i}@mail.example.com" for i in range(90_000))
ROWS = [
    (1, "one two three four five six", "en", "a", 27),
    (1, "one two three four five six", "en", "a", 27),
    (2, None, None, None, None),
    (None, "text without an id", "en", None, 18),
    (None, None, None, "a", None),
    (3, "", "en", "", 0),
    (4, "one two three four five six", "fr", "b", 27),
    (5, LONG, "en", "b", len(LONG)),
    (6, " \t\n ", "en", "b", 4),
    (7, "😀 ñ \x00 x", "de", None, 7),
]
#: Names that the operators use inside.
CLASHES = ("text_kept", "gone", "did", "fingerprint", "copies", "size", "component_id", "score", "mix_copies", "_band", "range", "own", "row", "band", "whole", "_own", "_row", "sig", "bucket", "key", "n")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return rows.withColumns({c: F.lit(f"mine {c}") for c in CLASHES}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (2, 0, 1, "x"), (4, 0, 1, "x"), (7, 1, 0, "x"), (None, 1, 1, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, score string")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three four five six", "x"), (2, None, "x"), (3, "", "x"), (None, "another item of some words", "x")], "item_id long, text string, score string")


OPERATORS = {
    "decontamination": lambda d, l, b: contamination.contaminated(d, b),
    "toxicity": lambda d, l, b: toxicity_crf.toxicity_scores(d, l),
    "line dedup": lambda d, l, b: linedup.dedup_lines(d),
    "n-gram join": lambda d, l, b: ngram_join.ngram_jaccard_components(d),
    "pseudo-likelihood": lambda d, l, b: pseudo_lm.pseudo_likelihood(d, 16, 8, 100, 4),
    "mixing": lambda d, l, b: mixing.mix(d),
    "quality": lambda d, l, b: quality_fm.quality_scores(d, l),
    "personal data": lambda d, l, b: pii_bootstrap.personal_data(d),
    "fingerprints": lambda d, l, b: imatch.edited_likeness(d),
    "fingerprint column": lambda d, l, b: imatch.imatch(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_edges(spark, docs, labels, benchmark, name):
    run = OPERATORS[name]
    got = run(docs, labels, benchmark).collect()
    if name == "decontamination":
        assert {r.doc_id for r in got} == {1, 4} and sum(r.doc_id == 1 for r in got) == 2
    else:
        assert len(got) == len(ROWS)
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
        # repeated rows are treated alike
        twice = [r for r in got if r.doc_id == 1]
        assert str(twice[0]) == str(twice[1]) or name == "fingerprints" and twice[0].fingerprint == twice[1].fingerprint
    if name in ("line dedup", "mixing", "fingerprint column"):
        # other columns keep their values, whatever their names
        added = set(run(docs.limit(0), labels, benchmark).columns) - set(docs.columns) | {"text_kept", "lines_gone", "emptied", "mix_copies", "fingerprint"}
        for c in set(CLASHES) - ({"text_kept"} if name == "line dedup" else {"mix_copies"} if name == "mixing" else {"fingerprint"}):
            assert c in added or all(r[c] == f"mine {c}" for r in got)
            assert all(r[c] == f"mine {c}" for r in got), c
    empty = run(docs.limit(0), labels.limit(0), benchmark)
    assert empty.count() == 0
    if name in ("toxicity", "quality"):
        assert len(run(docs, labels.limit(0), benchmark).collect()) == len(ROWS)


def test_preference_edges(spark):
    turns = [(1, 0, "user", "hi", "x"), (1, 0, "user", "hi", "x"), (1, 1, "assistant", None, "x"), (None, 0, "user", "q", "x"), (2, None, None, "t", "x"), (2, 1, "assistant", "z " * 500_000, "x"), (3, 0, "user", "hi", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, turns string").withColumn("opening", F.lit("mine")).withColumn("range", F.lit(1))
    got = {(r.chosen_id, r.rejected_id): r for r in preference.preference_format(df, foreign=True).collect()}
    assert set(got) == {(1, 3), (2, 1)}
    assert got[(1, 3)].n_common == 1 and got[(1, 3)].rejected == "" and got[(1, 3)].chosen.count("<|end|>") == 2
    assert len(got[(2, 1)].chosen) > 1_000_000 and got[(2, 1)].rejected == "<|assistant|>\n\n<|end|>\n"
    assert preference.preference_format(df.limit(0), foreign=True).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, docs, labels, benchmark, name, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, str(tmp_path))
    last = name == corpus_pipeline.STAGES[-1][0]
    assert last or got.columns == docs.columns
    rows = got.collect()
    assert len(rows) <= len(ROWS) and {str(r.doc_id) for r in rows} <= {str(r[0]) for r in ROWS}
    for c in CLASHES:
        assert (last and c in ("copies", "mix_copies")) or all(r[c] == f"mine {c}" for r in rows), c
    if name == "line dedup":
        # the later copies of the long text's lines are its own only; nothing but texts without new lines goes
        assert {r.doc_id for r in rows} >= {1, 2, 3, 4, 5, 6, 7, None}
    if name == "n-gram jaccard join":
        assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "5", "6", "7", "None", "None"]
    if name == "benchmark decontamination":
        assert not {1, 4} & {r.doc_id for r in rows} and len(rows) == len(ROWS) - 3
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
