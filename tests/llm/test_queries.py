"""The registered queries on the smallest tables: against their SQL, and the pipeline against its parts."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from granary.llm import queries
from tests.oracle import connect, rows_of_duck, rows_of_spark

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_all_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert rows_of_spark(queries.queries()[name](spark, SF)) == rows_of_duck(connect(SF), queries.oracle_sql()[name])


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_next = stage(spark, docs, SF)
        assert docs_next.columns == docs.columns
        docs = spark.createDataFrame(docs_next.toPandas(), docs.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    last = {(r.doc_id, r.text, r.copies) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert {(r.doc_id, r.text, r.copies) for r in corpus_pipeline.run(spark, SF).collect()} == last
