"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from granary.plans import catalog, chunks, keywords, office, operations, queries, statements, vectors  # noqa: F401  register

from .oracle import connect, rows_of_duck, rows_of_spark

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    assert rows_of_spark(catalog.queries()[name](spark, SF)) == rows_of_duck(duck, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.columns and df.count() > 0
