"""Every query with SQL against DuckDB, and every other runs."""

import pytest
from causeway.plans import knowledge, learning, more, problems, records, texts, typed
from compare import assert_same
from conftest import DATA

PARTS = (problems, records, knowledge, learning, texts, more, typed)
QUERIES = {k: f for p in PARTS for k, f in p.queries().items()}
SQL = {k: q for p in PARTS for k, q in p.oracle_sql().items()}


@pytest.mark.parametrize("name", list(SQL))
def test_against_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, DATA), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns
    df.count()
