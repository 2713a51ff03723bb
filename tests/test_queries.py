"""Every query with SQL against DuckDB over the smallest tables; the others against plain Python in test_operators.py."""

import pytest
from compare import connect, differences

from segspark import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, catalog.QUERIES[name], catalog.ORACLE_SQL[name], DATA) is None


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL])
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
