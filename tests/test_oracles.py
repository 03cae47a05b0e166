"""Every registered query against its DuckDB oracle (row count, columns and
an order-insensitive hash of full-precision values)."""

import pytest

from tests.conftest import SF_SMALL

import __spark_entry__ as E
from tools.check_oracles import compare, duckdb_for

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb_for(SF_SMALL)
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF_SMALL), con, ORACLES[name])
    spark.catalog.clearCache()
    assert ok, f"{name}: {msg}"


def test_every_query_has_docstring_and_runs_entry(spark):
    for name, fn in QUERIES.items():
        assert fn.__doc__, name
    df = E.entry(spark)
    assert set(df.columns) >= {"segment", "customers", "revenue"}
    assert df.count() >= 0
