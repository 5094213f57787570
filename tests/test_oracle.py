"""Every registered query with an oracle matches DuckDB at sf0.001."""

import pytest

import __spark_entry__ as E
from logscope.plans.compare import compare, duckdb_views
from tests.conftest import SF_SMALL

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duckdb_views(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert compare(df, con, ORACLE[name]) == []


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["endpoint", "count"]
    assert len(df.collect()) > 0
