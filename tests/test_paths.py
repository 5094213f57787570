"""Every oracle query gives the same answer on the production paths:
the materialised parquet table and a parse of real text files."""

import pytest

import __spark_entry__ as E
from logscope.operators.parse import requests_table
from logscope.plans import catalog
from logscope.plans.compare import compare, duckdb_views
from logscope.sources.logs import load_log_lines, read_log_text
from logscope.operators.parse import parse_log
from logscope.sources.sinks import materialize_parsed, materialize_requests, read_requests
from tests.conftest import SF_SMALL

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duckdb_views(SF_SMALL)


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("paths")
    load_log_lines(spark, SF_SMALL).write.text(str(base / "lines"))
    materialize_requests(catalog.R(spark, SF_SMALL), str(base / "requests"))
    materialize_parsed(parse_log(read_log_text(spark, str(base / "lines"))), str(base / "parsed"))
    return {"parquet": read_requests(spark, str(base / "requests")),
            "text": requests_table(read_log_text(spark, str(base / "lines"))),
            "parsed": read_requests(spark, str(base / "parsed"))}


@pytest.mark.parametrize("path", ["parquet", "text", "parsed"])
def test_all_oracles_on_path(spark, con, sources, path):
    if path == "parsed":
        catalog.use_materialized_parsed(spark, SF_SMALL, sources[path])
    else:
        catalog.use_materialized(spark, SF_SMALL, sources[path])
    try:
        bad = {}
        for name, sql in sorted(ORACLE.items()):
            why = compare(E.queries()[name](spark, SF_SMALL), con, sql)
            if why:
                bad[name] = why
    finally:
        catalog.use_materialized_parsed(spark, SF_SMALL, None)
    assert bad == {}
