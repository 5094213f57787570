"""Physical-plan checks on the materialised request table."""

import pytest

from logscope.operators import breakdowns as BD
from logscope.operators import distributions as DS
from logscope.operators import features as FT
from logscope.operators import filters as FL
from logscope.operators.service import LogService
from logscope.plans import catalog
from logscope.sources.sinks import materialize_requests, read_requests
from tests.conftest import SF_SMALL


def plan(df) -> str:
    df.collect()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def mat(spark, tmp_path_factory):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    path = str(tmp_path_factory.mktemp("requests"))
    materialize_requests(catalog.R(spark, SF_SMALL), path)
    return read_requests(spark, path)


def test_materialised_table_round_trips(spark, mat):
    a = catalog.rows(catalog.R(spark, SF_SMALL)).exceptAll(catalog.rows(mat)).count()
    assert a == 0 and mat.count() == catalog.R(spark, SF_SMALL).count()


def test_page_filter_prunes_partitions_and_pushes_filters(mat):
    df = FL.filter_page(mat, "2024-01-03", "2024-01-05", [200, None], ["GET"])
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in p
    assert "EqualTo(method,GET)" in p
    assert "GreaterThanOrEqual(time," in p


def test_top_k_reads_one_column(mat):
    p = DS.top_endpoints(mat)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<endpoint:string>" in p
    assert "TakeOrderedAndProject" in p


def test_fused_hourly_counts_single_shuffle(mat):
    p = plan(BD.hourly_status_counts(mat))
    assert p.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("op", [BD.top5_host_weekday, BD.top5_host_hour])
def test_one_scan_and_one_hash_shuffle(mat, op):
    p = plan(op(mat))
    assert p.count("FileScan parquet") == 1 and p.count("Exchange hashpartitioning") <= 1
    assert "Join" not in p and "Expand" not in p


def test_domains_read_the_requests_once_and_gather_no_set(mat):
    p = plan(FL.filter_domains(mat))  # the one pass over the requests ends in the checkpoint
    assert p.count("FileScan parquet") == 0 and "Scan ExistingRDD" in p
    assert "collect_set" not in p and "Join" not in p and "Expand" not in p


def test_host_features_need_no_expand(mat):
    assert "Expand" not in plan(FT.host_features(mat))


def test_service_size_call_reads_the_requests_once(spark, mat):
    histogram, stats = LogService(mat).content_size_distribution()
    for df in (histogram, stats):
        assert "FileScan" not in plan(df)  # both read the checkpointed counts


@pytest.mark.parametrize("name", ["status_distribution", "top_endpoints", "size_histogram", "unique_hosts_4xx",
                                  "host_features_derived", "traffic_forecast", "statistics"])
def test_no_python_in_sql_operators(spark, name):
    p = catalog.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in p
