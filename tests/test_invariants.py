"""Cross-checks between operators and against brute force on fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logscope.operators import breakdowns as BD
from logscope.operators import daily as DY
from logscope.operators import distributions as DS
from logscope.operators import features as FT
from logscope.operators import filters as FL
from logscope.operators import sizes as SZ
from logscope.operators import traffic as TR
from logscope.operators.parse import requests_table
from logscope.plans.catalog import R
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def r(spark):
    return R(spark, SF_SMALL).cache()


def _line(host="h1.example.com", ts="01/Jul/1995:10:00:00", req="GET /a HTTP/1.0", status="200", size="10"):
    return f'{host} - - [{ts} -0400] "{req}" {status} {size}'


def test_class_counts_sum_to_total(r):
    total = r.count()
    assert sum(x["count"] for x in DS.status_distribution(r).collect()) == total
    assert sum(x["count"] for x in DS.status_freq(r).collect()) == total


def test_histogram_counts_sum_to_rows(r):
    h = SZ.size_histogram(r).collect()
    assert len(h) == 50 and sum(x["count"] for x in h) == r.count()


def test_histogram_matches_numpy(r):
    sizes = np.array([x["content_size"] for x in r.select("content_size").collect()], dtype=float) / 1024.0
    counts, edges = np.histogram(sizes, bins=50)
    got = SZ.size_histogram(r).collect()
    assert [x["count"] for x in got] == counts.tolist()
    assert [x["bin_start"] for x in got] == edges[:-1].tolist()
    assert [x["bin_end"] for x in got] == edges[1:].tolist()


@pytest.mark.parametrize("values,bins", [([5, 5], 2), ([], 2), ([0, 2, 4, 10], 5), ([1, 7, 7, 3, 100, 55], 7)])
def test_histogram_edge_rules(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values], "content_size int")
    got = SZ.size_histogram(df, bins=bins, scale=1.0).collect()
    counts, edges = np.histogram(np.array(values, dtype=float), bins=bins)
    assert [x["count"] for x in got] == counts.tolist()
    assert [x["bin_start"] for x in got] + [got[-1]["bin_end"]] == edges.tolist()


def test_constant_histogram_edges(spark):
    df = spark.createDataFrame([(5,), (5,)], "content_size int")
    got = SZ.size_histogram(df, bins=2, scale=1.0).collect()
    assert [(x["bin_start"], x["bin_end"], x["count"]) for x in got] == [(4.5, 5.0, 0), (5.0, 5.5, 2)]


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 2), (3, 1001), (4, 4000)])
def test_exact_median_matches_numpy(spark, seed, n):
    rng = np.random.default_rng(seed)
    vals = rng.integers(0, 300_000, n)
    vals[: n // 3] = 777  # a value holding a third of all rows
    df = spark.createDataFrame([(int(v),) for v in vals], "content_size int")
    got = SZ.exact_median(df, "content_size").collect()[0]["median"]
    assert got == float(np.median(vals))


def test_exact_median_empty(spark):
    df = spark.createDataFrame([], "content_size int")
    assert SZ.exact_median(df, "content_size").collect()[0]["median"] is None


def test_pivot_equals_long_form(r):
    piv = {x["hour"]: x for x in BD.hourly_method_pivot(r).collect()}
    long = BD.hourly_method_counts(r).where(F.col("method").isin("GET", "HEAD", "POST")).collect()
    for x in long:
        assert piv[x["hour"]][x["method"]] == x["count"]
    assert sum(piv[h][m] for h in piv for m in ["GET", "HEAD", "POST"]) == sum(x["count"] for x in long)


def test_single_pass_equals_per_class(r):
    wide = {x["hour"]: x for x in BD.hourly_status_counts(r).collect()}
    for lab, lo, hi in [("2xx", 200, 300), ("3xx", 300, 400), ("4xx", 400, 500)]:
        per = r.where((F.col("status") >= lo) & (F.col("status") < hi)).groupBy(F.hour("time").alias("h")).count()
        for x in per.collect():
            assert wide[x["h"]][f"count_{lab}"] == x["count"]
    totals = {x["metric"]: x["count"] for x in BD.status_method_totals(r).collect()}
    assert totals["GET"] == r.where(F.col("method") == "GET").count()
    assert totals["4xx"] == r.where((F.col("status") >= 400) & (F.col("status") < 500)).count()


def test_hour_zero_has_no_range(lines_df):
    df = requests_table(lines_df([_line(ts="03/Jul/1995:00:10:00"), _line(ts="03/Jul/1995:01:10:00")]))
    got = BD.unique_endpoints_by_status(df, 200, 300).collect()
    assert [(x["weekday"], x["hour_range"], x["unique_endpoints"]) for x in got] == [("Mon", "1-3", 1)]


def test_top_k_ties_break_by_key(lines_df):
    lines = [_line(req=f"GET /{e} HTTP/1.0") for e in ["b", "a", "c", "c"]]
    got = DS.top_endpoints(requests_table(lines_df(lines)), 2).collect()
    assert [(x["endpoint"], x["count"]) for x in got] == [("/c", 2), ("/a", 1)]


def test_empty_filter_result(r):
    f = FL.filter_time_methods(r, "1990-01-01 00:00:00", "1990-01-02 00:00:00")
    assert f.count() == 0
    s = TR.statistics(f).collect()[0]
    assert s["total_requests"] == 0 and s["success_rate"] is None


def test_page_filter_null_status(lines_df):
    df = requests_table(lines_df([_line(status="-"), _line(status="200"), _line(status="404")]))
    assert FL.filter_page(df, statuses=[200, None]).count() == 2
    assert FL.filter_page(df, statuses=[200]).count() == 1


def test_single_request_host_has_null_std(lines_df):
    df = requests_table(lines_df([_line(host="one.host.com"), _line(), _line(size="30")]))
    f = {x["host"]: x for x in FT.host_features(df).collect()}
    assert f["one.host.com"]["std_content_size"] is None
    assert FT.ml_ready(FT.host_features_derived(df)).where("host = 'one.host.com'").collect()[0][
        "std_content_size"] == 0.0


def test_same_day_number_of_two_months_is_one_day(lines_df):
    df = requests_table(lines_df([_line(ts="05/Jul/1995:10:00:00"), _line(ts="05/Aug/1995:10:00:00", host="b.bb.com")]))
    got = DY.avg_daily_requests_per_host(df).collect()
    assert [(x["day"], x["total_reqs"], x["total_hosts"], x["avg_reqs"]) for x in got] == [(5, 2, 2, 1.0)]


def test_weekday_order_monday_first(r):
    got = [x["sort_key"] for x in TR.weekday_traffic(r).collect()]
    assert got == sorted(got)


def test_scaled_features_are_standardised(r):
    z = FT.host_features_scaled(r)
    st = z.agg(*[F.avg(c).alias(c) for c in z.columns if c.startswith("z_")]).collect()[0]
    for v in st:
        assert abs(v) < 1e-5


def test_time_filter_independent_of_session_zone(spark, lines_df):
    df = requests_table(lines_df([_line(ts="01/Jul/1995:10:00:00"), _line(ts="01/Jul/1995:12:00:00")]))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ny = FL.filter_time_methods(df, "1995-07-01 09:30:00", "1995-07-01 10:30:00").count()
        ny_page = FL.filter_page(df, "1995-07-01", "1995-07-01").count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert ny == 1 and ny_page == 2
    assert FL.filter_time_methods(df, "1995-07-01 09:30:00", "1995-07-01 10:30:00").count() == 1


def test_top_host_activity_keeps_null_host(spark):
    rows = [(None, 1)] * 5 + [("a.bb.com", 1)] * 2
    df = spark.createDataFrame(rows, "host string, n int").selectExpr(
        "host", "CAST('2024-01-01 10:00:00' AS TIMESTAMP_NTZ) AS time")
    got = {(x["host"], x["count"]) for x in BD.top5_host_hour(df).collect()}
    assert got == {(None, 5), ("a.bb.com", 2)}


@pytest.mark.parametrize("op", [
    DS.status_distribution, DS.method_share, lambda d: DS.top_hosts_share(d, 20), DS.top_endpoints,
    BD.hourly_status_counts, BD.hourly_method_pivot, BD.status_method_totals, BD.top5_host_weekday,
    lambda d: BD.unique_endpoints_by_status(d, 200, 300), DY.avg_daily_requests_per_host, DY.unique_hosts,
    SZ.size_histogram, SZ.size_stats_kb, SZ.size_histogram_nice, SZ.content_size_summary,
    TR.statistics, TR.weekday_traffic, FT.host_features_derived, FL.filter_domains,
])
def test_empty_input_does_not_fail(r, op):
    empty = r.limit(0)
    op(empty).collect()


def test_empty_forecast(r):
    from logscope.operators import forecast as FC
    assert FC.traffic_forecast(r.limit(0)).collect() == []
