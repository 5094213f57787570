"""Service and dashboard API: filters and results agree with brute force."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logscope.operators.service import Dashboard, LogService
from logscope.plans.catalog import R
from tests.conftest import SF_SMALL

START, END = "2024-01-05 06:00:00", "2024-01-20 18:30:00"


@pytest.fixture(scope="module")
def r(spark):
    return R(spark, SF_SMALL).cache()


def _window(r, methods=None):
    f = r.where((F.col("time") >= F.lit(START).cast("timestamp_ntz")) & (F.col("time") <= F.lit(END).cast("timestamp_ntz")))
    return f.where(F.col("method").isin(methods)) if methods else f


def test_service_statistics_and_distribution(r):
    svc = LogService(r)
    s = svc.statistics(START, END).collect()[0]
    brute = _window(r)
    assert s["total_requests"] == brute.count()
    assert s["unique_hosts"] == brute.select("host").distinct().count()
    dist = svc.status_distribution(START, END, ["GET"]).collect()
    assert sum(x["count"] for x in dist) == _window(r, ["GET"]).count()


def test_service_top_lists_and_traffic(r):
    svc = LogService(r)
    top = svc.top_endpoints(5, START, END, ["GET", "POST"]).collect()
    counts = {x["endpoint"]: x["count"] for x in _window(r, ["GET", "POST"]).groupBy("endpoint").count().collect()}
    best = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
    assert [(x["endpoint"], x["count"]) for x in top] == best
    hours = svc.traffic_pattern("hourly", START, END).collect()
    assert sum(x["count"] for x in hours) == _window(r).where("time IS NOT NULL").count()
    days = svc.traffic_pattern("daily").collect()
    assert {x["day"] for x in days} <= {"Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"}
    hist, stats = svc.content_size_distribution(START, END, 10)
    assert sum(x["count"] for x in hist.collect()) == _window(r).count()
    assert stats.count() == 1


def test_dashboard_totals_follow_filter(r):
    d = Dashboard(r, dt.date(2024, 1, 3), dt.date(2024, 1, 20), [200, 304, None], ["GET", "HEAD"])
    t = d.totals().collect()[0]
    assert t["total_requests"] == d.raw_rows().count()
    assert sum(x["count"] for x in d.status_distribution().collect()) == t["total_requests"]
    shares = d.method_distribution().collect()
    assert abs(sum(x["percentage"] for x in shares) - 100.0) < 0.05
    assert [x["sort_key"] for x in d.daily_traffic().collect()] == sorted(x["sort_key"] for x in d.daily_traffic().collect())
    dom = [(x["domain"], x["value"]) for x in d.domains().collect()]
    everything = [(x["domain"], x["value"]) for x in Dashboard(r).domains().collect()]
    assert dom == everything  # choices do not narrow with the selection
    assert {"GET", "HEAD", "POST"} <= {v for k, v in dom if k == "method"}
    methods = [v for k, v in dom if k == "method"]
    assert methods == sorted(methods)


def test_rows_without_a_time_never_pass_the_page(r):
    nulls = r.limit(3).withColumn("time", F.lit(None).cast("timestamp_ntz"))
    assert Dashboard(nulls).raw_rows().count() == 0
    assert Dashboard(r.limit(0).unionByName(nulls)).totals().collect()[0]["total_requests"] == 0


def test_bounds_with_a_zone_are_instants(lines_df):
    from logscope.operators.parse import requests_table
    lines = lines_df([f'a.bc - - [05/Jan/2024:{h:02d}:30:00 {z}] "GET /x HTTP/1.0" 200 1'
                      for h in range(24) for z in ("-0400", "-0100", "+0100")])
    svc = LogService(requests_table(lines, instant=True))
    lo = dt.datetime(2024, 1, 5, 6, tzinfo=dt.timezone.utc)
    hi = dt.datetime(2024, 1, 5, 12, tzinfo=dt.timezone(dt.timedelta(hours=2)))
    got = sum(x["count"] for x in svc.method_distribution(lo, hi).collect())
    want = sum(6 <= h + 4.5 <= 10 for h in range(24)) + sum(6 <= h + 1.5 <= 10 for h in range(24))  # the pattern reads no +
    assert got == want
    with pytest.raises(ValueError):
        LogService(requests_table(lines)).method_distribution(lo, hi)


def test_write_result_round_trip(spark, r, tmp_path):
    from logscope import write_result
    out = str(tmp_path / "stats")
    svc = LogService(r)
    write_result(svc.statistics(), out, "json")
    back = spark.read.json(out).collect()[0]
    assert back["total_requests"] == r.count()


def test_persisted_service_matches(r):
    svc = LogService(r, persist=True)
    try:
        assert svc.statistics().collect() == LogService(r).statistics().collect()
    finally:
        svc.close()
