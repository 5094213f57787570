"""Rollups give the rows of the plain queries for any window."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logscope.operators import rollups as RU
from logscope.operators.service import LogService
from logscope.plans.catalog import R
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    r = R(spark, SF_SMALL).cache()
    return LogService(r), RU.Rollups(spark, r, str(tmp_path_factory.mktemp("rollups"))).build()


def rows(df):
    return [tuple(r) for r in df.collect()]


D = dt.datetime
WINDOWS = [(None, None), (D(2024, 1, 5, 6), D(2024, 1, 20, 18, 30)), (D(2024, 1, 5, 6, 0, 1), None), (None, D(2024, 1, 9, 23, 59, 59)),
           (D(2024, 1, 7, 3, 10), D(2024, 1, 7, 3, 50)), (D(2024, 1, 7, 3, 59, 59), D(2024, 1, 7, 4, 0, 0)),
           (D(2024, 1, 9), D(2024, 1, 8)), ("2024-01-11 00:00:00", "2024-01-11 01:59:59.999999")]


@pytest.mark.parametrize("start,end", WINDOWS)
def test_window_queries_equal_the_service(both, start, end):
    plain, rolled = both
    assert rows(rolled.statistics(start, end)) == rows(plain.statistics(start, end))
    assert rows(rolled.host_frequency(7, start, end)) == rows(plain.host_frequency(7, start, end))
    assert rows(rolled.traffic_pattern("hourly", start, end)) == rows(plain.traffic_pattern("hourly", start, end))


def test_all_queries_of_one_window(both):
    plain, rolled = both
    start, end, methods = D(2024, 1, 5, 6, 10), D(2024, 1, 20, 18, 30), ["GET", "POST"]
    assert rows(rolled.status_distribution(start, end, methods)) == rows(plain.status_distribution(start, end, methods))
    assert rows(rolled.top_endpoints(9, start, end, methods)) == rows(plain.top_endpoints(9, start, end, methods))
    assert rows(rolled.method_distribution(start, end)) == rows(plain.method_distribution(start, end))
    assert rows(rolled.traffic_pattern("daily", start, end)) == rows(plain.traffic_pattern("daily", start, end))
    for a, b in zip(rolled.content_size_distribution(start, end), plain.content_size_distribution(start, end)):
        assert rows(a) == rows(b)


def test_decomposition_covers_every_moment_once():
    rng = random.Random(4)
    for _ in range(300):
        start = D(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(9000))
        end = start + dt.timedelta(seconds=rng.randrange(12000)) - dt.timedelta(seconds=rng.choice([0, 3600]))
        first, after, cut = RU.parts(start, end)
        for second in range(0, 24000, 7):
            t = D(2024, 1, 1) + dt.timedelta(seconds=second)
            hits = (first <= t < after) + sum(a <= t <= b for a, b in cut)
            assert hits == (start <= t <= end)
        assert len(cut) <= 2


def test_a_window_reads_two_hours_of_requests(both):
    _, rolled = both
    _, _, cut = RU.parts(D(2024, 1, 5, 6, 10), D(2024, 1, 20, 18, 30))
    pieces = rolled.pieces(cut)
    read = sum(p.count() for p in pieces)
    assert len(pieces) == 2 and read < rolled.requests.count() / 100
    hours = {(r["date"], r["hour"]) for p in pieces for r in p.select(F.to_date("time").alias("date"), F.hour("time").alias("hour")).collect()}
    assert hours <= {(dt.date(2024, 1, 5), 6), (dt.date(2024, 1, 20), 18)}


def test_whole_hours_prune_dates(both):
    text = both[1].whole("classes", D(2024, 1, 5, 6), D(2024, 1, 7, 2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "2024-01-05" in text and "2024-01-07" in text


def test_dictionary_is_dense(spark):
    df = spark.createDataFrame([(f"v{i % 137}",) for i in range(1000)] + [(None,), ("",)], "c string").repartition(7)
    ids = sorted(r["id"] for r in RU.dictionary(df, "c").collect())
    assert ids == list(range(138))
    assert RU.dictionary(df.limit(0), "c").count() == 0


def test_bitmaps_over_many_buckets(spark):
    df = spark.range(100_000).select(F.concat(F.lit("h"), F.col("id") % 70_000).alias("c"), (F.col("id") % 3).alias("k"))
    bits = RU.bitmaps(df, RU.dictionary(df, "c"), "c", F.col("k"))
    got = {r["k"]: r["n"] for r in RU.distinct_of(bits, "k").collect()}
    assert got == {r["k"]: r["n"] for r in df.groupBy("k").agg(F.countDistinct("c").alias("n")).collect()}
    assert bits.select("bucket").distinct().count() == 3


def test_refresh_changes_only_its_dates(spark, tmp_path):
    r = R(spark, SF_SMALL)
    half = r.where("hour(time) < 12")
    rolled = RU.Rollups(spark, half, str(tmp_path)).build(RU.COUNTS)
    late = dt.date(2024, 1, 9)
    rolled.requests = r
    rolled.refresh([late])
    got = {x["date"]: x["n"] for x in rolled.table("classes").groupBy("date").agg(F.sum("n").alias("n")).collect()}
    n = lambda df, d: df.where(F.to_date("time") == F.lit(d)).count()
    assert got[late] == n(r, late) and got[dt.date(2024, 1, 10)] == n(half, dt.date(2024, 1, 10))


def test_bounds_with_a_zone_are_refused(both):
    with pytest.raises(ValueError):
        both[1].statistics(D(2024, 1, 5, tzinfo=dt.timezone.utc))
    with pytest.raises(ValueError):
        both[1].unique_by_weekday_range("host_sets", 404, 500, "n")
