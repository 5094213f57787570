"""Model operators: determinism, size sums, planted outliers, exact forecasts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logscope.operators import anomalies as AN
from logscope.operators import forecast as FC
from logscope.operators import segments as SG
from logscope.plans.catalog import R
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def r(spark):
    return R(spark, SF_SMALL).cache()


def test_host_segments_stable_and_complete(r):
    a = {x["host"]: x["segment"] for x in SG.host_segments(r).collect()}
    b = {x["host"]: x["segment"] for x in SG.host_segments(r).collect()}
    assert a == b
    assert len(a) == r.select("host").distinct().count()
    sizes = SG.segment_evaluation(r).collect()
    assert sum(x["size"] for x in sizes) == len(a)
    assert -1.0 <= sizes[0]["silhouette"] <= 1.0 and sizes[0]["wssse"] >= 0


def test_cluster_separation_is_a_metric(r):
    d = SG.host_cluster_separation(r).collect()
    m = {(x["segment_i"], x["segment_j"]): x["distance"] for x in d}
    for (i, j), v in m.items():
        assert v >= 0 and abs(v - m[(j, i)]) < 1e-12
        if i == j:
            assert v == 0


def test_day_segments_sizes_sum(r):
    days = SG.day_table(r).count()
    assert sum(x["count"] for x in SG.day_segment_sizes(r).collect()) == days
    s = SG.day_summary(r).collect()[0]
    assert s["largest_segment"] <= days and s["total_segments"] <= 4


def test_profile_rule(spark):
    rows = [(d, a, t, h, seg) for d, (a, t, h, seg) in enumerate(
        [(10.0, 100, 10, 0), (1.0, 100, 100, 1), (1.0, 1000, 10, 2), (1.0, 100, 10, 3)], start=1)]
    df = spark.createDataFrame(rows, "day int, avg_reqs double, total_reqs long, total_hosts long, segment int")
    got = {x["segment"]: x["type"] for x in SG.profile_segments(df).collect()}
    assert got == {0: "High Traffic Days", 1: "High User Days", 2: "Peak Activity Days", 3: "Regular Days"}


def test_isolation_forest_finds_planted_outlier(spark):
    rows = [(f"h{i}", float(i % 7), float((i * 3) % 11)) for i in range(400)] + [("far", 500.0, -400.0)]
    df = spark.createDataFrame(rows, "host string, a double, b double")
    out = AN.isolation_forest(df, ["a", "b"], "host", n_trees=50, sample_size=128)
    got = {x["host"]: (x["anomaly_score"], x["label"]) for x in out.collect()}
    assert got["far"][1] == -1
    assert got["far"][0] == max(v[0] for v in got.values())
    share = sum(1 for v in got.values() if v[1] == -1) / len(got)
    assert 0.05 <= share <= 0.15


def test_isolation_forest_equals_a_plain_descent(spark):
    """Scores from the node table, row by row in plain Python, and no node table of a tree is torn."""
    rows = [(f"h{i}", float(i * i % 23), float(i % 5), 7.0) for i in range(90)]
    df = spark.createDataFrame(rows, "host string, a double, b double, c double")
    x = AN._sample(df, "host", 7, 32, 90, 3)
    assert {r["count"] for r in x.groupBy("tree").count().collect()} == {32}
    nodes = {(n["tree"], n["node"]): n for n in AN.grow(x, ["a", "b", "c"], 5, 3).collect()}
    want = {}
    for host, *v in rows:
        total = 0
        for tree in range(7):
            node = 1
            while (tree, node) in nodes and nodes[tree, node]["feature"] is not None:
                n = nodes[tree, node]
                assert n["feature"] != 2  # a constant column is never cut
                node = 2 * node + (v[n["feature"]] >= n["threshold"])
            size = nodes[tree, node]["n"] if (tree, node) in nodes else 0
            total += (node.bit_length() - 1) * AN.MICRO + int(AN.avg_path(size) * AN.MICRO + 0.5)
        want[host] = 2.0 ** (-total / 7 / AN.MICRO / AN.avg_path(32))
    got = AN.isolation_forest(df, ["a", "b", "c"], "host", n_trees=7, sample_size=32, seed=3).collect()
    assert {r["host"]: r["anomaly_score"] for r in got} == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("rows", [[], [("h", 1.0)], [("h", 2.0), (None, None)], [(f"h{i}", 4.0) for i in range(20)]])
def test_isolation_forest_small_and_constant_tables(spark, rows):
    """No row, one row (0.5), a null host and null feature (0), a column that never varies: no host stands out."""
    got = AN.isolation_forest(spark.createDataFrame(rows, "host string, a double"), ["a"], "host", n_trees=5).collect()
    assert sorted(str(r["host"]) for r in got) == sorted(str(h) for h, _ in rows)
    if len(rows) != 2:
        assert all(abs(r["anomaly_score"] - 0.5) < 1e-6 and r["label"] == 1 for r in got)


def test_forecast_recovers_linear_trend(spark):
    d0 = dt.date(2024, 1, 1)
    hist = spark.createDataFrame([(d0 + dt.timedelta(days=i), 10 + 2 * i) for i in range(28)], "ds date, y long")
    got = FC.forecast(hist, periods=3).collect()
    assert [x["ds"] for x in got] == [d0 + dt.timedelta(days=28 + i) for i in range(3)]
    for i, x in enumerate(got):
        assert abs(x["yhat"] - (10 + 2 * (28 + i))) < 1e-6
        assert abs(x["yhat_upper"] - x["yhat"]) < 1e-6


def test_forecast_per_series(spark):
    d0 = dt.date(2024, 1, 1)
    rows = [(k, d0 + dt.timedelta(days=i), (i + 1) * m) for k, m in [("a", 1), ("b", 3)] for i in range(14)]
    hist = spark.createDataFrame(rows, "k string, ds date, y long")
    got = {(x["k"], x["ds"]): x["yhat"] for x in FC.forecast(hist, periods=1, keys=["k"]).collect()}
    assert abs(got[("a", d0 + dt.timedelta(days=14))] - 15) < 1e-6
    assert abs(got[("b", d0 + dt.timedelta(days=14))] - 45) < 1e-6


def test_model_comparison_rows(r):
    got = {x["model"]: x for x in SG.model_comparison(r).collect()}
    assert set(got) == {"kmeans", "bisecting_kmeans", "gaussian_mixture"}
    assert got["kmeans"]["cost"] >= 0 and got["gaussian_mixture"]["cost"] is None


def test_feature_importance_sorted(r):
    imp = [x["importance"] for x in SG.feature_importance(r).collect()]
    assert len(imp) == 7 and imp == sorted(imp, reverse=True)


def test_host_pca_width(r):
    from pyspark.ml.functions import vector_to_array
    widths = SG.host_ml_features(r).select(F.size(vector_to_array("features")).alias("n"),
                                           F.size(vector_to_array("scaled_features")).alias("s")).collect()
    assert {(x["n"], x["s"]) for x in widths} == {(3, 7)}
    assert len(widths) == r.select("host").distinct().count()


def test_segments_do_not_depend_on_the_shuffle_layout(spark, r):
    was, seen = spark.conf.get("spark.sql.shuffle.partitions"), set()
    try:
        for n in (3, 7, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            rows = SG.segment_evaluation(r).collect()
            seen.add((tuple(sorted(x["size"] for x in rows)), round(rows[0]["wssse"], 6)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len(seen) == 1


def test_train_and_analyze(r):
    out = SG.train_and_analyze(r)
    assert sum(x["size"] for x in out["cluster_sizes"].collect()) == out["segments"].count()
    assert out["cluster_separation"].count() == 16
    assert out["evaluation"].count() == 1
