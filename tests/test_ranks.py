"""Exact order statistics, wide medians, any-range histograms, short series."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logscope.operators import forecast as FC
from logscope.operators import ranks
from logscope.operators import segments as SG
from logscope.operators import sizes as SZ


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_values_at_ranks(spark, kind):
    rng = random.Random(1)
    if kind == "bigint":
        xs = [rng.choice([-(1 << 63), (1 << 63) - 1, 0, 5, rng.randint(-10**18, 10**18)]) for _ in range(200)]
    else:
        xs = [rng.choice([0.25, rng.random(), rng.gauss(0, 1e-9), 1e300]) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], f"v {kind}")
    for r in (0, 1, 99, 150, 199):
        assert ranks.value_at_rank(df, r) == sorted(xs)[r]
    assert ranks.value_at_rank(df, 200) is None
    assert ranks.value_at_rank(df.limit(0), 0) is None


def test_linear_quantile_is_numpys(spark):
    xs = [random.Random(2).random() for _ in range(137)]
    df = spark.createDataFrame([(x,) for x in xs], "s double")
    assert ranks.linear_quantile(df, 0.9, "s") == pytest.approx(np.quantile(xs, 0.9), abs=1e-15)


def test_median_of_wide_integers(spark):
    xs = [1 << 40, 3, (1 << 50) + 1, 7]
    df = spark.createDataFrame([(x,) for x in xs], "content_size bigint")
    assert SZ.exact_median(df, "content_size").first()[0] == (7 + (1 << 40)) / 2


@pytest.mark.parametrize("scale", [1e-12, 1.0, 1e12])
def test_nice_histogram_has_no_range_limits(spark, scale):
    df = spark.createDataFrame([(i,) for i in range(1, 1001)], "content_size int")
    rows = SZ.size_histogram_nice(df, 50, scale=scale).collect()
    assert sum(r["count"] for r in rows) == 1000 and 10 <= len(rows) <= 51


def test_one_day_series_keeps_its_level(spark):
    h = spark.createDataFrame([("a", dt.date(2024, 1, 1), 5), ("b", dt.date(2024, 1, 1), 1), ("b", dt.date(2024, 1, 2), 3)],
                              "host string, ds date, y long")
    rows = FC.forecast(h, 3, ["host"]).collect()
    assert len(rows) == 6 and all(r["yhat"] is not None for r in rows)
    assert {r["yhat"] for r in rows if r["host"] == "a"} == {5.0}


def test_native_silhouette_equals_brute_force(spark):
    rng = random.Random(3)
    pts = [(d, rng.random() * 10, rng.randint(1, 99), rng.randint(1, 50), rng.choice([0, 0, 1, 2])) for d in range(1, 20)]
    pts.append((20, 1.0, 2, 3, 3))  # alone in its segment
    df = spark.createDataFrame(pts, "day int, avg_reqs double, total_reqs long, total_hosts long, segment int")
    x, lab = np.array([p[1:4] for p in pts], float), np.array([p[4] for p in pts])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    s = []
    for i in range(len(x)):
        same = lab == lab[i]
        near = d[i, same].sum() / max(1, same.sum() - 1)
        far = min(d[i, lab == o].mean() for o in set(lab) if o != lab[i])
        s.append((far - near) / max(near, far) if same.sum() > 1 else 0.0)
    got = {r["segment"]: (r["silhouette"], r["overall_silhouette"]) for r in SG._day_silhouette(df).collect()}
    for k in set(lab):
        assert got[k] == pytest.approx((np.mean(np.array(s)[lab == k]), np.mean(s)))


def test_anomaly_share_is_exact(spark):
    from logscope.operators.anomalies import isolation_forest
    rng = random.Random(4)
    df = spark.createDataFrame([(f"h{i}", rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(301)], "host string, a double, b double")
    rows = isolation_forest(df, ["a", "b"], n_trees=20).orderBy(F.col("anomaly_score").desc()).collect()
    scores = [r["anomaly_score"] for r in rows]
    assert [r["label"] for r in rows] == [-1 if s > np.quantile(scores, 0.9) else 1 for s in scores]


def test_positions_equal_a_sort(spark):
    from logscope.operators import ranks as RK
    rows = [(i, (i * 37) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(9)
    got = sorted((r["position"], r["k"]) for r in RK.positions(df, F.col("v").desc(), "k").collect())
    assert got == [(p, k) for p, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)]
    assert RK.positions(df.limit(0), "k").count() == 0


def test_schema_view_reads_nothing(spark):
    from logscope.operators import table as TB
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    view = TB.schema_view(df)
    assert [(r["position"], r["column"]) for r in view.collect()] == list(enumerate(df.columns))
    assert "FileScan" not in view._jdf.queryExecution().executedPlan().toString()


def test_median_of_a_double_column(spark):
    for values in ([2.5, -1.0, 7.25], [0.5, 0.5, 1.0, 9.75], []):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        got = SZ.exact_median(df, "x").first()["median"]
        assert got == (float(np.median(values)) if values else None)
