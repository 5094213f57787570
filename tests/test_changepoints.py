"""Forecast with changepoints and seasons, against plain numpy."""

import datetime as dt

import numpy as np
import pytest

from logscope.operators import changepoints as CP

D0 = dt.date(1995, 7, 3)


def history(spark, values, keys=None):
    rows = [(D0 + dt.timedelta(days=i), float(v), k) for k, vs in (keys or {"a": values}).items() for i, v in vs]
    return spark.createDataFrame(rows, "ds date, y double, k string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_equals_ridge_by_stacked_least_squares(spark):
    rng = np.random.default_rng(1)
    at = sorted(rng.choice(120, 90, replace=False).tolist())
    y = [50 + .5 * i - .9 * max(i - 60, 0) + 8 * np.sin(2 * np.pi * i / 7) + rng.normal(0, 2) for i in at]
    got = CP.forecast(history(spark, list(zip(at, y))), periods=20).orderBy("ds").collect()
    assert len(got) == 110 and [r["y"] for r in got[:90]] == y and all(r["y"] is None for r in got[90:])
    day = np.array(at + [at[-1] + i for i in range(1, 21)], float) + (D0 - dt.date(1970, 1, 1)).days
    span, scale = at[-1] - at[0], max(map(abs, y))
    t = (day - day[0]) / span
    knots = [.8 * j / 26 for j in range(1, 26)]
    x = np.column_stack([np.ones_like(t), t, *[np.clip(t - s, 0, None) for s in knots],
                         *[f(2 * np.pi * n * day / 7) for n in (1, 2, 3) for f in (np.cos, np.sin)]])
    ridge = np.diag([0, .1 / 5, *[.1 / .05] * 25, *[.1 / 10] * 6])
    coef = np.linalg.lstsq(np.vstack([x[:90], ridge]), np.concatenate([np.array(y) / scale, np.zeros(33)]), rcond=None)[0]
    np.testing.assert_allclose([r["yhat"] for r in got], x @ coef * scale, atol=2e-6)
    np.testing.assert_allclose([r["trend"] for r in got], x[:, :27] @ coef[:27] * scale, atol=2e-6)
    np.testing.assert_allclose([r["trend"] + r["weekly"] for r in got], [r["yhat"] for r in got], atol=2e-6)
    half = [r["yhat_upper"] - r["yhat"] for r in got]
    assert len({round(h, 5) for h in half[:90]}) == 1 and all(b > a for a, b in zip(half[89:], half[90:]))


def test_trend_bends_where_the_data_does(spark):
    y = [(i, 100 + 2 * i if i < 60 else 220 - 3 * (i - 60)) for i in range(120)]
    got = {r["ds"]: r["yhat"] for r in CP.forecast(history(spark, y), periods=10).collect()}
    last = D0 + dt.timedelta(days=119)
    ahead = got[last + dt.timedelta(days=10)] - got[last]
    assert -40 < ahead < -20  # goes on falling by some 3 a day


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_constant_series_stays_constant(spark, n):
    got = CP.forecast(history(spark, [(i, 7.0) for i in range(n)]), periods=4).collect()
    assert len(got) == n + 4
    assert all(r["yhat"] == r["yhat_lower"] == r["yhat_upper"] == 7.0 for r in got)


def test_zero_empty_and_null_rows(spark):
    assert all(r["yhat"] == 0 for r in CP.forecast(history(spark, [(i, 0.0) for i in range(9)])).collect())
    df = history(spark, [(0, 1.0)])
    assert CP.forecast(df.limit(0)).count() == 0
    odd = df.unionByName(spark.createDataFrame([(None, 3.0, "a"), (D0, None, "b")], df.schema))
    assert {(r["k"], r["yhat"]) for r in CP.forecast(odd, 2, ["k"]).collect()} == {("a", 1.0)}


def test_series_are_independent(spark):
    a, b = [(i, float(i % 7 + i)) for i in range(50)], [(i, 30.0 - i) for i in range(3, 20)]
    both = rows(CP.forecast(history(spark, None, {"a": a, "b": b}), 5, ["k"]))
    alone = rows(CP.forecast(history(spark, None, {"b": b}), 5, ["k"]))
    assert [r for r in both if r[0] == "b"] == alone and len(both) == 55 + 22


def test_yearly_season(spark):
    y = [(i, 100 + 20 * np.sin(2 * np.pi * i / 365.25)) for i in range(3 * 365)]
    got = CP.forecast(history(spark, y), 90, shape=CP.Shape(n_changes=0, yearly_order=2)).orderBy("ds").collect()
    want = [100 + 20 * np.sin(2 * np.pi * i / 365.25) for i in range(3 * 365 + 90)]
    assert np.abs(np.array([r["yhat"] for r in got]) - want).max() < 1
    short = CP.forecast(history(spark, y[:300]), 9, shape=CP.Shape(yearly_order=2)).collect()
    assert all(r["yearly"] == 0 for r in short)
