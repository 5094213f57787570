"""Daily forecast with a bending trend and Fourier seasons.

Model of a series, after Taylor and Letham (2018): a piecewise linear trend that
may bend at ``n_changes`` evenly spaced dates in the first ``change_range`` of the
history, plus a Fourier series of the week and, on demand, the year. All of it is
linear in its coefficients, so a series is fitted by ridge regression on its normal
equations. Spark gathers each series into one row (one value per calendar date, so
its size is bounded by the length of the history) and a vectorised UDF solves
Arrow batches of such rows: any number of series is fitted at once, in one shuffle.

Dates are scaled to [0, 1] over the history and values by their largest size.
Ridge weights are ``(noise / scale)^2`` with a scale per kind of column; the level
has none, so a constant series is forecast exactly and a one-day series goes on at
its value. A season needs two periods of history, else its columns are zero. The
band is ``z`` deviations wide: that of the residuals, and beyond the history that of
future bends, which are as frequent as the model's and as large as its mean bend.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.functions.numeric import round_to
from logscope.operators.forecast import Z80, daily_history
from logscope.session import ship_package


@dataclass(frozen=True)
class Shape:
    """What the model is made of; the defaults are our choice."""

    n_changes: int = 25
    change_range: float = 0.8
    weekly_order: int = 3
    yearly_order: int = 0
    change_scale: float = 0.05
    season_scale: float = 10.0
    slope_scale: float = 5.0
    noise: float = 0.1

    def seasons(self) -> list[tuple[str, float, int]]:
        return [("weekly", 7.0, self.weekly_order), ("yearly", 365.25, self.yearly_order)]

    def change_at(self) -> list[float]:
        return [self.change_range * j / (self.n_changes + 1) for j in range(1, self.n_changes + 1)]

    def columns(self) -> list[str]:
        """Kind of every basis column, in order."""
        return ["trend"] * (2 + self.n_changes) + [name for name, _, order in self.seasons() for _ in range(2 * order)]

    def ridge(self) -> list[float]:
        def weight(scale: float) -> float:
            return (self.noise / scale) ** 2
        return ([0.0, weight(self.slope_scale)] + [weight(self.change_scale)] * self.n_changes
                + [weight(self.season_scale)] * (len(self.columns()) - 2 - self.n_changes))

    def basis(self, day: np.ndarray, first: float, length: float) -> np.ndarray:
        """Basis columns of day numbers, for a history of ``length`` days from ``first`` on."""
        t = (day - first) / max(length, 1.0)
        out = [np.ones(len(t)), t] + [np.maximum(t - s, 0.0) for s in self.change_at()]
        for _, period, order in self.seasons():
            for n in range(1, order + 1):
                angle = 2 * np.pi * n * (np.mod(day, period) / period)
                out += [f(angle) if length >= 2 * period else np.zeros(len(t)) for f in (np.cos, np.sin)]
        return np.stack(out, axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.linalg.solve(x.T @ x + np.diag(self.ridge()), x.T @ y)

    def series(self, day: np.ndarray, y: np.ndarray, periods: int, z: float) -> dict[str, np.ndarray]:
        """Parts of the forecast and half the band, on the history's days and ``periods`` more."""
        first, last = day[0], day[-1]
        scale = np.abs(y).max() or 1.0
        ahead = np.concatenate([day, last + np.arange(1, periods + 1)])
        x = self.basis(ahead, first, last - first)
        coef = self.fit(x[:len(day)], y / scale)
        parts = x * coef * scale
        kinds = np.array(self.columns())
        out = {name: parts[:, kinds == name].sum(axis=1) for name in ("trend", "weekly", "yearly")}
        sigma2 = ((y / scale - x[:len(day)] @ coef) ** 2).sum() / max(len(day) - 1, 1)
        # bends come n_changes / change_range a unit of time; one at u moves the trend at h by (h - u) times its Laplace size
        bend = np.abs(coef[2:2 + self.n_changes]).sum() / max(self.n_changes, 1)
        beyond = np.maximum(ahead - last, 0.0) / max(last - first, 1.0)
        spread = 2 * self.n_changes / self.change_range / 3 * bend ** 2 * beyond ** 3
        return {"day": ahead.astype(np.int32), **out, "band": z * scale * np.sqrt(sigma2 + spread)}


def forecast(history: DataFrame, periods: int = 30, keys: Sequence[str] = (), shape: Shape = Shape(), z: float = Z80,
             digits: int = 6) -> DataFrame:
    """The history and ``periods`` days after it: ``(keys..., ds, y, yhat, trend,
    weekly[, yearly], yhat_lower, yhat_upper)``; ``y`` is NULL in the future. Rows of
    ``history`` (one per series and date) without date or value are left out."""
    ship_package(history.sparkSession)
    by = [F.col(k) for k in keys] or [F.lit(0).alias("_series")]
    days = F.sort_array(F.collect_list(F.struct(F.unix_date("ds").alias("day"), F.col("y").cast("double").alias("y"))))
    series = history.where(F.col("ds").isNotNull() & F.col("y").isNotNull()).groupBy(*by).agg(days.alias("days"))
    names = [name for name, _, order in [("trend", 0, 1), *shape.seasons()] if order]
    fields = ["day", *names, "band"]

    @F.pandas_udf("day array<int>, " + ", ".join(f"{n} array<double>" for n in fields[1:]))
    def fitted(day: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [shape.series(np.asarray(d, float), np.asarray(v, float), periods, z) for d, v in zip(day, y)]
        return pd.DataFrame({f: [r[f] for r in rows] for f in fields})

    out = series.select(*keys, "days.y", fitted("days.day", "days.y").alias("f")).select(
        *keys, F.explode(F.arrays_zip(F.col("y"), *[F.col(f"f.{f}").alias(f) for f in fields])).alias("p")).select(*keys, "p.*")
    yhat = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return out.select(*keys, F.date_from_unix_date("day").alias("ds"), "y", round_to(yhat, digits).alias("yhat"),
                      *[round_to(F.col(n), digits).alias(n) for n in names],
                      round_to(yhat - F.col("band"), digits).alias("yhat_lower"), round_to(yhat + F.col("band"), digits).alias("yhat_upper"))


def traffic_changepoint_forecast(df: DataFrame, periods: int = 30) -> DataFrame:
    """Site-wide daily requests: fitted history and forecast."""
    return forecast(daily_history(df), periods)


def host_changepoint_forecast(df: DataFrame, periods: int = 7) -> DataFrame:
    """The same per host, all hosts at once."""
    return forecast(daily_history(df, ["host"]), periods, keys=["host"])
