"""Daily traffic forecast (M12), expressed as native aggregates.

Model per series: linear trend by ordinary least squares on the day
index (``regr_slope`` / ``regr_intercept``), plus the mean residual of
each weekday, with a band of +-z * (standard deviation of what is left).
All statistics are window aggregates partitioned by the series key (one
shuffle), then one ``groupBy(key)`` builds the model row, so many series
(say one per host) forecast in parallel with no joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscope.functions.numeric import round_to

Z80 = 1.2816  # two-sided 80 % normal band; our choice (the reference sets none)


def daily_history(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., ds, y): requests per calendar date; NULL time dropped."""
    return (df.where(F.col("time").isNotNull())
            .groupBy(*keys, F.to_date("time").alias("ds"))
            .agg(F.count(F.lit(1)).alias("y")))


def forecast(history: DataFrame, periods: int = 30, keys: Sequence[str] = (), z: float = Z80,
             digits: int = 6) -> DataFrame:
    """Forecast ``periods`` days after each series' last date.

    Output ``(keys..., ds, yhat, yhat_lower, yhat_upper)``.
    """
    out_keys = list(keys)
    # a single series gets a constant key; its window then holds one row per day
    keys = out_keys or ["_series"]
    h = history.select(*[F.col(k) for k in out_keys], *([] if out_keys else [F.lit(0).alias("_series")]),
                       "ds", F.col("y").cast("double").alias("y"))
    series = Window.partitionBy(*keys)
    fitted = (h.withColumn("d0", F.min("ds").over(series))
              .withColumn("x", F.datediff("ds", "d0").cast("double"))
              # one day has no slope: the level is its value
              .withColumn("slope", F.coalesce(F.regr_slope("y", "x").over(series), F.lit(0.0)))
              .withColumn("icpt", F.coalesce(F.regr_intercept("y", "x").over(series), F.avg("y").over(series)))
              .withColumn("wd", F.weekday("ds"))
              .withColumn("resid", F.col("y") - (F.col("icpt") + F.col("slope") * F.col("x")))
              .withColumn("effect", F.avg("resid").over(Window.partitionBy(*keys, "wd")))
              .withColumn("sigma", F.stddev_samp(F.col("resid") - F.col("effect")).over(series)))
    # one model row per series; the weekday effects are a map of <= 7 entries
    model = fitted.groupBy(*keys).agg(
        F.max("ds").alias("d1"), F.max("d0").alias("d0"), F.max("slope").alias("slope"),
        F.max("icpt").alias("icpt"), F.max("sigma").alias("sigma"),
        F.map_from_entries(F.collect_set(F.struct("wd", "effect"))).alias("effects"))
    fut = model.select(*keys, "d0", "slope", "icpt", "sigma", "effects",
                       F.explode(F.sequence(F.date_add("d1", 1), F.date_add("d1", periods))).alias("ds"))
    x = F.datediff("ds", "d0").cast("double")
    effect = F.coalesce(F.try_element_at("effects", F.weekday("ds")), F.lit(0.0))
    yhat = F.col("icpt") + F.col("slope") * x + effect
    band = F.lit(z) * F.coalesce(F.col("sigma"), F.lit(0.0))
    out = fut.select(*out_keys, "ds", yhat.alias("yhat"), band.alias("band"))
    return out.select(*out_keys, "ds", round_to(F.col("yhat"), digits).alias("yhat"),
                      round_to(F.col("yhat") - F.col("band"), digits).alias("yhat_lower"),
                      round_to(F.col("yhat") + F.col("band"), digits).alias("yhat_upper"))


def traffic_forecast(df: DataFrame, periods: int = 30) -> DataFrame:
    """Site-wide daily request forecast (M12 applied to the request log)."""
    return forecast(daily_history(df), periods).orderBy("ds")


def host_traffic_forecast(df: DataFrame, periods: int = 7) -> DataFrame:
    """Per-host daily request forecast: the same model for every host at
    once, partitioned by host (each window holds one host's days)."""
    return forecast(daily_history(df, ["host"]), periods, keys=["host"])
