"""Traffic patterns and summary statistics (E1 service form, E29-E33)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.functions.numeric import round_to
from logscope.functions import calendar as C
from logscope.operators.sizes import KB, MB


def hourly_traffic(df: DataFrame) -> DataFrame:
    """Requests per hour of day, NULL time dropped, by hour."""
    return (df.where(F.col("time").isNotNull())
            .groupBy(F.hour("time").alias("hour")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy("hour"))


def daily_traffic(df: DataFrame) -> DataFrame:
    """Requests per weekday name, most first."""
    return (df.where(F.col("time").isNotNull())
            .groupBy(C.weekday_name("time").alias("day")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "day"))


def weekday_traffic(df: DataFrame) -> DataFrame:
    """Requests per weekday, Monday to Sunday, with the sort key."""
    return (df.where(F.col("time").isNotNull())
            .groupBy(C.weekday_index("time").alias("sort_key"), C.weekday_name("time").alias("day"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select("day", "count", "sort_key").orderBy("sort_key"))


def statistics(df: DataFrame, digits: int = 6) -> DataFrame:
    """Requests, distinct hosts, MB, mean KB and success rate in one pass."""
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("total_requests"),
        F.countDistinct("host").alias("unique_hosts"),
        round_to(F.sum("content_size") / F.lit(MB), digits).alias("total_data_mb"),
        round_to(F.avg("content_size") / F.lit(KB), digits).alias("avg_response_size_kb"),
        round_to(F.try_divide(F.count_if(F.col("status").between(200, 299)).cast("double"),
                             n.cast("double")) * 100, digits).alias("success_rate"),
    )


def page_totals(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sidebar totals of the page filter."""
    return df.agg(F.count(F.lit(1)).alias("total_requests"),
                  F.countDistinct("host").alias("unique_hosts"),
                  round_to(F.sum("content_size") / F.lit(MB), digits).alias("total_data_mb"))
