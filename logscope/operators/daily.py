"""Host and day aggregates.

``day`` is the day of the month, as in the study, so the same day
number of two months is one day; the day tables therefore have at most
31 rows (plus a NULL day for unparseable times).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_hosts(df: DataFrame) -> DataFrame:
    """Number of distinct hosts (E12); exact, two-phase distinct aggregate."""
    return df.agg(F.countDistinct("host").alias("unique_hosts"))


def host_day_pairs(df: DataFrame) -> DataFrame:
    """(host, day-of-month) of every request (E13, before de-duplication)."""
    return df.select("host", F.dayofmonth("time").alias("day"))


def host_day_distinct(df: DataFrame) -> DataFrame:
    """Distinct (host, day-of-month) pairs (E13); partial dedup per task."""
    return df.select("host", F.dayofmonth("time").alias("day")).dropDuplicates()


def daily_unique_hosts(df: DataFrame) -> DataFrame:
    """Distinct hosts per day of month."""
    return (df.groupBy(F.dayofmonth("time").alias("day"))
            .agg(F.countDistinct("host").alias("total_hosts")))


def daily_requests(df: DataFrame) -> DataFrame:
    """Requests per day of month."""
    return df.groupBy(F.dayofmonth("time").alias("day")).agg(F.count(F.lit(1)).alias("total_reqs"))


def avg_daily_requests_per_host(df: DataFrame) -> DataFrame:
    """Requests, distinct hosts and requests per host for each day.

    The study joins two daily aggregates on ``day``; both come from one
    scan here: ``count`` and ``countDistinct(host)`` in a single aggregate
    (partial aggregation on (day, host)), then the NULL day dropped as the
    inner join would. Same rows, one pass, no join.
    """
    return (df.groupBy(F.dayofmonth("time").alias("day"))
            .agg(F.count(F.lit(1)).alias("total_reqs"), F.countDistinct("host").alias("total_hosts"))
            .where(F.col("day").isNotNull())
            .withColumn("avg_reqs", F.col("total_reqs").cast("double") / F.col("total_hosts").cast("double"))
            .select("day", "total_reqs", "total_hosts", "avg_reqs")
            .orderBy("day"))
