"""Distributions and top-k lists.

Top-k is ``orderBy(count desc, key asc).limit(k)``: Spark plans it as
TakeOrderedAndProject, each task keeps k rows, so no global sort and no
unbounded data reaches one task. Ties are broken by the key so results
are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscope.functions.numeric import round_to
from logscope.functions import status as S


def counts_by(df: DataFrame, key, name: str | None = None) -> DataFrame:
    """``groupBy(key).count()`` with partial (map-side) aggregation."""
    col = F.col(key) if isinstance(key, str) else key
    alias = name or (key if isinstance(key, str) else None)
    return df.groupBy(col.alias(alias)).agg(F.count(F.lit(1)).alias("count"))


def group_count(df: DataFrame, key: str, name: str = "n_groups") -> DataFrame:
    """Number of distinct ``key`` groups, NULL counted as one group, as
    ``groupBy(key).count().count()`` gives; one two-phase aggregate."""
    return df.groupBy(key).agg(F.lit(1).alias("_g")).agg(F.count(F.lit(1)).alias(name))


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    return (counts_by(df, key)
            .orderBy(F.col("count").desc(), F.col(key).asc_nulls_first())
            .limit(k))


def status_distribution(df: DataFrame) -> DataFrame:
    """Requests per five-way status category, most frequent first."""
    return (counts_by(df, S.status_category("status"), "status_category")
            .orderBy(F.col("count").desc(), "status_category"))


def status_freq(df: DataFrame) -> DataFrame:
    """Requests per status code, by code (E2); NULL status is its own row."""
    return counts_by(df, "status").orderBy(F.col("status").asc_nulls_first())


def status_freq_desc(df: DataFrame) -> DataFrame:
    return counts_by(df, "status").orderBy(F.col("count").desc(), F.col("status").asc_nulls_first())


def status_log_freq(df: DataFrame, digits: int = 9) -> DataFrame:
    """E2 plus the natural log of each count, largest first."""
    return (counts_by(df, "status")
            .withColumn("log_count", round_to(F.log(F.col("count").cast("double")), digits))
            .orderBy(F.col("log_count").desc(), F.col("status").asc_nulls_first()))


def content_size_freq(df: DataFrame) -> DataFrame:
    return counts_by(df, "content_size").orderBy("content_size")


def method_freq(df: DataFrame) -> DataFrame:
    return counts_by(df, "method").orderBy("method")


def protocol_freq(df: DataFrame) -> DataFrame:
    return counts_by(df, "protocol").orderBy("protocol")


def unique_methods(df: DataFrame) -> DataFrame:
    return df.select("method").distinct().orderBy("method")


def method_distribution(df: DataFrame) -> DataFrame:
    """Requests per method, most frequent first."""
    return counts_by(df, "method").orderBy(F.col("count").desc(), "method")


def method_share(df: DataFrame) -> DataFrame:
    """Method counts with percentage of all requests, 2 decimals.

    The total is a scalar subquery summing the grouped counts, so it
    reuses the same aggregation (one scan) instead of an unpartitioned
    window or a join.
    """
    counts = counts_by(df, "method")
    total = counts.select(F.sum("count")).scalar()
    return (counts
            .withColumn("percentage", round_to(F.col("count") / total * 100, 2))
            .orderBy(F.col("count").desc(), "method"))


def top_endpoints(df: DataFrame, limit: int = 20) -> DataFrame:
    """Most requested endpoints."""
    return top_k(df, "endpoint", limit)


def top_error_endpoints(df: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent endpoints among non-200 responses (E9); NULL status
    compares unknown and is dropped, as ``!=`` does."""
    return top_k(df.filter(F.col("status") != 200), "endpoint", limit)


def top_hosts(df: DataFrame, limit: int = 20) -> DataFrame:
    """Most active hosts."""
    return top_k(df, "host", limit)


def top_hosts_share(df: DataFrame, limit: int = 20) -> DataFrame:
    """Top hosts with percentage of the top-``limit`` total, 2 decimals.

    The top list is at most ``limit`` rows, so its total is a tiny
    aggregate over the already limited result.
    """
    top = top_hosts(df, limit)
    total = F.sum("count").over(Window.partitionBy())  # over <= limit rows
    return (top.withColumn("percentage", round_to(F.col("count") / total * 100, 2))
            .orderBy(F.col("count").desc(), "host"))
