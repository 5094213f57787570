"""Weekday / hour breakdowns.

Where the study ran one job per status class or method (ten jobs for
one chart), these are single-pass conditional aggregates; Catalyst cannot
merge separate actions, so the fusion is done here by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.functions import calendar as C
from logscope.functions import patterns as P
from logscope.functions import status as S


def _top_hosts(df: DataFrame, k: int) -> DataFrame:
    return (df.groupBy("host").agg(F.count(F.lit(1)).alias("total_requests"))
            .orderBy(F.col("total_requests").desc(), "host").limit(k))


def top5_hosts(df: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most active hosts with their request totals."""
    return _top_hosts(df, k)


def _top_host_activity(df: DataFrame, key, key_name: str, values: list, k: int) -> DataFrame:
    """Counts per (key, host) for the top ``k`` hosts, from one pass.

    One aggregate per host holds its total and a count for each of the few
    ``values`` of the key and for NULL; the top ``k`` of those rows unfold.
    """
    slots = [F.count_if(key.eqNullSafe(F.lit(v))).alias(f"n{i}") for i, v in enumerate(values)]
    per_host = df.groupBy("host").agg(F.count(F.lit(1)).alias("total_requests"), *slots, F.count_if(key.isNull()).alias("n_null"))
    top = per_host.orderBy(F.col("total_requests").desc(), "host").limit(k)
    kind = "string" if isinstance(values[0], str) else "int"
    rows = [F.struct(F.lit(v).cast(kind).alias(key_name), F.col(n).alias("count"))
            for v, n in [*((v, f"n{i}") for i, v in enumerate(values)), (None, "n_null")]]
    return top.select("host", F.inline(F.array(*rows))).where("count > 0").select(key_name, "host", "count")


def top5_host_weekday(df: DataFrame, k: int = 5) -> DataFrame:
    """Requests per weekday for the top ``k`` hosts, Monday first."""
    out = _top_host_activity(df, C.weekday_abbr("time"), "weekday", list(P.WEEKDAY_ABBR), k)
    order = F.array_position(F.array(*[F.lit(x) for x in P.WEEKDAY_ABBR]), F.col("weekday"))
    return out.orderBy(order, "host")


def top5_host_hour(df: DataFrame, k: int = 5) -> DataFrame:
    """Requests per hour for the top ``k`` hosts."""
    return _top_host_activity(df, F.hour("time"), "hour", list(range(24)), k).orderBy("hour", "host")


def hourly_status_counts(df: DataFrame) -> DataFrame:
    """2xx/3xx/4xx counts per hour in one pass (E22); hours with none of
    the three are left out, as in the three per-class results."""
    aggs = [F.count_if(S.in_range(lo, hi)).alias(f"count_{label}") for label, lo, hi in P.STATUS_CODES]
    out = df.groupBy(F.hour("time").alias("hour")).agg(*aggs)
    any_row = None
    for label, _, _ in P.STATUS_CODES:
        c = F.col(f"count_{label}") > 0
        any_row = c if any_row is None else any_row | c
    return out.where(any_row).orderBy("hour")


def hourly_status_long(df: DataFrame) -> DataFrame:
    """Long form of E22: ``(status_code, hour, count)`` per nonzero cell."""
    cls = S.status_code_class("status")
    return (df.where(F.col("status").between(200, 499))
            .groupBy(cls.alias("status_code"), F.hour("time").alias("hour"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy("status_code", "hour"))


def hourly_method_counts(df: DataFrame) -> DataFrame:
    """Requests per (hour, method)."""
    return (df.groupBy(F.hour("time").alias("hour"), "method")
            .agg(F.count(F.lit(1)).alias("count")).orderBy("hour", "method"))


def hourly_method_pivot(df: DataFrame, methods=tuple(P.PIVOT_METHODS)) -> DataFrame:
    """Hours x methods with explicit pivot values (no discovery job), missing
    cells 0; the method filter runs before the aggregation (E24)."""
    return (df.where(F.col("method").isin(list(methods)))
            .groupBy(F.hour("time").alias("hour"))
            .pivot("method", list(methods))
            .agg(F.count(F.lit(1)))
            .na.fill(0, subset=list(methods))
            .orderBy("hour"))


def status_method_totals(df: DataFrame) -> DataFrame:
    """2xx, 3xx, 4xx, GET, HEAD, POST totals: one aggregate then rows."""
    items = [(label, F.count_if(S.in_range(lo, hi))) for label, lo, hi in P.STATUS_CODES]
    items += [(m, F.count_if(F.col("method") == m)) for m in P.PIVOT_METHODS]
    wide = df.agg(*[e.alias(f"c{i}") for i, (_, e) in enumerate(items)])
    structs = [F.struct(F.lit(i).alias("position"), F.lit(label).alias("metric"), F.col(f"c{i}").alias("count"))
               for i, (label, _) in enumerate(items)]
    return wide.select(F.inline(F.array(*structs)))


def endpoints_weekday_status(df: DataFrame) -> DataFrame:
    """Endpoint count per weekday and status class, 2xx-4xx only."""
    cls = S.status_code_class("status")
    out = (df.where(F.col("status").between(200, 499))
           .groupBy(C.weekday_abbr("time").alias("weekday"), cls.alias("status_code"))
           .agg(F.count("endpoint").alias("total_endpoints")))
    order = F.array_position(F.array(*[F.lit(x) for x in P.WEEKDAY_ABBR]), F.col("weekday"))
    return out.orderBy(order, "status_code")


def endpoints_by_status(df: DataFrame) -> DataFrame:
    """Class totals of E26."""
    cls = S.status_code_class("status")
    return (df.where(F.col("status").between(200, 499))
            .groupBy(cls.alias("status_code"))
            .agg(F.count("endpoint").alias("total_endpoints")).orderBy("status_code"))


def _unique_by_weekday_range(df: DataFrame, target: str, out_name: str) -> DataFrame:
    hr = C.hour_range(F.hour("time"))
    wd = C.weekday_abbr("time")
    out = (df.select(wd.alias("weekday"), hr.alias("hour_range"), F.col(target))
           .where(F.col("weekday").isNotNull() & F.col("hour_range").isNotNull())
           .groupBy("weekday", "hour_range").agg(F.countDistinct(target).alias(out_name)))
    range_order = F.array_position(F.array(*[F.lit(x[0]) for x in P.HOUR_RANGES]), F.col("hour_range"))
    day_order = F.array_position(F.array(*[F.lit(x) for x in P.WEEKDAY_ABBR]), F.col("weekday"))
    return out.orderBy(range_order, day_order)


def unique_endpoints_by_status(df: DataFrame, lo: int, hi: int, method: str = "GET") -> DataFrame:
    """Distinct endpoints of ``method`` requests with status in [lo, hi) per
    weekday x three-hour range; hour 0 has no range and drops out (E27)."""
    f = df.where(S.in_range(lo, hi) & (F.col("method") == method))
    return _unique_by_weekday_range(f, "endpoint", "unique_endpoints")


def unique_hosts_by_status(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Distinct hosts with status in [lo, hi) per weekday x hour range."""
    return _unique_by_weekday_range(df.where(S.in_range(lo, hi)), "host", "unique_hosts")
