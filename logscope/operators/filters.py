"""Filters (D1-D8). Expressed as DataFrame predicates so Catalyst pushes
them to the scan (parquet ``PushedFilters``; partition pruning when the
request table is materialised by date)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.session import checkpointed


def _bound(x):
    return dt.datetime.fromisoformat(x) if isinstance(x, str) else x


def _aware(x) -> bool:
    return isinstance(x, dt.datetime) and x.utcoffset() is not None


def _instant(x):
    """Epoch seconds of an aware bound."""
    return F.lit(x.timestamp())


def _ts(x):
    """Wall-clock literal; built from text so no zone conversion applies."""
    if isinstance(x, dt.date) and not isinstance(x, dt.datetime):
        x = dt.datetime(x.year, x.month, x.day)
    return F.lit(x.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def _date(x):
    if x is None:
        return None
    if isinstance(x, str):
        x = dt.date.fromisoformat(x[:10])
    if isinstance(x, dt.datetime):
        x = x.date()
    return F.lit(x.isoformat()).cast("date")


def _prune_dates(df: DataFrame, lo=None, hi=None) -> DataFrame:
    """On the materialised table (partition column ``date``) add the same
    range on ``date`` so the scan skips whole partitions; a no-op otherwise."""
    if "date" not in df.columns:
        return df
    if lo is not None:
        df = df.filter(F.col("date") >= _date(lo))
    if hi is not None:
        df = df.filter(F.col("date") <= _date(hi))
    return df


def filter_time_methods(df: DataFrame, start=None, end=None,
                        methods: Sequence[str] | None = None) -> DataFrame:
    """Service filter (D1): optional inclusive range and methods.

    Empty/None arguments mean "no filter", as in the service. A bound without
    a zone is compared with the wall clock; a bound with one is an instant and
    needs the column ``instant_epoch`` (``requests_table(..., instant=True)``).
    """
    start, end = _bound(start), _bound(end)
    if (_aware(start) or _aware(end)) and "instant_epoch" not in df.columns:
        raise ValueError("a bound with a zone needs instant_epoch: use requests_table(lines, instant=True)")
    day = dt.timedelta(days=1)  # a wall-clock date is at most a day from the instant's UTC date
    out = _prune_dates(df, start.astimezone(dt.timezone.utc) - day if _aware(start) else start,
                       end.astimezone(dt.timezone.utc) + day if _aware(end) else end)
    if start is not None:
        out = out.filter(F.col("instant_epoch") >= _instant(start) if _aware(start) else F.col("time") >= _ts(start))
    if end is not None:
        out = out.filter(F.col("instant_epoch") <= _instant(end) if _aware(end) else F.col("time") <= _ts(end))
    if methods:
        out = out.filter(F.col("method").isin(list(methods)))
    return out


def filter_page(df: DataFrame, start_date=None, end_date=None,
                statuses: Sequence | None = None, methods: Sequence[str] | None = None) -> DataFrame:
    """Page filter (D2): inclusive calendar-date range, status and method lists.

    A ``None`` member of ``statuses`` selects NULL status, as selecting NaN
    does in the dashboard; Spark's ``IN`` alone would drop those rows. A row
    without a time is in no date range, so it never passes.
    """
    out = _prune_dates(df, start_date, end_date).filter(F.col("time").isNotNull())
    d = F.to_date("time")
    if start_date is not None:
        out = out.filter(d >= _date(start_date))
    if end_date is not None:
        out = out.filter(d <= _date(end_date))
    if statuses is not None:
        vals = [s for s in statuses if s is not None]
        cond = F.col("status").isin(vals) if vals else F.lit(False)
        if any(s is None for s in statuses):
            cond = cond | F.col("status").isNull()
        out = out.filter(cond)
    if methods is not None:
        out = out.filter(F.col("method").isin(list(methods)))
    return out


def filter_domains(df: DataFrame) -> DataFrame:
    """Filter choices (D3) as rows ``(domain, value)`` in order: min/max date
    and the sorted distinct statuses and methods. One pass: the requests are
    reduced to one row per (status, method), checkpointed, and the choices are
    distinct rows of that, sorted by Spark: malformed lines may have any number of
    methods, and no task holds them all."""
    day = F.to_date("time")
    small = checkpointed(df.groupBy("status", "method").agg(F.min(day).alias("lo"), F.max(day).alias("hi")))
    ends = small.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(domain).alias("domain"), F.lit(None).cast("int").alias("number"),
                 F.col(c).cast("string").alias("value")) for i, (domain, c) in enumerate([("min_date", "lo"), ("max_date", "hi")])])))
    statuses = small.select(F.lit(2).alias("place"), F.lit("status").alias("domain"), F.col("status").alias("number"),
                            F.col("status").cast("string").alias("value")).distinct()
    methods = small.select(F.lit(3).alias("place"), F.lit("method").alias("domain"), F.lit(None).cast("int").alias("number"),
                           F.col("method").alias("value")).distinct()
    return ends.unionByName(statuses).unionByName(methods).orderBy(
        "place", F.col("number").asc_nulls_first(), F.col("value").asc_nulls_first()).select("domain", "value")
