"""Hourly rollups: the service's window queries without rereading the requests.

``build`` reduces the requests once to Parquet tables by (date, hour), each in its
own folder, partitioned by date:

* counts by method and status (with bytes), by endpoint and method, by host, by size;
* exact distinct sets as bitmaps: a dictionary numbers all hosts (endpoints) densely,
  and a cell (date, hour, hundred of the status) keeps one bitmap per 32768 ids.
  Bitmaps merge with OR, so distinct hosts of any days, weekdays or hours come
  from them without another look at a host.

A window is decomposed: whole hours come from a rollup, and only the two hours that
its ends cut, if any, from the requests, reduced by the same aggregate. Both parts
prune dates. Results are the rows of the plain queries, for any window. Requests
without time are in the cell of the NULL date: in a query without bounds, and in no window.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logscope.functions import calendar as C
from logscope.functions import patterns as P
from logscope.functions import status as S
from logscope.functions.numeric import round_to
from logscope.operators import filters as FL
from logscope.operators import sizes as SZ
from logscope.session import shared_path

HOUR = dt.timedelta(hours=1)
TICK = dt.timedelta(microseconds=1)

#: Keys of the count tables beside date and hour.
COUNTS = {"classes": ["method", "status"], "endpoints": ["method", "endpoint"], "hosts": ["host"], "sizes": ["content_size"]}
#: Column and selection of the distinct sets.
SETS = {"host_sets": ("host", None), "endpoint_sets": ("endpoint", "method = 'GET'")}


def _cell() -> list[Column]:
    return [F.to_date("time").alias("date"), F.hour("time").alias("hour")]


def counted(requests: DataFrame, name: str) -> DataFrame:
    """The rows of a count table for these requests."""
    extra = [F.sum("content_size").alias("bytes")] if name == "classes" else []
    return requests.groupBy(*_cell(), *COUNTS[name]).agg(F.count("*").alias("n"), *extra)


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, id): every value that is not NULL with a number from 0 on, without
    gaps, in the order of a range sort. The counts of the sort's partitions are
    the only thing that one task sees."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, f"dictionary-{column}")
    values = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    values.repartitionByRange("value").sortWithinPartitions("value").withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    numbered = spark.read.parquet(path).select("value", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("k"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = numbered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    return numbered.join(F.broadcast(starts), "part").select("value", (F.col("start") + F.col("k")).alias("id"))


def bitmaps(rows: DataFrame, ids: DataFrame, column: str, *keys: Column) -> DataFrame:
    """(keys..., bucket, bits) of the ids of ``column``: distinct first, so a join row
    is a value of a cell, not a request."""
    cells = rows.groupBy(*keys, F.col(column).alias("value")).agg(F.lit(1).alias("_"))
    names = [c for c in cells.columns if c not in ("value", "_")]
    at = F.col("id") + 1
    return cells.join(ids, "value").groupBy(*names, F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def distinct_of(bits: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n): size of the union of the sets by key."""
    merged = bits.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def parts(start: dt.datetime | None, end: dt.datetime | None):
    """(first whole hour, hour after the last one, cut pieces) of a window with
    both ends inclusive; None is open. Pieces are (from, to), both inclusive."""
    first = None if start is None else start.replace(minute=0, second=0, microsecond=0)
    if first is not None and first < start:
        first += HOUR
    after = None if end is None else (end + TICK).replace(minute=0, second=0, microsecond=0)
    if first is not None and after is not None and after <= first:
        return first, first, [(start, end)] if start <= end else []
    cut = [(start, first - TICK)] if start is not None and start < first else []
    return first, after, cut + ([(after, end)] if end is not None and after <= end else [])


def _number(moment: dt.datetime) -> int:
    return (moment.date() - dt.date(1970, 1, 1)).days * 24 + moment.hour


class Rollups:
    """The tables under ``path``, and the requests that they were built from."""

    def __init__(self, spark: SparkSession, requests: DataFrame, path: str):
        self.spark, self.requests, self.path = spark, requests, path

    def build(self, names: Iterable[str] = (*COUNTS, *SETS)) -> "Rollups":
        for name in names:
            if name in COUNTS:
                self._write(counted(self.requests, name), name)
            else:
                column, where = SETS[name]
                rows = self.requests.where(where) if where else self.requests
                dictionary(rows, column).write.mode("overwrite").parquet(f"{self.path}/{name}-ids")
                hundred = F.floor(F.col("status") / 100).cast("int").alias("hundred")
                self._write(bitmaps(rows, self.ids(name), column, *_cell(), hundred), name)
        return self

    def _write(self, table: DataFrame, name: str) -> None:
        table.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(f"{self.path}/{name}")

    def refresh(self, dates: Sequence[dt.date]) -> "Rollups":
        """Count tables of some dates again, for late lines; other dates keep their files."""
        days = [F.lit(d.isoformat()).cast("date") for d in dates]
        some = FL._prune_dates(self.requests, min(dates), max(dates)).where(F.to_date("time").isin(days))
        for name in COUNTS:
            counted(some, name).hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "date").parquet(f"{self.path}/{name}")
        return self

    def ids(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}-ids")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").withColumn("date", F.col("date").cast("date"))

    def whole(self, name: str, first: dt.datetime | None, after: dt.datetime | None) -> DataFrame:
        """Cells of whole hours."""
        cells, number = self.table(name), F.unix_date("date") * 24 + F.col("hour")
        if first is not None:
            cells = cells.where((F.col("date") >= F.lit(first.date())) & (number >= _number(first)))
        if after is not None:
            cells = cells.where((F.col("date") <= F.lit(after.date())) & (number < _number(after)))
        return cells

    def pieces(self, cut) -> list[DataFrame]:
        return [FL.filter_time_methods(self.requests, a, b) for a, b in cut]

    def window(self, name: str, start=None, end=None) -> DataFrame:
        """Rows of a count table for the requests in a window."""
        first, after, cut = self._parts(start, end)
        out = self.whole(name, first, after)
        for piece in self.pieces(cut):
            out = out.unionByName(counted(piece, name).select(*out.columns))
        return out

    def _parts(self, start, end):
        start, end = FL._bound(start), FL._bound(end)
        if FL._aware(start) or FL._aware(end):
            raise ValueError("rollups are by wall clock: a bound with a zone needs the requests")
        midnight = lambda x: x if x is None or isinstance(x, dt.datetime) else dt.datetime(x.year, x.month, x.day)
        return parts(midnight(start), midnight(end))

    # the service's queries

    @staticmethod
    def _top(key: str, limit: int, rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.sum("n").alias("count")).orderBy(F.col("count").desc(), F.col(key).asc_nulls_first()).limit(limit)

    @staticmethod
    def _of(rows: DataFrame, methods: Sequence[str] | None) -> DataFrame:
        return rows.where(F.col("method").isin(list(methods))) if methods else rows

    def status_distribution(self, start=None, end=None, methods=None) -> DataFrame:
        rows = self._of(self.window("classes", start, end), methods)
        return rows.groupBy(S.status_category("status").alias("status_category")).agg(F.sum("n").alias("count")).orderBy(
            F.col("count").desc(), "status_category")

    def method_distribution(self, start=None, end=None) -> DataFrame:
        return self.window("classes", start, end).groupBy("method").agg(F.sum("n").alias("count")).orderBy(F.col("count").desc(), "method")

    def top_endpoints(self, limit: int = 20, start=None, end=None, methods=None) -> DataFrame:
        return self._top("endpoint", limit, self._of(self.window("endpoints", start, end), methods))

    def host_frequency(self, limit: int = 20, start=None, end=None) -> DataFrame:
        return self._top("host", limit, self.window("hosts", start, end))

    def content_size_distribution(self, start=None, end=None, bin_count: int = 50) -> tuple[DataFrame, DataFrame]:
        counts = self.window("sizes", start, end).groupBy(F.col("content_size").alias("v")).agg(F.sum("n").alias("n"))
        return SZ.histogram_of(counts, bin_count), SZ.stats_of(counts)

    def traffic_pattern(self, pattern_type: str, start=None, end=None) -> DataFrame:
        rows = self.window("classes", start, end).where(F.col("date").isNotNull())
        if pattern_type == "hourly":
            return rows.groupBy("hour").agg(F.sum("n").alias("count")).orderBy("hour")
        return rows.groupBy(C.weekday_name("date").alias("day")).agg(F.sum("n").alias("count")).orderBy(F.col("count").desc(), "day")

    def unique_hosts(self, start=None, end=None) -> DataFrame:
        first, after, cut = self._parts(start, end)
        bits = self.whole("host_sets", first, after).select("bucket", "bits")
        for piece in self.pieces(cut):
            bits = bits.unionByName(bitmaps(piece, self.ids("host_sets"), "host"))
        return bits.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).agg(
            F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("unique_hosts"))

    def statistics(self, start=None, end=None, digits: int = 6) -> DataFrame:
        n = F.coalesce(F.sum("n"), F.lit(0))
        right = F.coalesce(F.sum(F.when(F.col("status").between(200, 299), F.col("n"))), F.lit(0)).cast("double")
        hosts = self.unique_hosts(start, end).scalar()
        return self.window("classes", start, end).agg(
            n.alias("total_requests"), round_to(F.sum("bytes") / F.lit(SZ.MB), digits).alias("total_data_mb"),
            round_to(F.try_divide(F.sum("bytes").cast("double"), n.cast("double")) / F.lit(SZ.KB), digits).alias("avg_response_size_kb"),
            round_to(F.try_divide(right, n.cast("double")) * 100, digits).alias("success_rate")).select(
            "total_requests", hosts.alias("unique_hosts"), "total_data_mb", "avg_response_size_kb", "success_rate")

    # distinct sets by calendar

    def daily_unique_hosts(self) -> DataFrame:
        sets = self.table("host_sets").withColumn("day", F.dayofmonth("date"))
        return distinct_of(sets, "day").withColumnRenamed("n", "total_hosts")

    def unique_by_weekday_range(self, name: str, lo: int, hi: int, out: str) -> DataFrame:
        """Distinct values with status in [lo, hi), both hundreds, per weekday and
        three-hour range."""
        if lo % 100 or hi % 100:
            raise ValueError("sets are kept by hundred of the status")
        sets = self.table(name).where((F.col("hundred") >= lo // 100) & (F.col("hundred") < hi // 100)).select(
            C.weekday_abbr("date").alias("weekday"), C.hour_range(F.col("hour")).alias("hour_range"), "bucket", "bits")
        found = distinct_of(sets.where(F.col("weekday").isNotNull() & F.col("hour_range").isNotNull()), "weekday", "hour_range")
        place = lambda names, c: F.array_position(F.array(*[F.lit(x) for x in names]), F.col(c))
        return found.withColumnRenamed("n", out).orderBy(place([r[0] for r in P.HOUR_RANGES], "hour_range"), place(P.WEEKDAY_ABBR, "weekday"))
