"""The study's query API surface, as lazy DataFrames.

``LogService`` mirrors the service's seven filtered queries (instant
range, both ends inclusive, optional methods); ``Dashboard`` mirrors
page 1 (calendar-date range, status and method selections) and its
seven charts plus sidebar totals. Both only compose operators: the
filter and the aggregation stay in one Spark plan and only the (small)
result is produced, instead of holding the whole table in driver memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from logscope.operators import distributions as DS
from logscope.operators import filters as FL
from logscope.operators import sizes as SZ
from logscope.operators import traffic as TR


class LogService:
    """Service queries over a request table ``R`` (parsed or materialised).

    ``persist=True`` keeps the table in executor memory (spilling to disk)
    for a long-lived service that answers many requests; lost blocks are
    recomputed from lineage. Call ``close()`` to release it.
    """

    def __init__(self, requests: DataFrame, persist: bool = False):
        self.df = requests.persist(StorageLevel.MEMORY_AND_DISK) if persist else requests
        self._persisted = persist

    def close(self) -> None:
        if self._persisted:
            self.df.unpersist()

    def _filter(self, start=None, end=None, methods: Sequence[str] | None = None) -> DataFrame:
        return FL.filter_time_methods(self.df, start, end, methods)

    def status_distribution(self, start=None, end=None, methods=None) -> DataFrame:
        return DS.status_distribution(self._filter(start, end, methods))

    def top_endpoints(self, limit: int = 20, start=None, end=None, methods=None) -> DataFrame:
        return DS.top_endpoints(self._filter(start, end, methods), limit)

    def method_distribution(self, start=None, end=None) -> DataFrame:
        return DS.method_distribution(self._filter(start, end))

    def content_size_distribution(self, start=None, end=None, bin_count: int = 50) -> tuple[DataFrame, DataFrame]:
        """(histogram rows, one row of mean/median/max/min), sizes in KB."""
        counts = SZ.size_counts(self._filter(start, end))  # the only pass over the requests
        return SZ.histogram_of(counts, bin_count), SZ.stats_of(counts)

    def host_frequency(self, limit: int = 20, start=None, end=None) -> DataFrame:
        return DS.top_hosts(self._filter(start, end), limit)

    def traffic_pattern(self, pattern_type: str, start=None, end=None) -> DataFrame:
        f = self._filter(start, end)
        return TR.hourly_traffic(f) if pattern_type == "hourly" else TR.daily_traffic(f)

    def statistics(self, start=None, end=None) -> DataFrame:
        return TR.statistics(self._filter(start, end))


class Dashboard:
    """Page-1 charts over the page filter (dates, statuses incl. NULL, methods)."""

    def __init__(self, requests: DataFrame, start_date=None, end_date=None,
                 statuses: Sequence | None = None, methods: Sequence[str] | None = None):
        self.requests = requests  # choices do not narrow with the selection
        self.df = FL.filter_page(requests, start_date, end_date, statuses, methods)

    def domains(self) -> DataFrame:
        return FL.filter_domains(self.requests)

    def status_distribution(self) -> DataFrame:
        return DS.status_distribution(self.df)

    def top_endpoints(self) -> DataFrame:
        return DS.top_endpoints(self.df, 20)

    def method_distribution(self) -> DataFrame:
        return DS.method_share(self.df)

    def content_size_distribution(self) -> tuple[DataFrame, DataFrame]:
        counts = SZ.size_counts(self.df)
        return SZ.nice_histogram_of(counts, 50), SZ.stats_of(counts)

    def host_frequency(self) -> DataFrame:
        return DS.top_hosts_share(self.df, 20)

    def hourly_traffic(self) -> DataFrame:
        return TR.hourly_traffic(self.df)

    def daily_traffic(self) -> DataFrame:
        return TR.weekday_traffic(self.df)

    def totals(self) -> DataFrame:
        return TR.page_totals(self.df)

    def raw_rows(self) -> DataFrame:
        return self.df
