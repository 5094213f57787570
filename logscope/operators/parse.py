"""Parsing: raw lines -> typed request table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.functions import parse as X
from logscope.functions import patterns as P

PARSED_COLUMNS = ["host", "timestamp", "method", "endpoint", "protocol", "status", "content_size"]
REQUEST_COLUMNS = ["host", "method", "endpoint", "protocol", "status", "content_size", "time"]


def parse_log(lines: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """One projection of the five patterns (B6). A narrow map: no shuffle,
    and Catalyst prunes any field a later step does not read. ``keep`` names other
    columns of ``lines`` to carry along."""
    v = F.col(value)
    return lines.select(
        *keep,
        X.host(v).alias("host"),
        X.timestamp_text(v).alias("timestamp"),
        X.method(v).alias("method"),
        X.endpoint(v).alias("endpoint"),
        X.protocol(v).alias("protocol"),
        X.status(v).alias("status"),
        X.content_size(v).alias("content_size"),
    )


def fill_content_size(parsed: DataFrame) -> DataFrame:
    """NULL sizes (``-``, missing, overflow) become 0."""
    return parsed.na.fill({"content_size": 0})


def with_time(parsed: DataFrame) -> DataFrame:
    """Replace the ``timestamp`` text by a wall-clock ``time``."""
    return parsed.select("*", X.clf_time("timestamp").alias("time")).drop("timestamp")


def with_instant(parsed: DataFrame) -> DataFrame:
    """Zone-aware parse (B10): wall clock plus epoch seconds of the instant."""
    return parsed.select("*", X.clf_time("timestamp").alias("time"),
                         X.clf_instant_epoch("timestamp").alias("instant_epoch"))


def requests_table(lines: DataFrame, instant: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """The request table ``R``: parse, fill sizes, convert time. ``instant``
    adds ``instant_epoch``, for filters by bounds with a zone."""
    parsed = fill_content_size(parse_log(lines, keep=keep))
    return with_instant(parsed).drop("timestamp") if instant else with_time(parsed)


def parse_no_match(lines: DataFrame, value: str = "value", sentinel: str = "no match") -> DataFrame:
    """Host and request fields with a sentinel where the pattern fails."""
    v = F.col(value)
    req_ok = v.rlike(P.REQUEST_PATTERN)
    host_ok = v.rlike(P.HOST_PATTERN)
    return lines.select(
        F.when(host_ok, X.host(v)).otherwise(F.lit(sentinel)).alias("host"),
        F.when(req_ok, X.method(v)).otherwise(F.lit(sentinel)).alias("method"),
        F.when(req_ok, X.endpoint(v)).otherwise(F.lit(sentinel)).alias("endpoint"),
        F.when(req_ok, X.protocol(v)).otherwise(F.lit(sentinel)).alias("protocol"),
    )
