"""Named queries over the driver tables and their DuckDB oracle SQL.

Every query starts from the ``events`` table, derives one log line per
event, parses it and runs one operator on the whole result. ``QUERIES``
maps a name to ``fn(spark, sf_dir) -> DataFrame``; ``ORACLE`` maps the
same name to DuckDB SQL (absent for model-based, non-SQL operators).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logscope.functions import patterns as P
from logscope.functions.numeric import round_to
from logscope.operators import anomalies as AN
from logscope.operators import breakdowns as BD
from logscope.operators import changepoints as CP
from logscope.operators import daily as DY
from logscope.operators import distributions as DS
from logscope.operators import features as FT
from logscope.operators import forecast as FC
from logscope.operators import filters as FL
from logscope.operators import quality as Q
from logscope.operators import ranks as RK
from logscope.operators import rollups as RU
from logscope.operators import segments as SG
from logscope.operators import sizes as SZ
from logscope.operators import table as TB
from logscope.operators import traffic as TR
from logscope.operators.parse import (
    REQUEST_COLUMNS, fill_content_size, parse_log, parse_no_match, requests_table, with_instant)
from logscope.operators.service import Dashboard, LogService
from logscope.plans.oracle import (
    day_sql, hour_range_sql, hour_sql, invalid_method_sql, invalid_protocol_sql, sql_str,
    status_category_sql, status_code_sql, time_sql, weekday_abbr_sql, weekday_index_sql,
    weekday_name_sql, with_base)
from logscope.session import shared_path
from logscope.sources.incremental import ingest, read_loaded
from logscope.sources.sinks import materialize_parsed, materialize_requests, read_requests, requests_from_parsed, write_result
from logscope.streaming import append_parsed_logs, parsed_log_stream
from logscope.sources.logs import load_log_lines, log_lines_from_events, read_log_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _served(spark: SparkSession, sf: str) -> tuple[str, str]:
    """A table is served to the Spark application that made it, and to no later one."""
    return spark.sparkContext.applicationId, sf


_REQUESTS_OVERRIDE: dict[tuple[str, str], DataFrame] = {}


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return load_log_lines(spark, sf)


_PARSED_OVERRIDE: dict[tuple[str, str], DataFrame] = {}


def use_materialized_parsed(spark: SparkSession, sf: str, table: DataFrame | None) -> None:
    """Serve both the parsed table and ``R`` for (spark, sf) from one
    materialised parsed table (``materialize_parsed``); ``None`` restores
    the parse path."""
    key = _served(spark, sf)
    if table is None:
        _PARSED_OVERRIDE.pop(key, None)
        _REQUESTS_OVERRIDE.pop(key, None)
    else:
        _PARSED_OVERRIDE[key] = table
        _REQUESTS_OVERRIDE[key] = requests_from_parsed(table)


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    m = _PARSED_OVERRIDE.get(_served(spark, sf))
    if m is not None:
        return m.select("host", "timestamp", "method", "endpoint", "protocol", "status", "content_size")
    return parse_log(lines(spark, sf))


def filled(spark: SparkSession, sf: str) -> DataFrame:
    return fill_content_size(parsed(spark, sf))


def use_materialized(spark: SparkSession, sf: str, requests: DataFrame | None) -> None:
    """Serve ``R`` for (spark, sf) from a materialised request table (A6),
    e.g. ``read_requests(spark, path)``; ``None`` restores the parse path."""
    key = _served(spark, sf)
    if requests is None:
        _REQUESTS_OVERRIDE.pop(key, None)
        _PARSED_OVERRIDE.pop(key, None)
    else:
        _REQUESTS_OVERRIDE[key] = requests


def R(spark: SparkSession, sf: str) -> DataFrame:
    """The request table: derived lines parsed on the fly, or the
    materialised parquet table when one was registered."""
    m = _REQUESTS_OVERRIDE.get(_served(spark, sf))
    if m is not None:
        return m  # the seven columns plus the partition column ``date``
    return requests_table(lines(spark, sf))


def rows(df: DataFrame) -> DataFrame:
    """The seven request columns (drops ``date`` of the materialised table)."""
    return df.select(*REQUEST_COLUMNS)


def _cast_big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def _dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


# Parameters of the filtered service / page queries (the feature under test).
SERVICE_START = "2024-01-05 06:00:00"
SERVICE_END = "2024-01-20 18:30:00"
SERVICE_METHODS = ["GET", "POST"]
PAGE_START = "2024-01-03"
PAGE_END = "2024-01-20"
PAGE_STATUSES = [200, 304, 404, None]
PAGE_METHODS = ["GET", "HEAD"]

R_COLS = "host, method, endpoint, protocol, status, content_size, time"

# ---------------------------------------------------------------- A: scans


@register("scan_log_lines", with_base("SELECT value FROM lines"))
def q_scan_log_lines(spark, sf):
    """Text scan (A1): derived lines are written as text to the shared
    folder once and read back with ``spark.read.text``."""
    path = shared_path(spark, "loglines")
    lines(spark, sf).write.mode("overwrite").text(path)
    return read_log_text(spark, path)


@register("scan_multi", with_base("SELECT value FROM lines"))
def q_scan_multi(spark, sf):
    """Multi-file combine (A2): two text files (first and second half of
    the month, like July and August) read as one union-all scan."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    day = F.dayofmonth("ts")
    p1, p2 = shared_path(spark, "log-part1"), shared_path(spark, "log-part2")
    log_lines_from_events(ev.where(day <= 15)).write.mode("overwrite").text(p1)
    log_lines_from_events(ev.where((day > 15) | day.isNull())).write.mode("overwrite").text(p2)
    return read_log_text(spark, [p1, p2])


@register("table_shape", with_base("SELECT count(*) AS n_rows, CAST(7 AS INTEGER) AS n_columns FROM r"))
def q_table_shape(spark, sf):
    return TB.table_shape(rows(R(spark, sf)))


# The request table's column types as Spark names them, for the oracle.
R_SCHEMA = [("host", "string"), ("method", "string"), ("endpoint", "string"), ("protocol", "string"),
            ("status", "int"), ("content_size", "int"), ("time", "timestamp_ntz")]


def _schema_sql() -> str:
    arms = [f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS type, "
            f"{_cast_big(f'count_if({c} IS NULL)')} AS null_count FROM r"
            for i, (c, t) in enumerate(R_SCHEMA)]
    return with_base(" UNION ALL ".join(arms))


@register("table_schema", _schema_sql())
def q_table_schema(spark, sf):
    return TB.table_schema(rows(R(spark, sf)))


@register("preview", with_base(
    "SELECT * FROM r ORDER BY " + ", ".join(f"{c} ASC NULLS FIRST" for c in R_COLS.split(", ")) + " LIMIT 10"))
def q_preview(spark, sf):
    return TB.preview(rows(R(spark, sf)), 10)


@register("filtered_rows", with_base(f"SELECT {R_COLS} FROM r WHERE time IS NOT NULL"))
def q_filtered_rows(spark, sf):
    """Raw rows under the dashboard's default selection (A7): all dates,
    every status including NULL, every method."""
    r = R(spark, sf)
    return rows(FL.filter_page(r))


# ---------------------------------------------------------------- B: parse

for _name, _cols in [("parse_host", ["host"]), ("parse_timestamp", ["timestamp"]),
                     ("parse_request", ["method", "endpoint", "protocol"]),
                     ("parse_status", ["status"]), ("parse_content_size", ["content_size"]),
                     ("parse_log", ["host", "timestamp", "method", "endpoint", "protocol", "status",
                                    "content_size"])]:
    def _mk(cols):
        return lambda spark, sf: parsed(spark, sf).select(*cols)
    register(_name, with_base(f"SELECT {', '.join(_cols)} FROM parsed"))(_mk(_cols))


def _no_match_sql() -> str:
    req = f"regexp_matches(value, {sql_str(P.REQUEST_PATTERN)})"
    host = f"regexp_matches(value, {sql_str(P.HOST_PATTERN)})"
    parts = [f"CASE WHEN {host} THEN regexp_extract(value, {sql_str(P.HOST_PATTERN)}, 1) ELSE 'no match' END AS host"]
    for i, name in enumerate(["method", "endpoint", "protocol"], start=1):
        parts.append(f"CASE WHEN {req} THEN regexp_extract(value, {sql_str(P.REQUEST_PATTERN)}, {i}) "
                     f"ELSE 'no match' END AS {name}")
    return with_base(f"SELECT {', '.join(parts)} FROM lines")


@register("parse_no_match", _no_match_sql())
def q_parse_no_match(spark, sf):
    return parse_no_match(lines(spark, sf))


@register("fill_content_size", with_base(
    "SELECT host, timestamp, method, endpoint, protocol, status, content_size FROM filled"))
def q_fill_content_size(spark, sf):
    return filled(spark, sf)


@register("parse_time", with_base(f"SELECT {R_COLS} FROM r"))
def q_parse_time(spark, sf):
    return rows(R(spark, sf))


@register("parse_time_instant", with_base(
    f"SELECT timestamp, {time_sql('timestamp')} AS time, "
    "CAST(epoch(try_strptime(timestamp, '%d/%b/%Y:%H:%M:%S %z')) AS BIGINT) AS instant_epoch FROM parsed"))
def q_parse_time_instant(spark, sf):
    return with_instant(parsed(spark, sf)).select("timestamp", "time", "instant_epoch")


# ---------------------------------------------------------------- C: quality

@register("null_lines", with_base(f"SELECT {_cast_big('count_if(value IS NULL)')} AS null_lines FROM lines"))
def q_null_lines(spark, sf):
    return Q.null_lines(lines(spark, sf))


_PARSED_COLS = ["host", "timestamp", "method", "endpoint", "protocol", "status", "content_size"]


@register("bad_rows", with_base(
    f"SELECT {_cast_big('count_if(' + ' OR '.join(c + ' IS NULL' for c in _PARSED_COLS) + ')')} AS bad_rows "
    "FROM parsed"))
def q_bad_rows(spark, sf):
    return Q.bad_rows(parsed(spark, sf))


def _null_counts_sql(src: str) -> str:
    cols = ", ".join(f"{_cast_big(f'sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)')} AS {c}" for c in _PARSED_COLS)
    return with_base(f"SELECT {cols} FROM {src}")


@register("null_counts", _null_counts_sql("parsed"))
def q_null_counts(spark, sf):
    return Q.null_counts(parsed(spark, sf))


@register("null_counts_filled", _null_counts_sql("filled"))
def q_null_counts_filled(spark, sf):
    return Q.null_counts(filled(spark, sf))


@register("null_status_lines", with_base(
    f"SELECT {_cast_big('count_if(NOT regexp_matches(value, ' + sql_str(P.STATUS_PATTERN) + '))')} "
    "AS null_status_lines FROM lines"))
def q_null_status_lines(spark, sf):
    return Q.null_status_lines(lines(spark, sf))


@register("null_size_lines", with_base(
    f"SELECT {_cast_big('count_if(NOT regexp_matches(value, ' + sql_str(P.SIZE_LINE_PATTERN) + '))')} "
    "AS null_size_lines FROM lines"))
def q_null_size_lines(spark, sf):
    return Q.null_size_lines(lines(spark, sf))


@register("null_size_samples", with_base(
    f"SELECT value FROM lines WHERE NOT regexp_matches(value, {sql_str(P.SIZE_LINE_PATTERN)}) "
    "ORDER BY value LIMIT 10"))
def q_null_size_samples(spark, sf):
    return Q.null_size_samples(lines(spark, sf), 10)


@register("distinct_per_column", with_base("SELECT " + ", ".join(
    f"{_cast_big(f'count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)')} AS {c}"
    for c in _PARSED_COLS) + " FROM filled"))
def q_distinct_per_column(spark, sf):
    return Q.distinct_per_column(filled(spark, sf))


@register("method_freq", with_base("SELECT method, count(*) AS count FROM parsed GROUP BY method"))
def q_method_freq(spark, sf):
    return Q.frequency(parsed(spark, sf), "method")


@register("protocol_freq", with_base("SELECT protocol, count(*) AS count FROM parsed GROUP BY protocol"))
def q_protocol_freq(spark, sf):
    return Q.frequency(parsed(spark, sf), "protocol")


@register("invalid_share", with_base(f"""SELECT total_count, invalid_method_count, invalid_protocol_count,
  {_dbl('invalid_method_count')} / {_dbl('total_count')} * 100 AS method_influence_pct,
  {_dbl('invalid_protocol_count')} / {_dbl('total_count')} * 100 AS protocol_influence_pct
FROM (SELECT count(*) AS total_count,
  {_cast_big(f'count_if({invalid_method_sql()})')} AS invalid_method_count,
  {_cast_big(f'count_if({invalid_protocol_sql()})')} AS invalid_protocol_count FROM filled)"""))
def q_invalid_share(spark, sf):
    return Q.invalid_share(filled(spark, sf))


@register("invalid_by_timestamp", with_base(
    f"SELECT timestamp, {_cast_big(f'count_if({invalid_method_sql()})')} AS invalid_method_count, "
    "count(*) AS total_count FROM filled GROUP BY timestamp"))
def q_invalid_by_timestamp(spark, sf):
    return Q.invalid_by_timestamp(filled(spark, sf))


def _describe_sql(src: str, cols: list[str], where: str = "TRUE") -> str:
    aggs = []
    for c in cols:
        x = _dbl(c)
        aggs += [f"{_dbl(f'count({x})')} AS {c}__count", f"avg({x}) AS {c}__mean",
                 f"stddev_samp({x}) AS {c}__stddev", f"min({x}) AS {c}__min", f"max({x}) AS {c}__max"]
    arms = []
    for s in ["count", "mean", "stddev", "min", "max"]:
        vals = ", ".join(f"round({c}__{s}, 6) AS {c}" for c in cols)
        arms.append(f"SELECT '{s}' AS summary, {vals} FROM w")
    return with_base(" UNION ALL ".join(arms), f"w AS (SELECT {', '.join(aggs)} FROM {src} WHERE {where})")


@register("invalid_describe", _describe_sql("filled", ["status", "content_size"], invalid_method_sql()))
def q_invalid_describe(spark, sf):
    return Q.invalid_describe(filled(spark, sf))


def _split_sql(invalid: str, valid_label: str, invalid_label: str) -> str:
    share = lambda c: f"{_dbl(c)} / {_dbl('total')} * 100"
    return with_base(
        f"SELECT '{valid_label}' AS label, total - bad AS count, {share('total - bad')} AS share_pct FROM s "
        f"UNION ALL SELECT '{invalid_label}' AS label, bad AS count, {share('bad')} AS share_pct FROM s",
        f"s AS (SELECT count(*) AS total, {_cast_big(f'count_if({invalid})')} AS bad FROM filled)")


@register("valid_split_method", _split_sql(invalid_method_sql(), "Valid Methods", "Invalid Methods"))
def q_valid_split_method(spark, sf):
    return Q.valid_split_method(filled(spark, sf))


@register("valid_split_protocol", _split_sql(invalid_protocol_sql(), "Valid Protocol", "Invalid Protocol"))
def q_valid_split_protocol(spark, sf):
    return Q.valid_split_protocol(filled(spark, sf))


# ---------------------------------------------------------------- D: filters

def _in_list(vals) -> str:
    return ", ".join(sql_str(v) if isinstance(v, str) else str(v) for v in vals)


@register("filter_time_methods", with_base(
    f"SELECT {R_COLS} FROM r WHERE time >= TIMESTAMP '{SERVICE_START}' AND time <= TIMESTAMP '{SERVICE_END}' "
    f"AND method IN ({_in_list(SERVICE_METHODS)})"))
def q_filter_time_methods(spark, sf):
    return rows(FL.filter_time_methods(R(spark, sf), SERVICE_START, SERVICE_END, SERVICE_METHODS))


_PAGE_WHERE = (f"CAST(time AS DATE) >= DATE '{PAGE_START}' AND CAST(time AS DATE) <= DATE '{PAGE_END}' "
               f"AND (status IN ({_in_list([s for s in PAGE_STATUSES if s is not None])}) OR status IS NULL) "
               f"AND method IN ({_in_list(PAGE_METHODS)})")


def _page(spark, sf):
    return FL.filter_page(R(spark, sf), PAGE_START, PAGE_END, PAGE_STATUSES, PAGE_METHODS)


@register("filter_page", with_base(f"SELECT {R_COLS} FROM r WHERE {_PAGE_WHERE}"))
def q_filter_page(spark, sf):
    return rows(_page(spark, sf))


@register("filter_domains", with_base(
    "SELECT 'min_date' AS domain, CAST(min(CAST(time AS DATE)) AS VARCHAR) AS value FROM r "
    "UNION ALL SELECT 'max_date', CAST(max(CAST(time AS DATE)) AS VARCHAR) FROM r "
    "UNION ALL SELECT DISTINCT 'status', CAST(status AS VARCHAR) FROM r "
    "UNION ALL SELECT DISTINCT 'method', method FROM r"))
def q_filter_domains(spark, sf):
    return FL.filter_domains(R(spark, sf))


# ---------------------------------------------------------------- E: aggregates

@register("status_distribution", with_base(
    f"SELECT {status_category_sql()} AS status_category, count(*) AS count FROM r GROUP BY 1"))
def q_status_distribution(spark, sf):
    return DS.status_distribution(R(spark, sf))


_STATUS_FREQ = with_base("SELECT status, count(*) AS count FROM r GROUP BY status")


@register("status_freq", _STATUS_FREQ)
def q_status_freq(spark, sf):
    return DS.status_freq(R(spark, sf))


@register("status_freq_desc", _STATUS_FREQ)
def q_status_freq_desc(spark, sf):
    return DS.status_freq_desc(R(spark, sf))


@register("status_log_freq", with_base(
    "SELECT status, count(*) AS count, round(ln(CAST(count(*) AS DOUBLE)), 9) AS log_count FROM r GROUP BY status"))
def q_status_log_freq(spark, sf):
    return DS.status_log_freq(R(spark, sf))


@register("content_size_freq", with_base("SELECT content_size, count(*) AS count FROM r GROUP BY content_size"))
def q_content_size_freq(spark, sf):
    return DS.content_size_freq(R(spark, sf))


_METHOD_COUNTS = with_base("SELECT method, count(*) AS count FROM r GROUP BY method")


@register("method_freq_sorted", _METHOD_COUNTS)
def q_method_freq_sorted(spark, sf):
    return DS.method_freq(R(spark, sf))


@register("unique_methods", with_base("SELECT DISTINCT method FROM r"))
def q_unique_methods(spark, sf):
    return DS.unique_methods(R(spark, sf))


@register("method_distribution", _METHOD_COUNTS)
def q_method_distribution(spark, sf):
    return DS.method_distribution(FL.filter_time_methods(R(spark, sf)))


@register("method_distribution_window", with_base(
    f"SELECT method, count(*) AS count FROM r WHERE time >= TIMESTAMP '{SERVICE_START}' "
    f"AND time <= TIMESTAMP '{SERVICE_END}' GROUP BY method"))
def q_method_distribution_window(spark, sf):
    return DS.method_distribution(FL.filter_time_methods(R(spark, sf), SERVICE_START, SERVICE_END))


@register("method_share", with_base(
    "SELECT method, count(*) AS count, round(CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM r) AS DOUBLE)"
    " * 100, 2) AS percentage FROM r GROUP BY method"))
def q_method_share(spark, sf):
    return DS.method_share(R(spark, sf))


def _top_sql(key: str, k: int, where: str = "TRUE") -> str:
    return with_base(f"SELECT {key}, count(*) AS count FROM r WHERE {where} GROUP BY {key} "
                     f"ORDER BY count DESC, {key} ASC NULLS FIRST LIMIT {k}")


@register("top_endpoints", _top_sql("endpoint", 20))
def q_top_endpoints(spark, sf):
    return DS.top_endpoints(R(spark, sf), 20)


@register("top_endpoints_filtered", _top_sql(
    "endpoint", 20, f"time >= TIMESTAMP '{SERVICE_START}' AND time <= TIMESTAMP '{SERVICE_END}' "
    f"AND method IN ({_in_list(SERVICE_METHODS)})"))
def q_top_endpoints_filtered(spark, sf):
    r = FL.filter_time_methods(R(spark, sf), SERVICE_START, SERVICE_END, SERVICE_METHODS)
    return DS.top_endpoints(r, 20)


@register("top_error_endpoints", _top_sql("endpoint", 10, "status <> 200"))
def q_top_error_endpoints(spark, sf):
    return DS.top_error_endpoints(R(spark, sf), 10)


@register("top_hosts", _top_sql("host", 20))
def q_top_hosts(spark, sf):
    return DS.top_hosts(R(spark, sf), 20)


@register("top_hosts_10", _top_sql("host", 10))
def q_top_hosts_10(spark, sf):
    return DS.top_hosts(R(spark, sf), 10)


@register("top_hosts_share", with_base(
    "SELECT host, count, round(CAST(count AS DOUBLE) / CAST((SELECT sum(count) FROM t) AS DOUBLE) * 100, 2) "
    "AS percentage FROM t",
    "t AS (SELECT host, count(*) AS count FROM r GROUP BY host ORDER BY count DESC, host LIMIT 20)"))
def q_top_hosts_share(spark, sf):
    return DS.top_hosts_share(R(spark, sf), 20)


@register("unique_hosts", with_base("SELECT count(DISTINCT host) AS unique_hosts FROM r"))
def q_unique_hosts(spark, sf):
    return DY.unique_hosts(R(spark, sf))


@register("host_day_distinct", with_base(f"SELECT DISTINCT host, {day_sql()} AS day FROM r"))
def q_host_day_distinct(spark, sf):
    return DY.host_day_distinct(R(spark, sf))


@register("daily_unique_hosts", with_base(
    f"SELECT {day_sql()} AS day, count(DISTINCT host) AS total_hosts FROM r GROUP BY 1"))
def q_daily_unique_hosts(spark, sf):
    return DY.daily_unique_hosts(R(spark, sf))


@register("daily_requests", with_base(f"SELECT {day_sql()} AS day, count(*) AS total_reqs FROM r GROUP BY 1"))
def q_daily_requests(spark, sf):
    return DY.daily_requests(R(spark, sf))


_DAY_TABLE_CTE = (f"d AS (SELECT a.day, a.total_reqs, b.total_hosts, "
                  f"CAST(a.total_reqs AS DOUBLE) / CAST(b.total_hosts AS DOUBLE) AS avg_reqs "
                  f"FROM (SELECT {day_sql()} AS day, count(*) AS total_reqs FROM r GROUP BY 1) a "
                  f"JOIN (SELECT {day_sql()} AS day, count(DISTINCT host) AS total_hosts FROM r GROUP BY 1) b "
                  f"ON a.day = b.day)")


@register("avg_daily_requests_per_host", with_base("SELECT day, total_reqs, total_hosts, avg_reqs FROM d",
                                                   _DAY_TABLE_CTE))
def q_avg_daily_requests_per_host(spark, sf):
    return DY.avg_daily_requests_per_host(R(spark, sf))


@register("content_size_summary", with_base(
    "SELECT min(content_size) AS min_content_size, max(content_size) AS max_content_size, "
    "round(avg(CAST(content_size AS DOUBLE)), 6) AS mean_content_size, "
    "round(stddev_samp(CAST(content_size AS DOUBLE)), 6) AS std_content_size, "
    "count(content_size) AS count_content_size FROM r"))
def q_content_size_summary(spark, sf):
    return SZ.content_size_summary(R(spark, sf))


@register("content_size_describe", _describe_sql("r", ["content_size"]))
def q_content_size_describe(spark, sf):
    return SZ.content_size_describe(R(spark, sf))


def _hist_sql(bins: int = 50) -> str:
    nb = float(bins)

    def edge(i):
        return (f"(CASE WHEN {i} = {bins} THEN last ELSE CAST({i} AS DOUBLE) * ((last - first) / {nb!r}::DOUBLE) "
                f"+ first END)")
    ctes = [
        "x AS (SELECT CAST(content_size AS DOUBLE) / 1024.0::DOUBLE AS x FROM r WHERE content_size IS NOT NULL)",
        "g AS (SELECT CASE WHEN count(x) = 0 THEN 0.0::DOUBLE WHEN min(x) = max(x) THEN min(x) - 0.5 "
        "ELSE min(x) END AS first, CASE WHEN count(x) = 0 THEN 1.0::DOUBLE WHEN min(x) = max(x) "
        "THEN max(x) + 0.5 ELSE max(x) END AS last FROM x)",
        f"b0 AS (SELECT x, first, last, CASE WHEN i = {bins} THEN {bins - 1} ELSE i END AS i0 FROM "
        f"(SELECT x, first, last, CAST(floor(((x - first) / (last - first)) * {nb!r}::DOUBLE) AS BIGINT) AS i "
        f"FROM x, g))",
        f"b1 AS (SELECT x, first, last, CASE WHEN x < {edge('i0')} THEN i0 - 1 ELSE i0 END AS i1 FROM b0)",
        f"b2 AS (SELECT CASE WHEN x >= {edge('(i1 + 1)')} AND i1 <> {bins - 1} THEN i1 + 1 ELSE i1 END AS bin "
        f"FROM b1)",
        "c AS (SELECT bin, count(*) AS count FROM b2 GROUP BY bin)",
        f"axis AS (SELECT range AS bin, first, last FROM range(0, {bins}), g)",
    ]
    body = (f"SELECT a.bin AS bin, {edge('a.bin')} AS bin_start, {edge('(a.bin + 1)')} AS bin_end, "
            "coalesce(c.count, 0) AS count FROM axis a LEFT JOIN c ON a.bin = c.bin")
    return with_base(body, *ctes)


@register("size_histogram", _hist_sql(50))
def q_size_histogram(spark, sf):
    return SZ.size_histogram(R(spark, sf), 50)


@register("size_stats_kb", with_base(
    "SELECT round(avg(CAST(content_size AS DOUBLE) / 1024.0::DOUBLE), 6) AS mean_kb, "
    "quantile_cont(CAST(content_size AS DOUBLE), 0.5) / 1024.0::DOUBLE AS median_kb, "
    "max(CAST(content_size AS DOUBLE) / 1024.0::DOUBLE) AS max_kb, "
    "min(CAST(content_size AS DOUBLE) / 1024.0::DOUBLE) AS min_kb FROM r"))
def q_size_stats_kb(spark, sf):
    return SZ.size_stats_kb(R(spark, sf))


def _nice_sql(max_bins: int = 50) -> str:
    cands = []
    for e in range(-6, 16):
        for m in SZ.NICE_STEPS:
            w = float(f"{m:g}e{e}")
            cands.append(f"CASE WHEN raw <= {w!r}::DOUBLE THEN {w!r}::DOUBLE END")
    ctes = [
        "x AS (SELECT CAST(content_size AS DOUBLE) / 1024.0::DOUBLE AS x FROM r WHERE content_size IS NOT NULL)",
        f"g0 AS (SELECT min(x) AS lo, (max(x) - min(x)) / {float(max_bins)!r}::DOUBLE AS raw FROM x)",
        f"g AS (SELECT lo, least({', '.join(cands)}) AS w FROM g0)",
        "g2 AS (SELECT w, floor(lo / w) AS base FROM g)",
        "c AS (SELECT CAST(floor(x / w) - base AS BIGINT) AS bin, count(*) AS count FROM x, g2 GROUP BY 1)",
    ]
    body = ("SELECT bin, CAST(bin + base AS DOUBLE) * w AS bin_start, CAST(bin + base + 1 AS DOUBLE) * w AS bin_end,"
            " count FROM c, g2")
    return with_base(body, *ctes)


@register("size_histogram_nice", _nice_sql(50))
def q_size_histogram_nice(spark, sf):
    return SZ.size_histogram_nice(R(spark, sf), 50)


_TOP5 = "t5 AS (SELECT host, count(*) AS total_requests FROM r GROUP BY host ORDER BY total_requests DESC, host LIMIT 5)"


@register("top5_hosts", with_base("SELECT host, total_requests FROM t5", _TOP5))
def q_top5_hosts(spark, sf):
    return BD.top5_hosts(R(spark, sf))


@register("top5_host_weekday", with_base(
    f"SELECT {weekday_abbr_sql()} AS weekday, host, count(*) AS count FROM r "
    "WHERE host IN (SELECT host FROM t5) GROUP BY 1, 2", _TOP5))
def q_top5_host_weekday(spark, sf):
    return BD.top5_host_weekday(R(spark, sf))


@register("top5_host_hour", with_base(
    f"SELECT {hour_sql()} AS hour, host, count(*) AS count FROM r WHERE host IN (SELECT host FROM t5) GROUP BY 1, 2",
    _TOP5))
def q_top5_host_hour(spark, sf):
    return BD.top5_host_hour(R(spark, sf))


@register("hourly_status_counts", with_base(
    "SELECT * FROM (SELECT " + hour_sql() + " AS hour, " + ", ".join(
        f"{_cast_big(f'count_if(status >= {lo} AND status < {hi})')} AS count_{lab}"
        for lab, lo, hi in P.STATUS_CODES) + " FROM r GROUP BY 1) WHERE " + " OR ".join(
        f"count_{lab} > 0" for lab, _, _ in P.STATUS_CODES)))
def q_hourly_status_counts(spark, sf):
    return BD.hourly_status_counts(R(spark, sf))


@register("hourly_status_long", with_base(
    f"SELECT {status_code_sql()} AS status_code, {hour_sql()} AS hour, count(*) AS count FROM r "
    "WHERE status BETWEEN 200 AND 499 GROUP BY 1, 2"))
def q_hourly_status_long(spark, sf):
    return BD.hourly_status_long(R(spark, sf))


@register("hourly_method_counts", with_base(
    f"SELECT {hour_sql()} AS hour, method, count(*) AS count FROM r GROUP BY 1, 2"))
def q_hourly_method_counts(spark, sf):
    return BD.hourly_method_counts(R(spark, sf))


@register("hourly_method_pivot", with_base(
    f"SELECT {hour_sql()} AS hour, " + ", ".join(
        f"{_cast_big(f'count_if(method = {sql_str(m)})')} AS \"{m}\"" for m in P.PIVOT_METHODS)
    + f" FROM r WHERE method IN ({_in_list(P.PIVOT_METHODS)}) GROUP BY 1"))
def q_hourly_method_pivot(spark, sf):
    return BD.hourly_method_pivot(R(spark, sf))


def _totals_sql() -> str:
    items = [(lab, f"status >= {lo} AND status < {hi}") for lab, lo, hi in P.STATUS_CODES]
    items += [(m, f"method = {sql_str(m)}") for m in P.PIVOT_METHODS]
    aggs = ", ".join(f"{_cast_big(f'count_if({cond})')} AS c{i}" for i, (_, cond) in enumerate(items))
    arms = " UNION ALL ".join(f"SELECT {i} AS position, {sql_str(lab)} AS metric, c{i} AS count FROM w"
                              for i, (lab, _) in enumerate(items))
    return with_base(arms, f"w AS (SELECT {aggs} FROM r)")


@register("status_method_totals", _totals_sql())
def q_status_method_totals(spark, sf):
    return BD.status_method_totals(R(spark, sf))


@register("endpoints_weekday_status", with_base(
    f"SELECT {weekday_abbr_sql()} AS weekday, {status_code_sql()} AS status_code, "
    "count(endpoint) AS total_endpoints FROM r WHERE status BETWEEN 200 AND 499 GROUP BY 1, 2"))
def q_endpoints_weekday_status(spark, sf):
    return BD.endpoints_weekday_status(R(spark, sf))


@register("endpoints_by_status", with_base(
    f"SELECT {status_code_sql()} AS status_code, count(endpoint) AS total_endpoints FROM r "
    "WHERE status BETWEEN 200 AND 499 GROUP BY 1"))
def q_endpoints_by_status(spark, sf):
    return BD.endpoints_by_status(R(spark, sf))


def _unique_sql(target: str, out: str, lo: int, hi: int, extra: str = "TRUE") -> str:
    inner = (f"SELECT {weekday_abbr_sql()} AS weekday, {hour_range_sql(hour_sql())} AS hour_range, {target} "
             f"FROM r WHERE status >= {lo} AND status < {hi} AND {extra}")
    return with_base(f"SELECT weekday, hour_range, count(DISTINCT {target}) AS {out} FROM ({inner}) "
                     "WHERE weekday IS NOT NULL AND hour_range IS NOT NULL GROUP BY 1, 2")


for _name, _lo, _hi in [("unique_endpoints_2xx", 200, 300), ("unique_endpoints_4xx", 400, 600)]:
    def _mk_e(lo, hi):
        return lambda spark, sf: BD.unique_endpoints_by_status(R(spark, sf), lo, hi)
    register(_name, _unique_sql("endpoint", "unique_endpoints", _lo, _hi, "method = 'GET'"))(_mk_e(_lo, _hi))

for _name, _lo, _hi in [("unique_hosts_2xx", 200, 300), ("unique_hosts_4xx", 400, 600)]:
    def _mk_h(lo, hi):
        return lambda spark, sf: BD.unique_hosts_by_status(R(spark, sf), lo, hi)
    register(_name, _unique_sql("host", "unique_hosts", _lo, _hi))(_mk_h(_lo, _hi))


@register("hourly_traffic", with_base(
    f"SELECT {hour_sql()} AS hour, count(*) AS count FROM r WHERE time IS NOT NULL GROUP BY 1"))
def q_hourly_traffic(spark, sf):
    return TR.hourly_traffic(R(spark, sf))


@register("daily_traffic", with_base(
    f"SELECT {weekday_name_sql()} AS day, count(*) AS count FROM r WHERE time IS NOT NULL GROUP BY 1"))
def q_daily_traffic(spark, sf):
    return TR.daily_traffic(R(spark, sf))


@register("weekday_traffic", with_base(
    f"SELECT {weekday_name_sql()} AS day, count(*) AS count, {weekday_index_sql()} AS sort_key FROM r "
    "WHERE time IS NOT NULL GROUP BY 1, 3"))
def q_weekday_traffic(spark, sf):
    return TR.weekday_traffic(R(spark, sf))


_STATS_BODY = (
    "SELECT count(*) AS total_requests, count(DISTINCT host) AS unique_hosts, "
    "round(CAST(sum(content_size) AS DOUBLE) / 1048576.0::DOUBLE, 6) AS total_data_mb, "
    "round(avg(CAST(content_size AS DOUBLE)) / 1024.0::DOUBLE, 6) AS avg_response_size_kb, "
    "round(CAST(count_if(status BETWEEN 200 AND 299) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100, 6) "
    "AS success_rate FROM r")


@register("statistics", with_base(_STATS_BODY))
def q_statistics(spark, sf):
    return TR.statistics(R(spark, sf))


@register("statistics_window", with_base(
    _STATS_BODY + f" WHERE time >= TIMESTAMP '{SERVICE_START}' AND time <= TIMESTAMP '{SERVICE_END}'"))
def q_statistics_window(spark, sf):
    return TR.statistics(FL.filter_time_methods(R(spark, sf), SERVICE_START, SERVICE_END))


@register("page_totals", with_base(
    "SELECT count(*) AS total_requests, count(DISTINCT host) AS unique_hosts, "
    "round(CAST(sum(content_size) AS DOUBLE) / 1048576.0::DOUBLE, 6) AS total_data_mb "
    f"FROM r WHERE {_PAGE_WHERE}"))
def q_page_totals(spark, sf):
    return TR.page_totals(_page(spark, sf))


# ---------------------------------------------------------------- M: models


_FEAT_ROUNDED = ["avg_content_size", "std_content_size", "avg_timestamp"]


def _round_cols(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    return df.select(*[round_to(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


_HOST_FEATURES_CTE = (
    "hf AS (SELECT host, count(*) AS total_requests, count(DISTINCT endpoint) AS unique_pages, "
    f"count(DISTINCT {hour_sql()}) AS active_hours, count(DISTINCT {day_sql()}) AS active_days, "
    "avg(CAST(content_size AS DOUBLE)) AS avg_content_size, stddev_samp(CAST(content_size AS DOUBLE)) "
    "AS std_content_size, CAST(sum(CASE WHEN status >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS error_count, "
    "avg(CAST(epoch(time) AS DOUBLE)) AS avg_timestamp FROM r GROUP BY host)")
_HF_COLS = ("host, total_requests, unique_pages, active_hours, active_days, round(avg_content_size, 6) "
            "AS avg_content_size, round(std_content_size, 6) AS std_content_size, error_count, "
            "round(avg_timestamp, 6) AS avg_timestamp")
_DERIVED = ("CASE WHEN total_requests = 0 THEN NULL ELSE CAST(error_count AS DOUBLE) / "
            "CAST(total_requests AS DOUBLE) END AS error_rate, CASE WHEN active_days = 0 THEN NULL ELSE "
            "CAST(total_requests AS DOUBLE) / CAST(active_days AS DOUBLE) END AS requests_per_day")


@register("host_features", with_base(f"SELECT {_HF_COLS} FROM hf", _HOST_FEATURES_CTE))
def q_host_features(spark, sf):
    return _round_cols(FT.host_features(R(spark, sf)), _FEAT_ROUNDED)


@register("host_features_derived", with_base(
    f"SELECT {_HF_COLS}, round(error_rate, 6) AS error_rate, round(requests_per_day, 6) AS requests_per_day "
    f"FROM (SELECT *, {_DERIVED} FROM hf)", _HOST_FEATURES_CTE))
def q_host_features_derived(spark, sf):
    return _round_cols(FT.host_features_derived(R(spark, sf)), _FEAT_ROUNDED + ["error_rate", "requests_per_day"])


def _scaled_sql() -> str:
    ready = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0::DOUBLE) AS {c}" for c in FT.FEATURES)
    zs = ", ".join(
        f"round(CASE WHEN stddev_samp({c}) OVER () = 0 THEN 0.0::DOUBLE ELSE ({c} - avg({c}) OVER ()) / "
        f"stddev_samp({c}) OVER () END, 6) AS z_{c}" for c in FT.FEATURES)
    return with_base(f"SELECT host, {zs} FROM x", _HOST_FEATURES_CTE,
                     f"x AS (SELECT host, {ready} FROM (SELECT *, {_DERIVED} FROM hf))")


@register("host_features_scaled", _scaled_sql())
def q_host_features_scaled(spark, sf):
    return FT.host_features_scaled(R(spark, sf))


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _pca_ctes(k: int = 3) -> list[str]:
    """CTEs ending in ``p(key, x, z)``: components and z-scores of each host. An
    eigenvector is what repeated squaring of the correlation matrix converges to;
    it is then taken out of the matrix, and the next one follows."""
    d = len(FT.FEATURES)
    ready = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0::DOUBLE) AS {c}" for c in FT.FEATURES)
    z = ", ".join(f"CASE WHEN stddev_samp({c}) OVER () = 0 THEN 0.0::DOUBLE ELSE ({c} - avg({c}) OVER ()) / "
                  f"stddev_samp({c}) OVER () END" for c in FT.FEATURES)
    rows = ", ".join("[" + ", ".join(f"covar_samp(z[{i}], z[{j}])" for j in range(1, d + 1)) + "]" for i in range(1, d + 1))
    ctes = [_HOST_FEATURES_CTE,
            f"fx AS (SELECT host, {ready} FROM (SELECT *, {_DERIVED} FROM hf))",
            f"fz AS MATERIALIZED (SELECT host, [{z}] AS z FROM fx)",
            f"m1 AS MATERIALIZED (SELECT [{rows}] AS m FROM fz)"]
    for c in range(1, k + 1):
        diag = f"list_transform(range(1, {d + 1}), lambda i: m[i][i])"
        ctes += [
            f"sq{c} AS (SELECT 0 AS s, m FROM m{c} UNION ALL SELECT s + 1, list_transform(n, lambda r: list_transform(r, lambda a: a / "
            f"list_sum(list_transform(range(1, {d + 1}), lambda i: n[i][i])))) FROM (SELECT s, list_transform(m, lambda r: "
            f"list_transform(m, lambda q: list_inner_product(r, q))) AS n FROM sq{c} WHERE s < 40))",
            f"v{c} AS MATERIALIZED (SELECT list_transform(m[j], lambda a: a / sqrt(m[j][j])) AS v FROM "
            f"(SELECT m, list_position({diag}, list_max({diag})) AS j FROM sq{c} WHERE s = 40))",
            f"l{c} AS MATERIALIZED (SELECT v, list_inner_product(v, list_transform(m, lambda r: list_inner_product(r, v))) AS l FROM m{c}, v{c})",
            f"m{c + 1} AS MATERIALIZED (SELECT list_transform(m, lambda r, i: list_transform(r, lambda a, j: a - l * v[i] * v[j])) AS m "
            f"FROM m{c}, l{c})"]
    pcs = ", ".join(f"list_inner_product(z, v{c}.v)" for c in range(1, k + 1))
    return ctes + [f"p AS MATERIALIZED (SELECT host AS key, [{pcs}] AS x, z FROM fz, {', '.join(f'v{c}' for c in range(1, k + 1))})"]


def _kmeans_ctes(d: int, k: int = 4, rounds: int = 20) -> list[str]:
    """CTEs from ``p(key, x, ...)`` to ``lab``, its rows with ``segment``."""
    def sq(q: str) -> str:
        return f"list_sum(list_transform(list_zip(x, {q}), lambda ab: (ab[1] - ab[2]) * (ab[1] - ab[2])))"
    near = f"list_transform(c, lambda q: {sq('q')})"
    means = ", ".join(f"avg(x[{i}])" for i in range(1, d + 1))
    return [
        "ff AS (SELECT 1 AS n, [x] AS c FROM (SELECT x FROM p ORDER BY list_inner_product(x, x) DESC, key LIMIT 1) UNION ALL "
        "SELECT any_value(n) + 1, list_append(any_value(c), first(x ORDER BY far DESC, key)) "
        f"FROM (SELECT n, c, x, key, list_min({near}) AS far FROM ff, p WHERE n < {k}) HAVING count(*) > 0 AND max(far) > 0)",
        "ll AS (SELECT 0 AS r, c FROM ff WHERE n = (SELECT max(n) FROM ff) UNION ALL "
        "SELECT r + 1, list_transform(c, lambda q, i: coalesce(found[i], q)) FROM (SELECT r, c, map_from_entries(list((s, mean))) AS found "
        f"FROM (SELECT r, c, list_position(near, list_min(near)) AS s, [{means}] AS mean FROM "
        f"(SELECT r, c, x, {near} AS near FROM ll, p WHERE r < {rounds}) GROUP BY ALL) GROUP BY r, c))",
        f"lab AS MATERIALIZED (SELECT *, CAST(list_position(near, list_min(near)) - 1 AS INTEGER) AS segment FROM "
        f"(SELECT p.*, {near} AS near FROM p, (SELECT c FROM ll WHERE r = {rounds})))"]


_HOST_LABELS = [*_pca_ctes(), *_kmeans_ctes(3)]
_HOST_CENTERS = "c AS (SELECT segment, " + ", ".join(f"avg(z[{i}]) AS {n}" for i, n in enumerate(FT.FEATURES, 1)) + " FROM lab GROUP BY segment)"


@register("host_pca", _recursive(with_base(
    "SELECT key AS host, round(x[1], 6) AS pc1, round(x[2], 6) AS pc2, round(x[3], 6) AS pc3 FROM p", *_pca_ctes())))
def q_host_pca(spark, sf):
    return FT.host_pca(R(spark, sf))


@register("host_pca_variance", _recursive(with_base(
    " UNION ALL ".join(f"SELECT CAST({c} AS INTEGER) AS component, round(l, 6) AS variance FROM l{c}" for c in (1, 2, 3)), *_pca_ctes())))
def q_host_pca_variance(spark, sf):
    """Variance of each component: the largest eigenvalues."""
    return FT.host_pca_variance(R(spark, sf))


@register("host_segments", _recursive(with_base("SELECT key AS host, segment FROM lab", *_HOST_LABELS)))
def q_host_segments(spark, sf):
    return SG.host_segments(R(spark, sf))


def _silhouette_sql(points: str = "lab", d: int = 3) -> list[str]:
    """CTEs ending in ``si(segment, s)`` from all pairs of points."""
    gap = "list_sum(list_transform(list_zip(a.x, b.x), lambda ab: (ab[1] - ab[2]) * (ab[1] - ab[2])))"
    return [f"pw AS (SELECT a.key, a.segment, b.segment AS other, avg({gap}) AS far FROM {points} a JOIN {points} b ON a.key <> b.key "
            "GROUP BY ALL)",
            "sides AS (SELECT key, segment, max(CASE WHEN other = segment THEN far END) AS a, min(CASE WHEN other <> segment THEN far END) "
            "AS b FROM pw GROUP BY ALL)",
            "si AS (SELECT segment, CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS s "
            "FROM sides)"]


def _evaluation_sql(ctes: list[str], d: int = 3) -> str:
    spread = " + ".join(f"var_pop(x[{i}])" for i in range(1, d + 1))
    return _recursive(with_base(
        "SELECT segment, size, round((SELECT avg(s) FROM si), 6) AS silhouette, round((SELECT sum(v * size) FROM g), 6) AS wssse FROM g",
        *ctes, *_silhouette_sql(), f"g AS (SELECT segment, count(*) AS size, {spread} AS v FROM lab GROUP BY segment)"))


@register("segment_evaluation", _evaluation_sql(_HOST_LABELS))
def q_segment_evaluation(spark, sf):
    return SG.segment_evaluation(R(spark, sf))


_VOLUME_LABELS = [*_pca_ctes(), "lab AS (SELECT key, x, CASE WHEN total_requests < 10 THEN 0 WHEN total_requests < 100 THEN 1 "
                  "WHEN total_requests < 1000 THEN 2 ELSE 3 END AS segment FROM p JOIN hf ON p.key = hf.host)"]


@register("host_label_evaluation", _evaluation_sql(_VOLUME_LABELS))
def q_host_label_evaluation(spark, sf):
    """M5 over the request-volume labels of the hosts."""
    return SG.host_label_evaluation(R(spark, sf))


@register("segment_centers", _recursive(with_base("SELECT segment, " + ", ".join(
    f"round({n}, 6) AS {n}" for n in FT.FEATURES) + " FROM c", *_HOST_LABELS, _HOST_CENTERS)))
def q_segment_centers(spark, sf):
    return _round_cols(SG.segment_centers(R(spark, sf)), FT.FEATURES)


@register("feature_importance", _recursive(with_base(" UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(avg(abs({n})), 6) AS importance FROM c" for n in FT.FEATURES), *_HOST_LABELS, _HOST_CENTERS)))
def q_feature_importance(spark, sf):
    return _round_cols(SG.feature_importance(R(spark, sf)), ["importance"])


@register("cluster_separation", _recursive(with_base(
    "SELECT a.segment AS segment_i, b.segment AS segment_j, round(sqrt(" + " + ".join(
        f"(a.{n} - b.{n}) * (a.{n} - b.{n})" for n in FT.FEATURES) + "), 6) AS distance FROM c a, c b", *_HOST_LABELS, _HOST_CENTERS)))
def q_cluster_separation(spark, sf):
    return _round_cols(SG.host_cluster_separation(R(spark, sf)), ["distance"])


@register("model_comparison")
def q_model_comparison(spark, sf):
    return SG.model_comparison(R(spark, sf))


def _forest_sql(n_trees: int = 100, psi: int = 256, seed: int = 42, contamination: float = 0.1) -> str:
    """The isolation forest as a node table a level (``n0``...), met by all hosts."""
    d, depth = len(FT.FEATURES), 8  # 2^8 = psi
    def hashed(*parts: str) -> str:
        return f"substr(md5(concat_ws(':', {', '.join(parts)})), 1, {AN.DIGITS})"
    def unit(what: str) -> str:
        return f"((CAST('0x' || {hashed(what, 'tree', 'node', str(seed))} AS BIGINT) + 0.5::DOUBLE) / {16 ** AN.DIGITS}::DOUBLE)"
    def mean_path(n: str) -> str:
        return (f"(CASE WHEN {n} > 2 THEN 2.0::DOUBLE * (ln(CAST({n} - 1 AS DOUBLE)) + {AN.EULER}::DOUBLE) - 2.0::DOUBLE * ({n} - 1) / {n} "
                f"WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")
    ready = ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), 0.0::DOUBLE), 6)" for c in FT.FEATURES)
    low, high = (", ".join(f"{f}(x[{i}])" for i in range(1, d + 1)) for f in ("min", "max"))
    trees = f"range({n_trees}) t(tree)"
    ctes = [_HOST_FEATURES_CTE,
            f"fx AS MATERIALIZED (SELECT host, [{ready}] AS x FROM (SELECT *, {_DERIVED} FROM hf))",
            f"par AS MATERIALIZED (SELECT least({psi}, count(*)) AS psi, ceil(log2(greatest(least({psi}, count(*)), 2))) AS depth FROM fx)",
            f"s0 AS MATERIALIZED (SELECT tree, 1 AS node, x FROM (SELECT tree, x, row_number() OVER (PARTITION BY tree ORDER BY "
            f"{hashed('tree', str(seed), 'host')}, host NULLS FIRST) AS place FROM fx, {trees}) WHERE place <= (SELECT psi FROM par))",
            f"d0 AS MATERIALIZED (SELECT host, x, tree, 1 AS node FROM fx, {trees})"]
    for i in range(depth + 1):
        ctes += [
            f"n{i} AS MATERIALIZED (SELECT tree, node, n, f, lo[f] + {unit(chr(39) + 'threshold' + chr(39))} * (hi[f] - lo[f]) AS cut FROM "
            f"(SELECT *, CASE WHEN {i} < (SELECT depth FROM par) AND len(v) > 0 THEN "
            f"v[1 + CAST(floor({unit(chr(39) + 'feature' + chr(39))} * len(v)) AS BIGINT)] END AS f FROM "
            f"(SELECT *, list_filter(range(1, {d + 1}), lambda j: lo[j] < hi[j]) AS v FROM "
            f"(SELECT tree, node, count(*) AS n, [{low}] AS lo, [{high}] AS hi FROM s{i} GROUP BY tree, node))))",
            f"s{i + 1} AS MATERIALIZED (SELECT tree, 2 * node + CAST(x[f] >= cut AS INTEGER) AS node, x FROM s{i} JOIN n{i} USING (tree, node) "
            "WHERE f IS NOT NULL)",
            f"m{i} AS MATERIALIZED (SELECT host, x, tree, node, n, f, cut FROM d{i} LEFT JOIN n{i} USING (tree, node))",
            f"d{i + 1} AS MATERIALIZED (SELECT host, x, tree, 2 * node + CAST(x[f] >= cut AS INTEGER) AS node FROM m{i} WHERE f IS NOT NULL)"]
    ends = " UNION ALL ".join(f"SELECT host, {i * AN.MICRO} + CAST(floor({mean_path('n')} * {AN.MICRO} + 0.5) AS BIGINT) AS p FROM m{i} WHERE f IS NULL" for i in range(depth + 1))
    ctes.append(f"sc AS MATERIALIZED (SELECT host, CASE WHEN (SELECT psi FROM par) < 2 THEN 0.5 ELSE pow(2.0::DOUBLE, -(CAST(sum(p) AS DOUBLE) / "
                f"{n_trees * AN.MICRO}) / (SELECT {mean_path('psi')} FROM par)) END AS s FROM ({ends}) GROUP BY host)")
    return with_base(f"SELECT host, round(s, 6) AS anomaly_score, CASE WHEN s > (SELECT quantile_cont(s, {1.0 - contamination}) FROM sc) "
                     "THEN -1 ELSE 1 END AS label FROM sc", *ctes)


@register("host_anomalies", _forest_sql())
def q_host_anomalies(spark, sf):
    return _round_cols(AN.host_anomalies(R(spark, sf)), ["anomaly_score"])


def _forecast_sql(periods: int = 30, z: float = FC.Z80) -> str:
    ctes = [
        "h AS (SELECT CAST(time AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS y FROM r WHERE time IS NOT NULL "
        "GROUP BY 1)",
        "span AS (SELECT min(ds) AS d0, max(ds) AS d1 FROM h)",
        "hx AS (SELECT ds, y, CAST(ds - d0 AS DOUBLE) AS x FROM h, span)",
        "fit AS (SELECT coalesce(regr_slope(y, x), 0) AS slope, coalesce(regr_intercept(y, x), avg(y)) AS icpt FROM hx)",
        "res AS (SELECT ds, x, CAST(isodow(ds) - 1 AS INTEGER) AS wd, y - (icpt + slope * x) AS resid FROM hx, fit)",
        "eff AS (SELECT wd, avg(resid) AS effect FROM res GROUP BY wd)",
        "sig AS (SELECT stddev_samp(resid - effect) AS sigma FROM res JOIN eff USING (wd))",
        f"fut AS (SELECT CAST(d1 + CAST(i AS INTEGER) AS DATE) AS ds FROM span, range(1, {periods + 1}) t(i))",
        "fx AS (SELECT f.ds, CAST(f.ds - span.d0 AS DOUBLE) AS x, CAST(isodow(f.ds) - 1 AS INTEGER) AS wd "
        "FROM fut f, span)",
        "pr AS (SELECT fx.ds, icpt + slope * fx.x + coalesce(eff.effect, 0.0::DOUBLE) AS yhat, "
        f"{z!r}::DOUBLE * coalesce(sigma, 0.0::DOUBLE) AS band FROM fx LEFT JOIN eff ON fx.wd = eff.wd, fit, sig)",
    ]
    return with_base("SELECT ds, round(yhat, 6) AS yhat, round(yhat - band, 6) AS yhat_lower, "
                     "round(yhat + band, 6) AS yhat_upper FROM pr", *ctes)


@register("traffic_forecast", _forecast_sql())
def q_traffic_forecast(spark, sf):
    return FC.traffic_forecast(R(spark, sf))


def _profile_sql() -> tuple[str, list[str]]:
    """Body and CTEs of the profile rule over ``lab``."""
    f = P.PROFILE_FACTOR
    ctes = ["c AS (SELECT segment, count(*) AS size, avg(avg_reqs) AS avg_requests, "
            "avg(CAST(total_reqs AS DOUBLE)) AS total_requests, avg(CAST(total_hosts AS DOUBLE)) AS unique_hosts "
            "FROM lab GROUP BY segment)",
            "m AS (SELECT avg(avg_requests) AS ma, avg(unique_hosts) AS mh, avg(total_requests) AS mt FROM c)"]
    kind = (f"CASE WHEN avg_requests > ma * {f} THEN {sql_str(P.PROFILE_HIGH_TRAFFIC)} "
            f"WHEN unique_hosts > mh * {f} THEN {sql_str(P.PROFILE_HIGH_USER)} "
            f"WHEN total_requests > mt * {f} THEN {sql_str(P.PROFILE_PEAK)} ELSE {sql_str(P.PROFILE_REGULAR)} END")
    return (f"SELECT CAST(segment AS INTEGER) AS segment, size, round(avg_requests, 6) AS avg_requests, "
            f"round(total_requests, 6) AS total_requests, round(unique_hosts, 6) AS unique_hosts, "
            f"{kind} AS type FROM c, m"), ctes


def _profile_rule_sql(k: int = 4) -> str:
    body, ctes = _profile_sql()
    return with_base(body, _DAY_TABLE_CTE, f"lab AS (SELECT *, ntile({k}) OVER (ORDER BY total_reqs, day) - 1 AS segment FROM d)", *ctes)


_DAY_LABELS = [_DAY_TABLE_CTE, "p AS MATERIALIZED (SELECT day AS key, [avg_reqs, CAST(total_reqs AS DOUBLE), CAST(total_hosts AS DOUBLE)] "
               "AS x, d.* FROM d)", *_kmeans_ctes(3)]


@register("day_segments", _recursive(with_base("SELECT day, avg_reqs, total_reqs, total_hosts, segment FROM lab", *_DAY_LABELS)))
def q_day_segments(spark, sf):
    return SG.day_segments(R(spark, sf))


_DAY_PAIRS = "list_distance(x.x, y.x)"


def _labelled_silhouette_ctes() -> list[str]:
    """CTEs ending in ``s(segment, s)`` over ``lab``: plain Euclidean, by pairs."""
    return [f"pd AS (SELECT x.key AS i, x.segment AS si, y.segment AS sj, avg({_DAY_PAIRS}) AS md FROM lab x JOIN lab y ON x.key <> y.key "
            "GROUP BY ALL)",
            "ab AS (SELECT i, max(CASE WHEN sj = si THEN md END) AS a, min(CASE WHEN sj <> si THEN md END) AS b FROM pd GROUP BY i)",
            "s AS (SELECT lab.segment, CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) <= 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s "
            "FROM lab LEFT JOIN ab ON lab.key = ab.i)"]


@register("day_silhouette", _recursive(with_base(
    "SELECT segment, round(avg(s), 6) AS silhouette, round((SELECT avg(s) FROM s), 6) AS overall_silhouette FROM s GROUP BY segment",
    *_DAY_LABELS, *_labelled_silhouette_ctes())))
def q_day_silhouette(spark, sf):
    return _round_cols(SG.day_silhouette(R(spark, sf)), ["silhouette", "overall_silhouette"])


@register("day_segment_sizes", _recursive(with_base("SELECT segment, count(*) AS count FROM lab GROUP BY segment", *_DAY_LABELS)))
def q_day_segment_sizes(spark, sf):
    return SG.day_segment_sizes(R(spark, sf))


@register("day_summary", _recursive(with_base(
    "SELECT (SELECT count(DISTINCT segment) FROM lab) AS total_segments, "
    "(SELECT max(n) FROM (SELECT count(*) AS n FROM lab GROUP BY segment)) AS largest_segment, "
    "round((SELECT avg(s) FROM s), 6) AS silhouette_score, round((SELECT sum(v) FROM (SELECT count(*) * "
    "(var_pop(x[1]) + var_pop(x[2]) + var_pop(x[3])) AS v FROM lab GROUP BY segment)), 6) AS wssse",
    *_DAY_LABELS, *_labelled_silhouette_ctes())))
def q_day_summary(spark, sf):
    return _round_cols(SG.day_summary(R(spark, sf)), ["silhouette_score", "wssse"])


_PROFILE_BODY, _PROFILE_CTES = _profile_sql()


@register("segment_profiles", _recursive(with_base(_PROFILE_BODY, *_DAY_LABELS, *_PROFILE_CTES)))
def q_segment_profiles(spark, sf):
    return SG.segment_profiles(R(spark, sf))


@register("segment_profile_rule", _profile_rule_sql())
def q_segment_profile_rule(spark, sf):
    return SG.segment_profile_rule(R(spark, sf))


# ------------------------------------------- facts that fits must satisfy, recomputed from their output

_HOSTS = "(SELECT count(DISTINCT host) FROM r)"


@register("host_pca_facts", with_base(
    f"SELECT {_HOSTS} AS n_hosts, CAST(0 AS BIGINT) AS off_centre, CAST(0 AS BIGINT) AS correlated, true AS ordered"))
def q_host_pca_facts(spark, sf):
    """Components have mean zero, are uncorrelated, and come by variance."""
    return FT.pca_facts(FT.host_pca(R(spark, sf)))


@register("host_segments_facts", with_base(
    f"SELECT {_HOSTS} AS n_points, CAST(0 AS BIGINT) AS not_nearest, true AS cost_agrees, CAST(4 AS BIGINT) AS n_segments"))
def q_host_segments_facts(spark, sf):
    """Every host is at its nearest centre, and the reported cost is that of the output."""
    feats = SG.host_ml_features(R(spark, sf))
    model = SG.train_kmeans(feats)
    return SG.fit_facts(model, model.transform(feats))


@register("day_segments_facts", with_base(
    "SELECT (SELECT count(DISTINCT day(time)) FROM r WHERE time IS NOT NULL) AS n_points, CAST(0 AS BIGINT) AS not_nearest, "
    "true AS cost_agrees, CAST(4 AS BIGINT) AS n_segments"))
def q_day_segments_facts(spark, sf):
    return SG.fit_facts(*SG.perform_day_clustering(R(spark, sf)))


@register("host_anomalies_facts", with_base(
    f"SELECT {_HOSTS} AS n_hosts, true AS share_kept, true AS separated, CAST(0 AS BIGINT) AS out_of_range"))
def q_host_anomalies_facts(spark, sf):
    """At most a tenth is flagged, above all others, and scores are in (0, 1)."""
    return AN.anomaly_facts(AN.host_anomalies(R(spark, sf)))


@register("model_comparison_sizes", with_base(
    f"SELECT unnest(['kmeans', 'bisecting_kmeans', 'gaussian_mixture']) AS model, {_HOSTS} AS n_hosts"))
def q_model_comparison_sizes(spark, sf):
    sizes = SG.model_comparison(R(spark, sf))
    return sizes.select("model", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda t, n: t + n).alias("n_hosts"))


@register("train_and_analyze", with_base(
    f"SELECT {_HOSTS} AS n_hosts, {_HOSTS} AS sized, CAST(4 AS BIGINT) AS n_centers, CAST(7 AS BIGINT) AS n_features, "
    "CAST(16 AS BIGINT) AS n_distances, CAST(0 AS BIGINT) AS asymmetric"))
def q_train_and_analyze(spark, sf):
    """M9: one fit and all its tables, as counts that must agree."""
    out = SG.train_and_analyze(R(spark, sf))
    sep = out["cluster_separation"]
    other = sep.select(F.col("segment_i").alias("j"), F.col("segment_j").alias("i"), F.col("distance").alias("d"))
    off = sep.join(other, (F.col("i") == F.col("segment_i")) & (F.col("j") == F.col("segment_j"))).where(
        (F.abs(F.col("d") - F.col("distance")) > 1e-9) | ((F.col("i") == F.col("j")) & (F.col("d") > 0)))

    def n(df):
        return df.agg(F.count("*")).scalar()

    return out["cluster_sizes"].agg(F.sum("size").alias("sized")).select(
        n(out["segments"]).alias("n_hosts"), "sized", n(out["centers"]).alias("n_centers"),
        n(out["feature_importance"]).alias("n_features"), n(sep).alias("n_distances"), n(off).alias("asymmetric"))


# ------------------------------------------- order as data


def _placed(df: DataFrame, *order) -> DataFrame:
    """A small ordered result with its order as a column."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)))


@register("status_freq_order", with_base(
    "SELECT status, count(*) AS count, CAST(row_number() OVER (ORDER BY status NULLS FIRST) AS INTEGER) AS position "
    "FROM r GROUP BY status"))
def q_status_freq_order(spark, sf):
    return _placed(DS.status_freq(R(spark, sf)), F.col("status").asc_nulls_first())


@register("status_freq_desc_order", with_base(
    "SELECT status, count(*) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, status NULLS FIRST) AS INTEGER) "
    "AS position FROM r GROUP BY status"))
def q_status_freq_desc_order(spark, sf):
    return _placed(DS.status_freq_desc(R(spark, sf)), F.col("count").desc(), F.col("status").asc_nulls_first())


@register("top5_host_weekday_order", with_base(
    "SELECT *, CAST(row_number() OVER (ORDER BY coalesce(wd, -1), host) AS INTEGER) AS position FROM (SELECT "
    f"{weekday_abbr_sql()} AS weekday, host, count(*) AS count, {weekday_index_sql()} AS wd FROM r "
    "WHERE host IN (SELECT host FROM t5) GROUP BY 1, 2, 4)", _TOP5).replace("SELECT *, CAST(row", "SELECT weekday, host, count, CAST(row"))
def q_top5_host_weekday_order(spark, sf):
    days = F.array(*[F.lit(x) for x in P.WEEKDAY_ABBR])
    return _placed(BD.top5_host_weekday(R(spark, sf)), F.coalesce(F.array_position(days, F.col("weekday")), F.lit(-1)), "host")


# ------------------------------------------- bounds with a zone

AWARE_START, AWARE_END = "2024-01-05T06:00:00+00:00", "2024-01-20T18:30:00+02:00"


@register("service_aware_window", with_base(
    "SELECT method, count(*) AS count FROM (SELECT method, TRY_CAST(substr(timestamp, 8, 4) AS INTEGER) AS y, "
    f"{time_sql('timestamp')} + CASE WHEN timestamp LIKE '%-0400' THEN INTERVAL '4 hours' ELSE INTERVAL '1 hour' END AS utc "
    "FROM filled) WHERE utc >= TIMESTAMP '2024-01-05 06:00:00' AND utc <= TIMESTAMP '2024-01-20 16:30:00' GROUP BY method"))
def q_service_aware_window(spark, sf):
    """A window given as instants, over lines of two zones."""
    return LogService(requests_table(lines(spark, sf), instant=True)).method_distribution(AWARE_START, AWARE_END)


# ---------------------------------------------------------------- service / page variants


_WINDOW = f"time >= TIMESTAMP '{SERVICE_START}' AND time <= TIMESTAMP '{SERVICE_END}'"
_WINDOW_M = f"{_WINDOW} AND method IN ({_in_list(SERVICE_METHODS)})"


def _svc(spark, sf) -> LogService:
    return LogService(R(spark, sf))


def _dash(spark, sf) -> Dashboard:
    return Dashboard(R(spark, sf), PAGE_START, PAGE_END, PAGE_STATUSES, PAGE_METHODS)


@register("status_distribution_filtered", with_base(
    f"SELECT {status_category_sql()} AS status_category, count(*) AS count FROM r WHERE {_WINDOW_M} GROUP BY 1"))
def q_status_distribution_filtered(spark, sf):
    return _svc(spark, sf).status_distribution(SERVICE_START, SERVICE_END, SERVICE_METHODS)


@register("host_frequency_window", _top_sql("host", 20, _WINDOW))
def q_host_frequency_window(spark, sf):
    return _svc(spark, sf).host_frequency(20, SERVICE_START, SERVICE_END)


@register("hourly_traffic_window", with_base(
    f"SELECT {hour_sql()} AS hour, count(*) AS count FROM r WHERE time IS NOT NULL AND {_WINDOW} GROUP BY 1"))
def q_hourly_traffic_window(spark, sf):
    return _svc(spark, sf).traffic_pattern("hourly", SERVICE_START, SERVICE_END)


@register("daily_traffic_window", with_base(
    f"SELECT {weekday_name_sql()} AS day, count(*) AS count FROM r WHERE time IS NOT NULL AND {_WINDOW} "
    "GROUP BY 1"))
def q_daily_traffic_window(spark, sf):
    return _svc(spark, sf).traffic_pattern("daily", SERVICE_START, SERVICE_END)


@register("page_status_distribution", with_base(
    f"SELECT {status_category_sql()} AS status_category, count(*) AS count FROM r WHERE {_PAGE_WHERE} GROUP BY 1"))
def q_page_status_distribution(spark, sf):
    return _dash(spark, sf).status_distribution()


@register("page_method_share", with_base(
    "SELECT method, count(*) AS count, round(CAST(count(*) AS DOUBLE) / "
    f"CAST((SELECT count(*) FROM r WHERE {_PAGE_WHERE}) AS DOUBLE) * 100, 2) AS percentage "
    f"FROM r WHERE {_PAGE_WHERE} GROUP BY method"))
def q_page_method_share(spark, sf):
    return _dash(spark, sf).method_distribution()


@register("page_weekday_traffic", with_base(
    f"SELECT {weekday_name_sql()} AS day, count(*) AS count, {weekday_index_sql()} AS sort_key FROM r "
    f"WHERE time IS NOT NULL AND {_PAGE_WHERE} GROUP BY 1, 3"))
def q_page_weekday_traffic(spark, sf):
    return _dash(spark, sf).daily_traffic()


# ---------------------------------------------------------------- group counts, raw views

def _group_count_sql(key: str, out: str) -> str:
    return with_base(f"SELECT count(*) AS {out} FROM (SELECT {key} FROM r GROUP BY {key})")


@register("status_distinct", _group_count_sql("status", "n_statuses"))
def q_status_distinct(spark, sf):
    """Number of status groups, NULL status counted as one."""
    return DS.group_count(R(spark, sf), "status", "n_statuses")


@register("content_size_distinct", _group_count_sql("content_size", "n_sizes"))
def q_content_size_distinct(spark, sf):
    return DS.group_count(R(spark, sf), "content_size", "n_sizes")


@register("method_distinct", _group_count_sql("method", "n_methods"))
def q_method_distinct(spark, sf):
    return DS.group_count(R(spark, sf), "method", "n_methods")


@register("host_day_pairs", with_base(f"SELECT host, {day_sql()} AS day FROM r"))
def q_host_day_pairs(spark, sf):
    return DY.host_day_pairs(R(spark, sf))


@register("lines_shape", with_base("SELECT count(*) AS n_rows, CAST(1 AS INTEGER) AS n_columns FROM lines"))
def q_lines_shape(spark, sf):
    return TB.table_shape(lines(spark, sf))


@register("preview_lines", with_base("SELECT value FROM lines ORDER BY value ASC NULLS FIRST LIMIT 10"))
def q_preview_lines(spark, sf):
    return TB.preview(lines(spark, sf), 10)


# ---------------------------------------------------------------- materialised and streamed tables

@register("materialized_requests", with_base(f"SELECT {R_COLS} FROM r"))
def q_materialized_requests(spark, sf):
    """Parse once, write parquet partitioned by date, read it back."""
    path = shared_path(spark, "requests")
    materialize_requests(R(spark, sf), path)
    return rows(read_requests(spark, path))


@register("stream_requests", with_base(f"SELECT {R_COLS} FROM r"))
def q_stream_requests(spark, sf):
    """The file-stream parse: text files in a folder -> micro-batches ->
    the date-partitioned table (run to completion with ``availableNow``)."""
    src, out, ckpt = (shared_path(spark, n) for n in ("stream-in", "stream-out", "stream-ckpt"))
    lines(spark, sf).write.mode("overwrite").text(src)
    q = append_parsed_logs(parsed_log_stream(spark, src), out, ckpt)
    q.awaitTermination()  # availableNow ends by itself, however long the input takes
    return rows(read_requests(spark, out))


def _day_separation_sql(k: int = 4) -> str:
    ctes = [_DAY_TABLE_CTE,
            f"lab AS (SELECT *, ntile({k}) OVER (ORDER BY total_reqs, day) - 1 AS segment FROM d)",
            "c AS (SELECT segment, avg(avg_reqs) AS a, avg(CAST(total_reqs AS DOUBLE)) AS t, "
            "avg(CAST(total_hosts AS DOUBLE)) AS h FROM lab GROUP BY segment)"]
    dist = "sqrt((x.a - y.a) * (x.a - y.a) + (x.t - y.t) * (x.t - y.t) + (x.h - y.h) * (x.h - y.h))"
    return with_base(f"SELECT CAST(x.segment AS INTEGER) AS segment_i, CAST(y.segment AS INTEGER) AS segment_j, "
                     f"round({dist}, 6) AS distance FROM c x, c y", *ctes)


@register("day_center_separation", _day_separation_sql())
def q_day_center_separation(spark, sf):
    return SG.day_center_separation(R(spark, sf))


def _day_importance_sql(k: int = 4) -> str:
    ctes = [_DAY_TABLE_CTE,
            f"lab AS (SELECT *, ntile({k}) OVER (ORDER BY total_reqs, day) - 1 AS segment FROM d)",
            "c AS (SELECT segment, avg(avg_reqs) AS a, avg(CAST(total_reqs AS DOUBLE)) AS t, "
            "avg(CAST(total_hosts AS DOUBLE)) AS h FROM lab GROUP BY segment)"]
    arms = " UNION ALL ".join(f"SELECT '{name}' AS feature, round(avg(abs({col})), 6) AS importance FROM c"
                              for name, col in [("avg_reqs", "a"), ("total_reqs", "t"), ("total_hosts", "h")])
    return with_base(arms, *ctes)


@register("day_feature_importance", _day_importance_sql())
def q_day_feature_importance(spark, sf):
    return SG.day_feature_importance(R(spark, sf))


def _day_silhouette_ctes(k: int = 4) -> list[str]:
    """CTEs ending in ``s(segment, s)``: each labelled day's silhouette."""
    sq = lambda c: f"(CAST(x.{c} AS DOUBLE) - CAST(y.{c} AS DOUBLE)) * (CAST(x.{c} AS DOUBLE) - CAST(y.{c} AS DOUBLE))"
    return [_DAY_TABLE_CTE,
            f"lab AS (SELECT *, ntile({k}) OVER (ORDER BY total_reqs, day) - 1 AS segment FROM d)",
            f"pd AS (SELECT x.day AS i, x.segment AS si, y.segment AS sj, "
            f"sqrt({sq('avg_reqs')} + {sq('total_reqs')} + {sq('total_hosts')}) AS dist "
            "FROM lab x JOIN lab y ON x.day <> y.day)",
            "per AS (SELECT i, si, sj, avg(dist) AS md FROM pd GROUP BY i, si, sj)",
            "ab AS (SELECT i, max(CASE WHEN sj = si THEN md END) AS a, min(CASE WHEN sj <> si THEN md END) AS b "
            "FROM per GROUP BY i)",
            "s AS (SELECT lab.segment, CASE WHEN ab.a IS NULL OR ab.b IS NULL THEN 0.0 "
            "WHEN greatest(ab.a, ab.b) > 0 THEN (ab.b - ab.a) / greatest(ab.a, ab.b) ELSE 0.0 END AS s "
            "FROM lab LEFT JOIN ab ON lab.day = ab.i)"]


def _day_silhouette_sql(k: int = 4) -> str:
    return with_base("SELECT CAST(segment AS INTEGER) AS segment, round(avg(s), 6) AS silhouette, "
                     "round((SELECT avg(s) FROM s), 6) AS overall_silhouette FROM s GROUP BY segment",
                     *_day_silhouette_ctes(k))


@register("day_label_silhouette", _day_silhouette_sql())
def q_day_label_silhouette(spark, sf):
    return SG.day_label_silhouette(R(spark, sf))


def _day_summary_sql(k: int = 4) -> str:
    sq = lambda c: f"(CAST(l.{c} AS DOUBLE) - m.{c}) * (CAST(l.{c} AS DOUBLE) - m.{c})"
    centres = ("m AS (SELECT segment, avg(CAST(avg_reqs AS DOUBLE)) AS avg_reqs, avg(CAST(total_reqs AS DOUBLE)) "
               "AS total_reqs, avg(CAST(total_hosts AS DOUBLE)) AS total_hosts FROM lab GROUP BY segment)")
    body = ("SELECT (SELECT count(DISTINCT segment) FROM lab) AS total_segments, "
            "(SELECT max(n) FROM (SELECT count(*) AS n FROM lab GROUP BY segment)) AS largest_segment, "
            "round((SELECT avg(s) FROM s), 6) AS silhouette_score, "
            f"round((SELECT sum({sq('avg_reqs')} + {sq('total_reqs')} + {sq('total_hosts')}) "
            "FROM lab l JOIN m ON l.segment = m.segment), 6) AS wssse")
    return with_base(body, *_day_silhouette_ctes(k), centres)


@register("day_label_summary", _day_summary_sql())
def q_day_label_summary(spark, sf):
    return SG.day_label_summary(R(spark, sf))


def _host_label_centers_sql() -> str:
    ready = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0::DOUBLE) AS {c}" for c in FT.FEATURES)
    zs = ", ".join(
        f"CASE WHEN stddev_samp({c}) OVER () = 0 THEN 0.0::DOUBLE ELSE ({c} - avg({c}) OVER ()) / "
        f"stddev_samp({c}) OVER () END AS {c}" for c in FT.FEATURES)
    label = ("CASE WHEN total_requests < 10 THEN 0 WHEN total_requests < 100 THEN 1 "
             "WHEN total_requests < 1000 THEN 2 ELSE 3 END")
    ctes = [_HOST_FEATURES_CTE,
            f"x AS (SELECT host, {ready}, {label} AS segment FROM (SELECT *, {_DERIVED} FROM hf))",
            f"z AS (SELECT segment, {zs} FROM x)"]
    cols = ", ".join(f"round(avg({c}), 6) AS {c}" for c in FT.FEATURES)
    return with_base(f"SELECT CAST(segment AS INTEGER) AS segment, {cols} FROM z GROUP BY segment", *ctes)


@register("host_label_centers", _host_label_centers_sql())
def q_host_label_centers(spark, sf):
    return SG.host_label_centers(R(spark, sf))


@register("materialized_parsed", with_base(
    f"SELECT host, timestamp, method, endpoint, protocol, status, content_size, {time_sql('timestamp')} AS time "
    "FROM parsed"))
def q_materialized_parsed(spark, sf):
    """A6, parsed form: parse once, write the parsed columns plus time by
    date, read them back."""
    path = shared_path(spark, "parsed")
    materialize_parsed(parsed(spark, sf), path)
    return read_requests(spark, path).select("host", "timestamp", "method", "endpoint", "protocol", "status",
                                             "content_size", "time")


def _host_forecast_sql(periods: int = 7, z: float = FC.Z80) -> str:
    ctes = [
        "h AS (SELECT host, CAST(time AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS y FROM r "
        "WHERE time IS NOT NULL GROUP BY 1, 2)",
        "span AS (SELECT host, min(ds) AS d0, max(ds) AS d1 FROM h GROUP BY host)",
        "hx AS (SELECT h.host, ds, y, CAST(ds - d0 AS DOUBLE) AS x FROM h JOIN span USING (host))",
        "fit AS (SELECT host, coalesce(regr_slope(y, x), 0) AS slope, coalesce(regr_intercept(y, x), avg(y)) AS icpt "
        "FROM hx GROUP BY host)",
        "res AS (SELECT hx.host, CAST(isodow(ds) - 1 AS INTEGER) AS wd, y - (icpt + slope * x) AS resid "
        "FROM hx JOIN fit USING (host))",
        "eff AS (SELECT host, wd, avg(resid) AS effect FROM res GROUP BY host, wd)",
        "sig AS (SELECT host, stddev_samp(resid - effect) AS sigma FROM res JOIN eff USING (host, wd) GROUP BY host)",
        f"fut AS (SELECT span.host, CAST(d1 + CAST(i AS INTEGER) AS DATE) AS ds, d0 FROM span, range(1, {periods + 1}) t(i))",
        "pr AS (SELECT f.host, f.ds, icpt + slope * CAST(f.ds - f.d0 AS DOUBLE) + coalesce(e.effect, 0.0::DOUBLE) "
        f"AS yhat, {z!r}::DOUBLE * coalesce(s.sigma, 0.0::DOUBLE) AS band FROM fut f JOIN fit USING (host) "
        "LEFT JOIN eff e ON f.host = e.host AND e.wd = CAST(isodow(f.ds) - 1 AS INTEGER) "
        "LEFT JOIN sig s ON f.host = s.host)",
    ]
    return with_base("SELECT host, ds, round(yhat, 6) AS yhat, round(yhat - band, 6) AS yhat_lower, "
                     "round(yhat + band, 6) AS yhat_upper FROM pr", *ctes)


@register("host_traffic_forecast", _host_forecast_sql())
def q_host_traffic_forecast(spark, sf):
    return FC.host_traffic_forecast(R(spark, sf))


# ---------------------------------------------------------------- forecast with changepoints and seasons

def _changepoint_sql(periods: int, keys: list[str], shape: CP.Shape = CP.Shape(), z: float = FC.Z80) -> str:
    """The same ridge regression: sums over pairs of basis columns, and an
    elimination that takes one pivot a step of a recursive query."""
    k = "".join(f"{c}, " for c in keys) or "one, "
    kinds, ridge, c = shape.columns(), shape.ridge(), shape.n_changes
    p = len(kinds)
    basis = ["CAST(1 AS DOUBLE)", "t", *[f"greatest(t - {s!r}::DOUBLE, 0)" for s in shape.change_at()]]
    for _, period, order in shape.seasons():
        for n in range(1, order + 1):
            angle = f"((day - {period!r}::DOUBLE * floor(day / {period!r}::DOUBLE)) / {period!r}::DOUBLE * {2 * n}::DOUBLE * pi())"
            basis += [f"CASE WHEN length >= {2 * period!r}::DOUBLE THEN {f}({angle}) ELSE 0 END" for f in ("cos", "sin")]
    x = "[" + ", ".join(basis) + "]"
    group = ", ".join(keys) or "one"

    def part(kind: str) -> str:
        at = [i + 1 for i, name in enumerate(kinds) if name == kind]
        return f"(list_inner_product(b.x[{at[0]}:{at[-1]}], f.coef[{at[0]}:{at[-1]}]) * scale)"

    source = ", ".join(keys) if keys else "1 AS one"
    ctes = [
        f"h AS (SELECT {source}, CAST(time AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS y FROM r WHERE time IS NOT NULL GROUP BY ALL)",
        f"sp AS (SELECT {k}max(ds) AS d1, min(ds) AS d0, CAST(max(ds) - min(ds) AS DOUBLE) AS length, "
        f"greatest(CAST(max(ds) - min(ds) AS DOUBLE), 1) AS span, max(abs(y)) AS scale, count(*) AS n FROM h GROUP BY {group})",
        f"dates AS (SELECT {k}ds, y FROM h UNION ALL SELECT {k}CAST(d1 + CAST(i AS INTEGER) AS DATE), NULL FROM sp, range(1, {periods + 1}) t(i))",
        f"pt AS (SELECT dates.*, d1, scale, span, length, n, CAST(ds - d0 AS DOUBLE) / span AS t, "
        f"CAST(ds - DATE '1970-01-01' AS DOUBLE) AS day FROM dates JOIN sp USING ({group}))",
        f"b AS (SELECT {k}ds, y, d1, scale, span, n, {x} AS x FROM pt)",
        f"aug AS (SELECT {k}list_append(x, y / scale) AS x FROM b WHERE y IS NOT NULL)",
        f"wt AS (SELECT {ridge!r} AS w)",
        f"cell AS (SELECT {k}i, j, sum(x[i] * x[j]) + CASE WHEN i = j THEN any_value(w[i]) ELSE 0 END AS v "
        f"FROM aug, wt, range(1, {p + 1}) a(i), range(1, {p + 2}) c(j) GROUP BY {k}i, j)",
        f"line AS (SELECT {k}i, list(v ORDER BY j) AS v FROM cell GROUP BY {k}i)",
        f"el AS (SELECT {k}0 AS step, list(v ORDER BY i) AS m FROM line GROUP BY {group} UNION ALL "
        f"SELECT {k}step + 1, list_transform(m, lambda l, i: CASE WHEN i = step + 1 "
        "THEN list_transform(l, lambda a: a / l[step + 1]) ELSE list_transform(list_zip(l, m[step + 1]), "
        f"lambda ab: ab[1] - l[step + 1] / m[step + 1][step + 1] * ab[2]) END) FROM el WHERE step < {p})",
        f"f AS (SELECT {k}list_transform(m, lambda l: l[{p + 1}]) AS coef FROM el WHERE step = {p})",
        f"er AS (SELECT {k}sqrt(sum(pow(b.y / scale - list_inner_product(b.x, f.coef), 2)) / greatest(any_value(n) - 1, 1)) AS sigma "
        f"FROM b JOIN f USING ({group}) WHERE y IS NOT NULL GROUP BY {group})",
        f"fc AS (SELECT {k}ds, y, {part('trend')} AS trend, {part('weekly')} AS weekly, "
        f"{z!r}::DOUBLE * scale * sqrt(sigma * sigma + {2 * c / shape.change_range / 3!r}::DOUBLE * pow(list_sum(list_transform("
        f"f.coef[3:{2 + c}], lambda v: abs(v))) / {c}, 2) * pow(greatest(CAST(ds - d1 AS DOUBLE), 0) / span, 3)) AS band "
        f"FROM b JOIN f USING ({group}) JOIN er USING ({group}))",
    ]
    out = "".join(f"{key}, " for key in keys)
    return with_base(f"SELECT {out}ds, y, round(trend + weekly, 6) AS yhat, round(trend, 6) AS trend, round(weekly, 6) AS weekly, "
                     "round(trend + weekly - band, 6) AS yhat_lower, round(trend + weekly + band, 6) AS yhat_upper FROM fc",
                     *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@register("traffic_changepoint_forecast", _changepoint_sql(30, []))
def q_traffic_changepoint_forecast(spark, sf):
    return CP.traffic_changepoint_forecast(R(spark, sf))


@register("host_changepoint_forecast", _changepoint_sql(7, ["host"]))
def q_host_changepoint_forecast(spark, sf):
    return CP.host_changepoint_forecast(R(spark, sf))


# ---------------------------------------------------------------- windows and distinct counts from hourly rollups

# ends inside an hour, so both cut hours come from the requests
ROLLUP_START, ROLLUP_END = "2024-01-05 06:10:30", "2024-01-20 18:29:59"
_CUT = f"time >= TIMESTAMP '{ROLLUP_START}' AND time <= TIMESTAMP '{ROLLUP_END}'"


def _rollups(spark, sf, *names: str) -> RU.Rollups:
    return RU.Rollups(spark, R(spark, sf), shared_path(spark, "rollups")).build(names)


@register("rollup_status_distribution", with_base(
    f"SELECT {status_category_sql()} AS status_category, count(*) AS count FROM r WHERE {_CUT} "
    f"AND method IN ({_in_list(SERVICE_METHODS)}) GROUP BY 1"))
def q_rollup_status_distribution(spark, sf):
    return _rollups(spark, sf, "classes").status_distribution(ROLLUP_START, ROLLUP_END, SERVICE_METHODS)


@register("rollup_method_distribution", with_base("SELECT method, count(*) AS count FROM r GROUP BY method"))
def q_rollup_method_distribution(spark, sf):
    """No bounds: all cells, that of the requests without time included."""
    return _rollups(spark, sf, "classes").method_distribution()


@register("rollup_top_endpoints", _top_sql("endpoint", 20, _CUT + f" AND method IN ({_in_list(SERVICE_METHODS)})"))
def q_rollup_top_endpoints(spark, sf):
    return _rollups(spark, sf, "endpoints").top_endpoints(20, ROLLUP_START, ROLLUP_END, SERVICE_METHODS)


@register("rollup_host_frequency", _top_sql("host", 20, _CUT))
def q_rollup_host_frequency(spark, sf):
    return _rollups(spark, sf, "hosts").host_frequency(20, ROLLUP_START, ROLLUP_END)


@register("rollup_size_stats", with_base(
    "SELECT round(avg(CAST(content_size AS DOUBLE) / 1024.0::DOUBLE), 6) AS mean_kb, median(content_size) / 1024.0::DOUBLE AS median_kb, "
    f"max(content_size) / 1024.0::DOUBLE AS max_kb, min(content_size) / 1024.0::DOUBLE AS min_kb FROM r WHERE {_CUT}"))
def q_rollup_size_stats(spark, sf):
    return _rollups(spark, sf, "sizes").content_size_distribution(ROLLUP_START, ROLLUP_END)[1]


@register("rollup_hourly_traffic", with_base(f"SELECT {hour_sql()} AS hour, count(*) AS count FROM r WHERE {_CUT} GROUP BY 1"))
def q_rollup_hourly_traffic(spark, sf):
    return _rollups(spark, sf, "classes").traffic_pattern("hourly", ROLLUP_START, ROLLUP_END)


@register("rollup_daily_traffic", with_base(
    f"SELECT {weekday_name_sql()} AS day, count(*) AS count FROM r WHERE time IS NOT NULL AND time >= TIMESTAMP '{ROLLUP_START}' GROUP BY 1"))
def q_rollup_daily_traffic(spark, sf):
    return _rollups(spark, sf, "classes").traffic_pattern("daily", ROLLUP_START)


@register("rollup_statistics", with_base(_STATS_BODY + f" WHERE {_CUT}"))
def q_rollup_statistics(spark, sf):
    return _rollups(spark, sf, "classes", "host_sets").statistics(ROLLUP_START, ROLLUP_END)


@register("rollup_unique_hosts", with_base("SELECT count(DISTINCT host) AS unique_hosts FROM r"))
def q_rollup_unique_hosts(spark, sf):
    return _rollups(spark, sf, "host_sets").unique_hosts()


@register("rollup_daily_unique_hosts", with_base(f"SELECT {day_sql()} AS day, count(DISTINCT host) AS total_hosts FROM r GROUP BY 1"))
def q_rollup_daily_unique_hosts(spark, sf):
    return _rollups(spark, sf, "host_sets").daily_unique_hosts()


@register("rollup_unique_hosts_4xx", _unique_sql("host", "unique_hosts", 400, 600))
def q_rollup_unique_hosts_4xx(spark, sf):
    return _rollups(spark, sf, "host_sets").unique_by_weekday_range("host_sets", 400, 600, "unique_hosts")


@register("rollup_unique_endpoints_2xx", _unique_sql("endpoint", "unique_endpoints", 200, 300, "method = 'GET'"))
def q_rollup_unique_endpoints_2xx(spark, sf):
    return _rollups(spark, sf, "endpoint_sets").unique_by_weekday_range("endpoint_sets", 200, 300, "unique_endpoints")


# ---------------------------------------------------------------- order as data at size (W1), results as records

@register("content_size_freq_order", with_base(
    "SELECT content_size, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, content_size) AS position FROM r GROUP BY content_size"))
def q_content_size_freq_order(spark, sf):
    """Sizes by frequency with their position: as many rows as there are sizes, so no unpartitioned window."""
    sizes = DS.content_size_freq(R(spark, sf))
    return RK.positions(sizes, F.col("count").desc(), "content_size")


@register("result_records", _top_sql("endpoint", 50))
def q_result_records(spark, sf):
    """A result written as JSON records and read back."""
    result, path = DS.top_endpoints(R(spark, sf), 50), shared_path(spark, "records")
    write_result(result, path, "json")
    return spark.read.schema(result.schema).json(path)


@register("incremental_requests", with_base(f"SELECT {R_COLS} FROM r"))
def q_incremental_requests(spark, sf):
    """A6 in two overlapping loads of log files: every line is there once."""
    logs, path = shared_path(spark, "log-files"), shared_path(spark, "loaded")
    lines(spark, sf).select("value").repartition(3).write.text(f"{logs}/a")
    ingest(spark, [f"{logs}/a/part-00000*", f"{logs}/a/part-00001*"], path)
    ingest(spark, [f"{logs}/a"], path)
    return rows(read_loaded(spark, path))
