"""Building blocks of the DuckDB oracle SQL.

The oracle repeats, in plain SQL, the derivation of log lines from
``events``, the five-pattern parse and the wall-clock time conversion,
so each Spark plan can be checked against an independent engine.
"""

from __future__ import annotations

from logscope.functions import patterns as P


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def time_sql(t: str) -> str:
    months = " ".join(f"WHEN {_q(m)} THEN '{i:02d}'" for i, m in enumerate(P.MONTHS, start=1))
    text = (f"substr({t},8,4) || '-' || (CASE substr({t},4,3) {months} END) || '-' || substr({t},1,2)"
            f" || ' ' || substr({t},13,2) || ':' || substr({t},16,2) || ':' || substr({t},19,2)")
    return f"TRY_CAST({text} AS TIMESTAMP)"


def hour_sql(t: str = "time") -> str:
    return f"CAST(hour({t}) AS INTEGER)"


def day_sql(t: str = "time") -> str:
    return f"CAST(day({t}) AS INTEGER)"


def weekday_abbr_sql(t: str = "time") -> str:
    return f"strftime({t}, '%a')"


def weekday_name_sql(t: str = "time") -> str:
    return f"strftime({t}, '%A')"


def weekday_index_sql(t: str = "time") -> str:
    return f"CAST(isodow({t}) - 1 AS INTEGER)"


def hour_range_sql(h: str) -> str:
    arms = " ".join(f"WHEN {h} >= {lo} AND {h} <= {hi} THEN {_q(lab)}" for lab, lo, hi in P.HOUR_RANGES)
    return f"(CASE {arms} END)"


def status_category_sql(s: str = "status") -> str:
    arms = " ".join(f"WHEN {s} >= {lo} AND {s} < {hi} THEN {_q(lab)}" for lab, lo, hi in P.STATUS_CATEGORIES)
    return f"(CASE {arms} ELSE {_q(P.STATUS_OTHER)} END)"


def status_code_sql(s: str = "status") -> str:
    arms = " ".join(f"WHEN {s} >= {lo} AND {s} < {hi} THEN {_q(lab)}" for lab, lo, hi in P.STATUS_CODES)
    return f"(CASE {arms} ELSE {_q(P.STATUS_OTHER)} END)"


def invalid_method_sql(m: str = "method") -> str:
    return f"({m} = '' OR regexp_matches({m}, {_q(P.INVALID_METHOD_PATTERN)}))"


def invalid_protocol_sql(p: str = "protocol") -> str:
    return f"({p} = '' OR regexp_matches({p}, {_q(P.INVALID_PROTOCOL_PATTERN)}))"


LINES_SQL = """lines AS (SELECT event_id, CASE WHEN event_id % 211 = 1 THEN '' ELSE concat(
  CASE WHEN event_id % 50 = 0 THEN 'localhost'
       WHEN event_id % 7 = 0 THEN concat('163.206.', user_id % 256, '.4')
       ELSE concat('h', user_id, '.example.com') END,
  ' - - [', CASE event_id % 211 WHEN 2 THEN 'bad' WHEN 3 THEN concat(strftime(ts, '%d/%b/%Y:'), '24:00:06 -0400')
    WHEN 4 THEN concat(strftime(ts, '%d/%b/%Y:%H:%M:%S'), ' +0100')
    WHEN 8 THEN concat(strftime(ts, '%d/%b/%Y:%H:%M:%S'), ' -0100')
    ELSE concat(strftime(ts, '%d/%b/%Y:%H:%M:%S'), ' -0400') END, '] "',
  CASE WHEN event_id % 211 = 5 THEN 'GET /x y z HTTP/1.0' WHEN event_id % 97 = 0 THEN '' ELSE concat(
    CASE event_type WHEN 'signup' THEN 'HEAD' WHEN 'purchase' THEN 'POST' ELSE 'GET' END,
    ' /', event_type, '/', event_id % 40, '.html',
    CASE WHEN event_id % 11 = 0 THEN '' ELSE ' HTTP/1.0' END) END,
  '" ',
  CASE WHEN event_id % 211 = 0 THEN '-'
       WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN '404' WHEN 1 THEN '403' WHEN 2 THEN '500' ELSE '501' END
       WHEN event_type = 'click' AND event_id % 3 = 0 THEN '304'
       WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN '302'
       ELSE '200' END,
  ' ', CASE WHEN event_id % 211 = 6 THEN '99999999999' WHEN event_id % 13 = 0 THEN '-'
       ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) END,
  CASE WHEN event_id % 211 = 7 THEN ' ' ELSE '' END) END AS value
FROM events)"""

PARSED_SQL = f"""parsed AS (SELECT
  regexp_extract(value, {_q(P.HOST_PATTERN)}, 1) AS host,
  regexp_extract(value, {_q(P.TIMESTAMP_PATTERN)}, 1) AS timestamp,
  regexp_extract(value, {_q(P.REQUEST_PATTERN)}, 1) AS method,
  regexp_extract(value, {_q(P.REQUEST_PATTERN)}, 2) AS endpoint,
  regexp_extract(value, {_q(P.REQUEST_PATTERN)}, 3) AS protocol,
  TRY_CAST(regexp_extract(value, {_q(P.STATUS_PATTERN)}, 1) AS INTEGER) AS status,
  TRY_CAST(regexp_extract(value, {_q(P.CONTENT_SIZE_PATTERN)}, 1) AS INTEGER) AS content_size
FROM lines)"""

FILLED_SQL = """filled AS (SELECT host, timestamp, method, endpoint, protocol, status,
  coalesce(content_size, 0) AS content_size FROM parsed)"""

R_SQL = f"""r AS (SELECT host, method, endpoint, protocol, status, content_size,
  {time_sql('timestamp')} AS time FROM filled)"""

BASE_SQL = "WITH " + ",\n".join([LINES_SQL, PARSED_SQL, FILLED_SQL, R_SQL])


def with_base(body: str, *extra_ctes: str) -> str:
    """Prefix the shared CTEs (lines, parsed, filled, r) to a query body."""
    ctes = "".join(",\n" + c for c in extra_ctes)
    return f"{BASE_SQL}{ctes}\n{body}"


def sql_str(s: str) -> str:
    return _q(s)
