"""Native column expressions that parse Common Log Format text.

All of these stay inside Catalyst (no Python UDF), so the parse runs in
whole-stage codegen and unused fields are pruned away by the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logscope.functions import patterns as P


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def host(value: str | Column = "value") -> Column:
    """Remote host; ``''`` when the line does not match (never NULL)."""
    return F.regexp_extract(_c(value), P.HOST_PATTERN, 1)


def timestamp_text(value: str | Column = "value") -> Column:
    """Bracketed time text ``dd/Mon/yyyy:HH:mm:ss -zzzz``; ``''`` if absent."""
    return F.regexp_extract(_c(value), P.TIMESTAMP_PATTERN, 1)


def method(value: str | Column = "value") -> Column:
    return F.regexp_extract(_c(value), P.REQUEST_PATTERN, 1)


def endpoint(value: str | Column = "value") -> Column:
    return F.regexp_extract(_c(value), P.REQUEST_PATTERN, 2)


def protocol(value: str | Column = "value") -> Column:
    return F.regexp_extract(_c(value), P.REQUEST_PATTERN, 3)


def status(value: str | Column = "value") -> Column:
    """First blank-delimited 3-digit token as int; NULL when absent.

    ``try_cast`` keeps the NULL-on-bad-input behaviour under ANSI mode.
    """
    return F.regexp_extract(_c(value), P.STATUS_PATTERN, 1).try_cast("int")


def content_size(value: str | Column = "value") -> Column:
    """Trailing digits as int; NULL for ``-``, a trailing blank or overflow."""
    return F.regexp_extract(_c(value), P.CONTENT_SIZE_PATTERN, 1).try_cast("int")


# Reorders the matched CLF time text into ISO order with the month name
# still in place: dd/Mon/yyyy:HH:mm:ss -zzzz -> yyyy-Mon-dd HH:mm:ss.
_ISO_ORDER = r"^(\d{2})/(\w{3})/(\d{4}):(\d{2}):(\d{2}):(\d{2}).*$"


def clf_time(ts_text: str | Column = "timestamp") -> Column:
    """Wall-clock ``timestamp_ntz`` from CLF time text; the offset is ignored.

    One ``regexp_replace`` puts the fields in ISO order, a chain of literal
    ``replace`` calls turns the (case-sensitive) month name into its number,
    and ``try_cast`` gives NULL for an unknown month, an impossible date,
    hour 24 or ``''`` instead of failing the job. Every step reads its input
    once, so a filter on ``time`` that Catalyst pushes down through the
    parse evaluates the timestamp pattern once, not once per field.
    """
    text = F.regexp_replace(_c(ts_text), _ISO_ORDER, "$3-$2-$1 $4:$5:$6")
    for i, m in enumerate(P.MONTHS, start=1):
        text = F.replace(text, F.lit(m), F.lit(f"{i:02d}"))
    return text.try_cast("timestamp_ntz")


def clf_instant_epoch(ts_text: str | Column = "timestamp") -> Column:
    """Seconds since the epoch of the zone-aware instant (offset applied)."""
    inst = F.try_to_timestamp(_c(ts_text), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return F.unix_timestamp(inst)


def clf_time_text(ts: str | Column = "ts") -> Column:
    """Format a wall-clock ``timestamp_ntz`` as ``dd/Mon/yyyy:HH:mm:ss``.

    Built from the field functions, which read ``timestamp_ntz`` without
    any zone; ``date_format`` would pass through the session zone and move
    a daylight-saving gap time (02:30 on a spring-forward day) by an hour.
    """
    t = _c(ts)
    months = F.array(*[F.lit(m) for m in P.MONTHS])

    def two(x):
        return F.lpad(x.cast("string"), 2, "0")
    return F.concat(two(F.dayofmonth(t)), F.lit("/"), F.element_at(months, F.month(t)), F.lit("/"),
                    F.lpad(F.year(t).cast("string"), 4, "0"), F.lit(":"), two(F.hour(t)), F.lit(":"),
                    two(F.minute(t)), F.lit(":"), two(F.second(t)))
