"""Calendar helpers on wall-clock ``timestamp_ntz`` columns.

Weekday names come from ``weekday()`` (0 = Monday) and a fixed label
array, so they never depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logscope.functions import patterns as P


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def weekday_index(time: str | Column = "time") -> Column:
    """0 = Monday ... 6 = Sunday; NULL for NULL time."""
    return F.weekday(_c(time))


def weekday_abbr(time: str | Column = "time") -> Column:
    labels = F.array(*[F.lit(x) for x in P.WEEKDAY_ABBR])
    return F.when(_c(time).isNotNull(), F.get(labels, F.weekday(_c(time))))


def weekday_name(time: str | Column = "time") -> Column:
    labels = F.array(*[F.lit(x) for x in P.WEEKDAY_NAMES])
    return F.when(_c(time).isNotNull(), F.get(labels, F.weekday(_c(time))))


def _hour_labels() -> list[str]:
    """Label of each hour 1..24, generated from the fixed ranges."""
    out = []
    for h in range(1, 25):
        out.append(next(lab for lab, lo, hi in P.HOUR_RANGES if lo <= h <= hi))
    return out


def hour_range(hour: str | Column = "hour") -> Column:
    """Three-hour bucket label; NULL for hour 0 (and NULL hours).

    One array lookup (``get`` is 0-based and NULL out of bounds), so the
    hour expression is referenced once however it was derived.
    """
    labels = F.array(*[F.lit(x) for x in _hour_labels()])
    return F.get(labels, _c(hour) - 1)


def hour_range_index(hour: str | Column = "hour") -> Column:
    h = _c(hour)
    expr = None
    for i, (_, lo, hi) in enumerate(P.HOUR_RANGES):
        cond = (h >= lo) & (h <= hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr
