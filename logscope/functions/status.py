"""Status-class expressions (half-open ranges; NULL status falls to Other)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logscope.functions import patterns as P


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def in_range(lo: int, hi: int, status: str | Column = "status") -> Column:
    s = _c(status)
    return (s >= lo) & (s < hi)


def _chain(classes, status) -> Column:
    s = _c(status)
    expr = None
    for label, lo, hi in classes:
        cond = (s >= lo) & (s < hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(P.STATUS_OTHER))


def status_category(status: str | Column = "status") -> Column:
    """Five-way class used by the service and page-1 charts."""
    return _chain(P.STATUS_CATEGORIES, status)


def status_code_class(status: str | Column = "status") -> Column:
    """Page-2 class: 2xx, 3xx, 4xx, else Other (5xx is Other there)."""
    return _chain(P.STATUS_CODES, status)


def invalid_method(method: str | Column = "method") -> Column:
    m = _c(method)
    return (m == "") | m.rlike(P.INVALID_METHOD_PATTERN)


def invalid_protocol(protocol: str | Column = "protocol") -> Column:
    p = _c(protocol)
    return (p == "") | p.rlike(P.INVALID_PROTOCOL_PATTERN)
