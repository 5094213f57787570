"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(col: Column, digits: int) -> Column:
    """Round a double to ``digits`` places as ``round(x * 10^d) / 10^d``.

    Scaling first rounds the binary value (19.825 is 19.8249999...), the
    same rule ANSI engines such as DuckDB apply, so results compare
    exactly; ``F.round(x, d)`` would round the shortest decimal text.
    """
    scale = float(10 ** digits)
    return F.round(col * F.lit(scale)) / F.lit(scale)
