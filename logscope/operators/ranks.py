"""Exact order statistics and positions in bounded memory.

A pass counts values in at most ``BUCKETS`` equal ranges and goes on inside the
one that holds the rank, until that range is a single value. Only the bucket
counts reach the driver, so no task and no driver step grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscope.session import checkpointed

BUCKETS = 4096


def value_at_rank(values: DataFrame, rank: int, col: str = "v", weight: str | None = None):
    """The value at a 0-based ``rank`` among the non-null ``col``, each counted
    ``weight`` times (a column; default once). ``None`` beyond the last."""
    w = F.col(weight) if weight else F.lit(1)
    kind = dict(values.dtypes)[col]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    x = F.col(col).cast("decimal(20,0)" if whole else "double")
    rows = values.where(F.col(col).isNotNull()).select(x.alias("x"), w.cast("bigint").alias("w"))
    lo, hi, n = rows.agg(F.min("x"), F.max("x"), F.sum("w")).first()
    if n is None or not 0 <= rank < n:
        return None
    while lo < hi:
        a, b = F.lit(lo), F.lit(hi)
        if whole:  # 4096 ranges of whole numbers
            bucket = F.floor((F.col("x") - a) * BUCKETS / (b - a + 1)).cast("int")
        else:
            bucket = F.least(F.floor((F.col("x") - a) / (b - a) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        inside = rows.where((F.col("x") >= a) & (F.col("x") <= b))
        counts = inside.groupBy(bucket.alias("b")).agg(F.sum("w").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        for r in sorted(counts.collect(), key=lambda r: r["lo"]):  # at most BUCKETS rows
            if rank < r["w"]:
                lo, hi = r["lo"], r["hi"]
                break
            rank -= r["w"]
    return int(lo) if whole else float(lo)


def linear_quantile(values: DataFrame, q: float, col: str) -> float | None:
    """The q-quantile with linear interpolation between the two ranks around
    ``(n - 1) * q``; ``None`` for no rows."""
    n = values.where(F.col(col).isNotNull()).count()
    if not n:
        return None
    at = (n - 1) * q
    low = int(at)
    a = value_at_rank(values, low, col)
    b = value_at_rank(values, min(low + 1, n - 1), col) if at > low else a
    return a + (b - a) * (at - low)


def positions(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """``df`` with each row's place (from 1) in an order: range sort, checkpoint, and
    the counts of the sorted partitions before a row's own added to its place in it. The
    only thing that one task sees whole is one count per partition."""
    at = checkpointed(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = at.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_start") + F.col("_at") + 1).alias(name))
