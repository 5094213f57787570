"""Response-size statistics and histograms.

One pass over the requests counts each distinct size (partial counts per
task); the counted values are checkpointed, and everything else reads them.
The histogram follows numpy's equal-width rules exactly (edges from
``linspace``, last bin closed, constant input widened by 0.5 each side,
empty input on [0, 1]).

The median is exact and bounded: counts per 2**16-wide bucket, a running
total over those (few) buckets to find the ones holding the middle ranks,
then the values inside those buckets only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscope.functions.numeric import round_to
from logscope.operators.quality import describe_long
from logscope.operators.ranks import value_at_rank
from logscope.session import checkpointed

KB = 1024.0
MB = 1024.0 * 1024.0


def content_size_summary(df: DataFrame, col: str = "content_size", digits: int = 6) -> DataFrame:
    """min, max, mean, sample stddev and count in one pass."""
    c = F.col(col)
    return df.agg(F.min(c).alias("min_content_size"), F.max(c).alias("max_content_size"),
                  round_to(F.avg(c), digits).alias("mean_content_size"),
                  round_to(F.stddev_samp(c), digits).alias("std_content_size"),
                  F.count(c).alias("count_content_size"))


def content_size_describe(df: DataFrame, col: str = "content_size") -> DataFrame:
    """``describe`` in typed long form."""
    return describe_long(df, [col])


def _middle_ranks(n: Column):
    return F.floor((n + 1) / 2), F.floor(n / 2) + 1


def size_counts(df: DataFrame, col: str = "content_size") -> DataFrame:
    """(v, n): how often each value stands in ``col``, checkpointed. The only
    pass over the requests: range, histogram, mean and median follow from it."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return checkpointed(counts)


def median_of(counts: DataFrame, shift: int = 16) -> DataFrame:
    """Exact median of counted values as a one-row DataFrame ``median``:
    average of the two middle values for an even count (like pandas and
    ``quantile_cont``); NULL for no rows.

    For at most 32 bits the bucket table has at most 2**(32 - shift) rows and
    a bucket at most 2**shift values. Wider integers and doubles are found by narrowing
    ranges (``ranks``), which is as bounded but runs when the plan is built.
    """
    kind = dict(counts.dtypes)["v"]
    if kind in ("bigint", "float", "double"):
        n = counts.agg(F.sum("n")).first()[0] or 0
        mid = [value_at_rank(counts, r, "v", "n") for r in ((n - 1) // 2, n // 2)] if n else [None, None]
        value = None if mid[0] is None else (float(mid[0]) + float(mid[1])) / 2
        return counts.sparkSession.range(1).select(F.lit(value).cast("double").alias("median"))
    if kind not in ("int", "smallint", "tinyint"):
        raise TypeError(f"the median needs a number column, got {kind}")
    vals = counts.select(F.col("v").cast("bigint").alias("v"), "n")
    bucket = F.shiftright("v", shift)
    buckets = vals.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n_b"))
    # running totals over the bucket table (<= 2**(bits - shift) rows)
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = buckets.select("b", "n_b", F.sum("n_b").over(w).alias("upto"))
    total = F.sum("n_b").over(Window.partitionBy())
    cum = cum.withColumn("total", total)
    k_lo, k_hi = _middle_ranks(F.col("total"))
    targets = cum.where(((F.col("upto") - F.col("n_b") < k_lo) & (F.col("upto") >= k_lo))
                        | ((F.col("upto") - F.col("n_b") < k_hi) & (F.col("upto") >= k_hi)))
    targets = targets.select("b", (F.col("upto") - F.col("n_b")).alias("before"), "total")
    # values inside the (at most two) target buckets only
    inside = vals.withColumn("b", bucket).join(F.broadcast(targets.select("b")), "b", "left_semi")
    wv = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (inside.select("b", "v", F.col("n").alias("n_v"), F.sum("n").over(wv).alias("upto_v"))
              .join(F.broadcast(targets), "b"))
    ranked = ranked.select("v", (F.col("before") + F.col("upto_v") - F.col("n_v")).alias("r0"),
                           (F.col("before") + F.col("upto_v")).alias("r1"), "total")
    k_lo, k_hi = _middle_ranks(F.col("total"))
    picked = ranked.agg(
        F.max(F.when((F.col("r0") < k_lo) & (F.col("r1") >= k_lo), F.col("v"))).alias("lo"),
        F.max(F.when((F.col("r0") < k_hi) & (F.col("r1") >= k_hi), F.col("v"))).alias("hi"))
    return picked.select(((F.col("lo").cast("double") + F.col("hi").cast("double")) / 2).alias("median"))


def exact_median(df: DataFrame, col: str) -> DataFrame:
    """Exact median of an integer column as a one-row DataFrame ``median``."""
    return median_of(size_counts(df, col))


def stats_of(counts: DataFrame, digits: int = 6) -> DataFrame:
    """``size_stats_kb`` from counted sizes."""
    kb = F.col("v").cast("double") / KB
    mean = F.try_divide(F.sum(kb * F.col("n")), F.sum("n").cast("double"))
    base = counts.agg(round_to(mean, digits).alias("mean_kb"), F.max(kb).alias("max_kb"), F.min(kb).alias("min_kb"))
    med = median_of(counts).select((F.col("median") / KB).alias("median_kb"))
    return base.select("mean_kb", med.select("median_kb").scalar().alias("median_kb"), "max_kb", "min_kb")


def size_stats_kb(df: DataFrame, col: str = "content_size", digits: int = 6) -> DataFrame:
    """mean, exact median, max and min of the size in KB (E18 statistics)."""
    return stats_of(size_counts(df, col), digits)


def _edge(i: Column, first: Column, last: Column, bins: int) -> Column:
    step = (last - first) / F.lit(float(bins))
    return F.when(i == bins, last).otherwise(i.cast("double") * step + first)


def _numpy_bins(xs: DataFrame, first: Column, last: Column, bins: int) -> DataFrame:
    """Bin index of column ``x`` exactly as numpy computes it: a scaled
    estimate, then one correction step against each neighbouring edge.
    Each step is its own projection so no expression is nested in itself."""
    f = ((F.col("x") - first) / (last - first)) * F.lit(float(bins))
    step0 = xs.select("x", "n", F.floor(f).alias("i"))
    step0 = step0.select("x", "n", F.when(F.col("i") == bins, F.lit(bins - 1)).otherwise(F.col("i")).alias("i"))
    step1 = step0.select("x", "n", F.when(F.col("x") < _edge(F.col("i"), first, last, bins), F.col("i") - 1)
                         .otherwise(F.col("i")).alias("i"))
    up = (F.col("x") >= _edge(F.col("i") + 1, first, last, bins)) & (F.col("i") != bins - 1)
    return step1.select(F.when(up, F.col("i") + 1).otherwise(F.col("i")).alias("bin"), "n")


def numpy_range(counts: DataFrame, x: Column) -> tuple[float, float]:
    """numpy's histogram range: (min, max), widened by 0.5 each side when
    constant, (0, 1) when empty. One one-row aggregate over the counted
    values, so the binning below sees plain literals."""
    row = counts.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).first()
    if not row["n"]:
        return 0.0, 1.0
    lo, hi = float(row["lo"]), float(row["hi"])
    return (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)


def histogram_of(counts: DataFrame, bins: int = 50, scale: float = KB) -> DataFrame:
    """``size_histogram`` from counted sizes."""
    x = F.col("v").cast("double") / F.lit(scale)
    lo, hi = numpy_range(counts, x)
    first, last = F.lit(lo), F.lit(hi)
    binned = _numpy_bins(counts.select(x.alias("x"), "n"), first, last, bins).groupBy("bin").agg(F.sum("n").alias("count"))
    # every bin, empty ones included: union a zero row per bin and re-sum
    zeros = counts.sparkSession.range(bins).select(F.col("id").alias("bin"), F.lit(0).cast("bigint").alias("count"))
    hist = binned.unionByName(zeros).groupBy("bin").agg(F.sum("count").cast("bigint").alias("count"))
    return hist.select("bin", _edge(F.col("bin"), first, last, bins).alias("bin_start"),
                       _edge(F.col("bin") + 1, first, last, bins).alias("bin_end"), "count").orderBy("bin")


def size_histogram(df: DataFrame, bins: int = 50, col: str = "content_size", scale: float = KB) -> DataFrame:
    """Equal-width histogram of ``col / scale`` with numpy's edge rules.

    Rows ``(bin, bin_start, bin_end, count)`` for every bin, empty bins 0,
    from one pass over the requests (``size_counts``)."""
    return histogram_of(size_counts(df, col), bins, scale)


# The 1-2-5 ladder of "nice" bin widths.
NICE_STEPS = (1.0, 2.0, 5.0)


def _nice_width(raw: float) -> float:
    """The smallest 1/2/5 x 10^k not below ``raw`` (a constant input has the
    least width that a size in MB can show)."""
    if raw <= 0:
        return 1e-6
    k = math.floor(math.log10(raw))
    return min(w for e in (k - 1, k, k + 1) for m in NICE_STEPS if (w := float(f"{m:g}e{e}")) >= raw)


def nice_histogram_of(counts: DataFrame, max_bins: int = 50, scale: float = KB) -> DataFrame:
    """``size_histogram_nice`` from counted sizes."""
    x = F.col("v").cast("double") / F.lit(scale)
    row = counts.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if row["lo"] is None:
        return counts.sparkSession.createDataFrame([], "bin bigint, bin_start double, bin_end double, count bigint")
    width = _nice_width((row["hi"] - row["lo"]) / float(max_bins))
    w, base = F.lit(width), F.lit(math.floor(row["lo"] / width))
    binned = counts.groupBy((F.floor(x / w) - base).alias("bin")).agg(F.sum("n").alias("count"))
    return binned.select("bin", ((F.col("bin") + base).cast("double") * w).alias("bin_start"),
                         ((F.col("bin") + base + 1).cast("double") * w).alias("bin_end"),
                         "count").orderBy("bin")


def size_histogram_nice(df: DataFrame, max_bins: int = 50, col: str = "content_size",
                        scale: float = KB) -> DataFrame:
    """Display histogram (E19): bin width = the smallest 1/2/5 x 10^k not
    below ``range / max_bins``, for any range; bins aligned to multiples of
    the width. Only non-empty bins are returned."""
    return nice_histogram_of(size_counts(df, col), max_bins, scale)
