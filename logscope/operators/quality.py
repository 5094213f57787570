"""Data-quality profile of raw lines and parsed tables.

Every check is one aggregate pass; several counts are fused into a single
``agg`` so a profile costs one scan instead of one job per number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.functions.numeric import round_to
from logscope.functions import patterns as P
from logscope.functions import status as S


def null_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.agg(F.count_if(F.col(value).isNull()).alias("null_lines"))


def bad_rows(parsed: DataFrame) -> DataFrame:
    """Rows with a NULL in any column (before the size fill)."""
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in parsed.columns])
    return parsed.agg(F.count_if(any_null).alias("bad_rows"))


def null_counts(df: DataFrame) -> DataFrame:
    """NULL count per column, one pass."""
    return df.agg(*[F.sum(F.col(c).isNull().cast("int")).cast("bigint").alias(c) for c in df.columns])


def unmatched_lines(lines: DataFrame, pattern: str, name: str, value: str = "value") -> DataFrame:
    return lines.agg(F.count_if(~F.col(value).rlike(pattern)).alias(name))


def null_status_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    return unmatched_lines(lines, P.STATUS_PATTERN, "null_status_lines", value)


def null_size_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    return unmatched_lines(lines, P.SIZE_LINE_PATTERN, "null_size_lines", value)


def null_size_samples(lines: DataFrame, n: int = 10, value: str = "value") -> DataFrame:
    """``n`` example lines without a size, smallest first (a sample report)."""
    return lines.filter(~F.col(value).rlike(P.SIZE_LINE_PATTERN)).orderBy(value).limit(n)


def distinct_per_column(df: DataFrame) -> DataFrame:
    """Distinct values per column, NULL counted as one value."""
    return df.agg(*[(F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).cast("bigint").alias(c)
                    for c in df.columns])


def frequency(df: DataFrame, key: str) -> DataFrame:
    """``groupBy(key).count()``: partial aggregation before the shuffle, so a
    hot key costs one row per map task, not one row per request (C7)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def invalid_share(parsed: DataFrame) -> DataFrame:
    """Invalid method/protocol counts and their share of all rows."""
    return parsed.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(S.invalid_method("method")).alias("invalid_method_count"),
        F.count_if(S.invalid_protocol("protocol")).alias("invalid_protocol_count"),
    ).select(
        "total_count", "invalid_method_count", "invalid_protocol_count",
        (F.try_divide(F.col("invalid_method_count").cast("double"), F.col("total_count").cast("double")) * 100)
        .alias("method_influence_pct"),
        (F.try_divide(F.col("invalid_protocol_count").cast("double"), F.col("total_count").cast("double")) * 100)
        .alias("protocol_influence_pct"),
    )


def invalid_by_timestamp(parsed: DataFrame) -> DataFrame:
    """Invalid-method count and total per timestamp text."""
    return parsed.groupBy("timestamp").agg(
        F.count_if(S.invalid_method("method")).alias("invalid_method_count"),
        F.count(F.lit(1)).alias("total_count"))


def describe_long(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """``describe`` as typed long form: summary x column, one pass."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).cast("double").alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__stddev"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    wide = df.agg(*aggs)
    stats = ["count", "mean", "stddev", "min", "max"]
    structs = [F.struct(F.lit(s).alias("summary"),
                        *[round_to(F.col(f"{c}__{s}"), digits).alias(c) for c in cols])
               for s in stats]
    return wide.select(F.inline(F.array(*structs)))


def invalid_describe(parsed: DataFrame) -> DataFrame:
    return describe_long(parsed.filter(S.invalid_method("method")), ["status", "content_size"])


def valid_split(parsed: DataFrame, invalid, valid_label: str, invalid_label: str) -> DataFrame:
    """Valid vs invalid split with share of all rows, one pass."""
    wide = parsed.agg(F.count(F.lit(1)).alias("total"), F.count_if(invalid).alias("bad"))
    structs = F.array(
        F.struct(F.lit(valid_label).alias("label"), (F.col("total") - F.col("bad")).alias("count")),
        F.struct(F.lit(invalid_label).alias("label"), F.col("bad").alias("count")))
    return wide.select(F.inline(structs), "total").select(
        "label", "count",
        (F.try_divide(F.col("count").cast("double"), F.col("total").cast("double")) * 100).alias("share_pct"))


def valid_split_method(parsed: DataFrame) -> DataFrame:
    return valid_split(parsed, S.invalid_method("method"), "Valid Methods", "Invalid Methods")


def valid_split_protocol(parsed: DataFrame) -> DataFrame:
    return valid_split(parsed, S.invalid_protocol("protocol"), "Valid Protocol", "Invalid Protocol")
