"""Table-level views: shape, schema, ordered preview, filtered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_shape(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, n_columns)``; the count is a distributed aggregate."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"))


def schema_view(df: DataFrame) -> DataFrame:
    """The schema as rows ``(position, column, type)``, from metadata alone: no
    scan and no job over the table (A4). ``table_schema`` adds observed NULL counts."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def table_schema(df: DataFrame) -> DataFrame:
    """The schema as rows ``(position, column, type, null_count)``.

    The type comes from the schema; ``null_count`` is observed in one
    aggregate pass (declared nullability is left out: it depends on the
    source, e.g. parquet reads declare every column nullable).
    """
    fields = df.schema.fields
    counts = df.agg(*[F.count_if(F.col(f.name).isNull()).alias(f"n{i}") for i, f in enumerate(fields)])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                     F.lit(f.dataType.simpleString()).alias("type"),
                     F.col(f"n{i}").alias("null_count"))
            for i, f in enumerate(fields)]
    return counts.select(F.inline(F.array(*rows)))


def preview(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows in a deterministic order (TakeOrderedAndProject:
    each task keeps its own top ``n``, so only ``n`` x tasks rows move)."""
    keys = order_by or df.columns
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in keys]).limit(n)
