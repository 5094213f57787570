"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.session import shared_path, ship_package

#: Java pattern of what separates words: space and the controls 9-13.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read
    back: lineage is cut and a lost executor rereads files, not the input."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys with at least this part of all rows are joined by broadcast.
HEAVY = 4096


def spread_join(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row per ``key`` and in ``n``
    how many of the ``total`` rows have it. Keys with at least 1/``HEAVY`` of the rows, of
    which there are at most ``HEAVY``, join by broadcast, so that their rows stay spread
    over tasks; the others by shuffle. ``n`` is not returned."""
    heavy = F.broadcast(facts.where(F.col(n) * HEAVY >= total).drop(n))
    light = facts.where(F.col(n) * HEAVY < total).drop(n)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def words(text):
    """Words of a text column, in order (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def slices(texts, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some ``limit`` characters together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def python_workers(spark: SparkSession) -> None:
    """Before a Python step: workers get this package. No session setting changes:
    Spark ends an Arrow batch at 64 MB, however many rows it holds."""
    ship_package(spark)
