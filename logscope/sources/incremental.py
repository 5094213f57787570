"""Incremental materialisation (A6): load what is new, rewrite only its dates.

A table made by ``ingest`` keeps beside its date partitions a manifest of the log files
that it holds, by path, size and time of change. A load lists the files (names only,
no content), drops those in the manifest, parses the rest and writes the dates
that they touch: the rows of these dates from other files together with the new ones,
by dynamic partition overwrite. Every row names its file, so loading a
file again, after a failure or because it changed, replaces its rows instead of
adding them twice. Other dates keep their files. The manifest is written last: a load
that died before is simply done again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.operators.parse import requests_table
from logscope.session import checkpointed, shared_path

MANIFEST = "_manifest"
FILE = "path string, modificationTime timestamp, length long"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The latest entry of every file in the table; empty for no table."""
    if not _exists(spark, f"{path}/{MANIFEST}"):
        return spark.createDataFrame([], FILE)
    entries = spark.read.schema(FILE + ", load long").parquet(f"{path}/{MANIFEST}")
    return entries.groupBy("path").agg(F.max_by(F.struct("modificationTime", "length"), "load").alias("f")).select("path", "f.*")


def listing(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files under ``paths``; their content is not read."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "modificationTime", "length")


def _parsed(spark: SparkSession, files: list[str]) -> DataFrame:
    """Request rows of files, each with its ``file``."""
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("file"))
    return requests_table(lines, keep=["file"]).withColumn("date", F.to_date("time"))


def ingest(spark: SparkSession, paths: Sequence[str], path: str, compression: str = "zstd") -> int:
    """Bring the table at ``path`` up to the log files under ``paths``; how many were new or changed."""
    known = manifest(spark, path)
    new = checkpointed(listing(spark, paths).join(known, ["path", "modificationTime", "length"], "left_anti"))
    files = [r["path"] for r in new.select("path").collect()]  # names of the new files, as the scan needs them
    if not files:
        return 0
    fresh = _parsed(spark, files)
    staged = shared_path(spark, "ingest")
    if not known.isEmpty():
        old = read_loaded(spark, path)
        # a date is rewritten if a new file has rows of it, or had; NULL is the date of lines without time
        touched = fresh.select("date").unionByName(old.where(F.col("file").isin(files)).select("date")).distinct().withColumnRenamed(
            "date", "touched")
        dates = [r["touched"] for r in touched.collect()]  # one a calendar date of the new lines
        inside = F.col("date").isin([d for d in dates if d is not None])
        inside = inside | F.col("date").isNull() if None in dates else inside
        kept = old.where(inside & ~F.col("file").isin(files)).select(*fresh.columns)
        fresh = fresh.unionByName(kept)
        fresh.write.parquet(staged)  # the old rows are read before their partitions are replaced
        fresh = spark.read.schema(fresh.schema).parquet(staged)
        empty = _emptied(spark, path, dates, fresh)
    else:
        empty = []
    (fresh.hint("rebalance", "date").sortWithinPartitions("date", "time").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy("date").parquet(path))
    for folder in empty:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    load = spark.sql("SELECT unix_micros(current_timestamp())").first()[0]
    new.withColumn("load", F.lit(load)).coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")
    return len(files)


def _emptied(spark: SparkSession, path: str, dates: list, fresh: DataFrame) -> list:
    """Folders of touched dates that have no row any more."""
    left = {r["date"] for r in fresh.select("date").distinct().collect()}
    folder = lambda d: "__HIVE_DEFAULT_PARTITION__" if d is None else str(d)
    return [spark._jvm.org.apache.hadoop.fs.Path(f"{path}/date={folder(d)}") for d in dates if d not in left]


def read_loaded(spark: SparkSession, path: str) -> DataFrame:
    """The request columns, ``file`` and ``date``."""
    df = spark.read.parquet(path)
    return df.withColumn("date", F.col("date").cast("date"))
