"""File-stream variant of the log scan (A1 + B + A6 on micro-batches)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.operators.parse import requests_table


#: Files that a date gets per micro-batch, at most.
FILES_PER_DATE = 8


def parsed_log_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming request table ``R`` over text files landing in ``folder``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return requests_table(reader.load(folder))


def append_parsed_logs(stream: DataFrame, table_path: str, checkpoint_path: str, trigger_once: bool = True):
    """Append parsed rows to the parquet table partitioned by date.

    ``checkpoint_path`` must be on shared storage (the stream's offsets
    and commit log), so a restarted driver resumes without duplicates.
    """
    # a date meets in a few tasks, not in every one: few files, and no hot date in one task
    part = F.pmod(F.xxhash64("host", "time", "endpoint"), F.lit(FILES_PER_DATE))
    w = (stream.withColumn("date", F.to_date("time")).repartition(F.col("date"), part).writeStream
         .format("parquet").option("path", table_path)
         .option("checkpointLocation", checkpoint_path)
         .partitionBy("date").outputMode("append"))
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
