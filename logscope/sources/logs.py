"""Log-line sources.

``read_log_text`` is the production source: one row per line, column
``value``; a list of paths is a union-all scan (the reference concatenated
two monthly files byte by byte first; a multi-path scan needs no copy and
cannot glue the last line of one file to the first line of the next).

``log_lines_from_events`` derives Common Log Format lines from the
``events`` table so that every query here runs on data that grows with
the given tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.functions.parse import clf_time_text


def read_log_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Text scan of one or many files or folders (A1, A2)."""
    if isinstance(paths, str):
        paths = [paths]
    return spark.read.text(list(paths))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def log_lines_from_events(events: DataFrame, keep_id: bool = False) -> DataFrame:
    """One CLF line per event: host, time, request, status and size vary
    with the event so that every parser branch (unmatched host, empty
    request, missing protocol, missing status, ``-`` size) is exercised.
    ``event_id % 211`` picks the rare lines: 1 an empty line, 2 no readable
    time, 3 hour 24, 4 a zone that the pattern does not read, 5 four words in
    the request, 6 a size beyond 32 bits, 7 a blank at the end, 8 another zone.
    """
    eid = F.col("event_id")
    rare = eid % 211
    et = F.col("event_type")
    host = (F.when(eid % 50 == 0, F.lit("localhost"))
            .when(eid % 7 == 0, F.concat(F.lit("163.206."), (F.col("user_id") % 256).cast("string"), F.lit(".4")))
            .otherwise(F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit(".example.com"))))
    verb = (F.when(et == "signup", F.lit("HEAD"))
            .when(et == "purchase", F.lit("POST"))
            .otherwise(F.lit("GET")))
    request = F.when(rare == 5, F.lit("GET /x y z HTTP/1.0")).when(eid % 97 == 0, F.lit("")).otherwise(F.concat(
        verb, F.lit(" /"), et, F.lit("/"), (eid % 40).cast("string"), F.lit(".html"),
        F.when(eid % 11 == 0, F.lit("")).otherwise(F.lit(" HTTP/1.0"))))
    error_code = (F.when(eid % 4 == 0, F.lit("404")).when(eid % 4 == 1, F.lit("403"))
                  .when(eid % 4 == 2, F.lit("500")).otherwise(F.lit("501")))
    code = (F.when(eid % 211 == 0, F.lit("-"))
            .when(et == "error", error_code)
            .when((et == "click") & (eid % 3 == 0), F.lit("304"))
            .when((et == "purchase") & (eid % 5 == 0), F.lit("302"))
            .otherwise(F.lit("200")))
    size = F.when(rare == 6, F.lit("99999999999")).when(eid % 13 == 0, F.lit("-")).otherwise(
        F.floor(F.col("value") * 100).cast("bigint").cast("string"))
    text = clf_time_text("ts")
    stamp = (F.when(rare == 2, F.lit("bad")).when(rare == 3, F.concat(F.substring(text, 1, 12), F.lit("24:00:06 -0400")))
             .when(rare == 4, F.concat(text, F.lit(" +0100"))).when(rare == 8, F.concat(text, F.lit(" -0100"))).otherwise(F.concat(text, F.lit(" -0400"))))
    line = F.concat(host, F.lit(" - - ["), stamp, F.lit('] "'), request, F.lit('" '), code, F.lit(" "), size,
                    F.when(rare == 7, F.lit(" ")).otherwise(F.lit("")))
    line = F.when(rare == 1, F.lit("")).otherwise(line)
    cols = ([eid] if keep_id else []) + [line.alias("value")]
    return events.select(*cols)


def load_log_lines(spark: SparkSession, sf_dir: str, keep_id: bool = False) -> DataFrame:
    return log_lines_from_events(read_table(spark, sf_dir, "events"), keep_id=keep_id)
