"""A training corpus from ``documents``: quality rules, near-duplicates, personal
data, source mix, tokens. Each stage applies one operator to all rows that the
stage before it kept; its result is written as Parquet in the shared folder and
reread as the next one's ``docs``.

Stages read ``doc_id``, ``text`` and ``source``; all but the last pass every other
column on, whatever its name, and the last returns ``doc_id``, ``source``, ``n_tokens``
and ``ids``. Null and empty texts are documents without words, which the quality rules
reject. Repeated rows are copies, of which one stays; of near copies the one with the
smallest id, then the smallest row hash. Texts of any length are worked whole, and
empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.llm import bpe, mixing, pii, rules, simhash
from logscope.llm.common import python_workers, stored, table
from logscope.llm.queries import encoder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy v1."""
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return rules.ledger(whole, keep=["_row"]).where(rules.passes("v1")).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group within 4 bits, over 4-word shingles."""
    return simhash.deduplicate(docs, shingle=4, max_bits=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of what was found in its place."""
    python_workers(spark)
    return docs.withColumn("text", pii.masked(F.col("text"), pii.fit(docs)))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 5, 2, 1 in turn
    and share 150% of all words, at most 2 times each."""
    return mixing.mixed(docs, weights=(5, 2, 1), share=1.5, epochs=2)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    ids = bpe.encoded(docs.select("doc_id", "source", "text"), encoder(), name="ids")
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("simhash", near_duplicates), ("pii", personal_data),
    ("source_mix", source_mix), ("byte_bpe", byte_bpe)]

#: Fingerprints, model and token ids are not expressible in SQL; the tests hold
#: every stage against a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
