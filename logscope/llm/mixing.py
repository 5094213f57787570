"""Mixing sources to target weights.

Each row gets a hash-random key. Rows are range-sorted by (source, key) over
all tasks, running totals of words within the range partitions are lifted by
the totals of the partitions before them (a distributed prefix sum), and each
source is cut where its running total meets its budget. A budget above the
source's size takes whole epochs first and cuts in the last one.

Only (source, key, words) rows are sorted. The cut comes out as one key per
source, so texts stay where they are: a row is in the last epoch if its key is
at most its source's cut. The row at the cut is taken if at least half of it
fits, so a source misses its target by at most half a row.

Defined results for odd input: a null text has no words; null is a source of
its own, the last; rows equal in id, source and text share a key and are taken
or left together; rows without words are kept in every epoch that reaches
them and add nothing; a source without words has target zero and is left out;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscope.llm.common import python_workers, stored, words


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, carry: Sequence[Column] = ()) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                       word_count(F.col(text_col)).alias("size"),
                       F.xxhash64(F.lit(seed), id_col, source_col, text_col).alias("key"), *carry)


def targets(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """One row per source: ``rank`` (code point order, null last), ``weight``
    (``weights`` in turn), ``source_size``, ``target``.

    Targets split ``share`` of all words by weight, at most ``epochs`` times a
    source's size; what is above goes to the others by weight. In the order of
    size per weight, a source is full if its part of what the sources before it
    leave is no less than its limit. The windows run over one row per source."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before, everywhere = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    turn = F.array(*[F.lit(w) for w in weights])
    own = sums.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.get(turn, (F.col("rank") - 1) % len(weights))).withColumn("limit", F.col("source_size") * F.lit(epochs))
    left = own.withColumns({
        "total": F.sum("source_size").over(everywhere) * F.lit(share), "weights": F.sum("weight").over(everywhere),
        "used": F.coalesce(F.sum("limit").over(before), F.lit(0)),
        "gone": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    full = left.withColumn("full", F.col("limit") * (F.col("weights") - F.col("gone")) <= (F.col("total") - F.col("used")) * F.col("weight"))
    rest = full.withColumns({
        "used": F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everywhere), F.lit(0)),
        "gone": F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(everywhere), F.lit(0))})
    part = F.col("weight") * (F.col("total") - F.col("used")) / F.nullif(F.col("weights") - F.col("gone"), F.lit(0))
    return rest.select("source", "rank", "weight", "source_size",
                       F.when(F.col("full"), F.col("limit").cast("double")).otherwise(part).alias("target"))


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words before each row, of its source and partition."""
    at, done = None, 0
    part = TaskContext.get().partitionId()
    for batch in batches:
        if not len(batch):
            continue
        upto = batch.groupby("rank")["size"].cumsum()
        if at is not None:
            upto = upto + (batch["rank"] == at) * done
        at, done = batch["rank"].iloc[-1], int(upto.iloc[-1])
        yield pd.DataFrame({"part": part, "rank": batch["rank"], "key": batch["key"], "size": batch["size"],
                            "before": upto - batch["size"]})


def cuts(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with whole ``epochs`` and ``cut``: the last key of the part
    epoch (null: no row is in it)."""
    python_workers(rows.sparkSession)
    units = rows.groupBy("source", "key").agg(F.sum("size").alias("size"))
    ranked = units.join(goals.select(F.col("source").alias("s"), "rank"), F.col("source").eqNullSafe(F.col("s"))).select("rank", "key", "size")
    ranked = stored(ranked, "mix-units")  # the range sort samples its input first
    order = ["rank", "key"]
    sums = stored(ranked.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(
        _running, "part int, rank int, key long, size long, before long"), "mix-running")
    ahead = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.groupBy("part", "rank").agg(F.sum("size").alias("words")).select(
        "part", "rank", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset"))
    whole = goals.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)))
    last = whole.select("rank", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))
    taken = sums.join(offsets, ["part", "rank"]).join(last, "rank").where(
        (F.col("rest") > 0) & (F.col("offset") + F.col("before") + F.col("size") / 2 <= F.col("rest")))
    return whole.join(taken.groupBy("rank").agg(F.max("key").alias("cut")), "rank", "left")


def plan(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """One row per source with its target, whole epochs and cut. ``rows``: of
    ``keyed``, stored."""
    goals = stored(targets(rows, weights, share, epochs), "mix-targets")
    return stored(cuts(rows, goals), "mix-cuts")


def _copies() -> Column:
    return F.col("epochs") + F.coalesce(F.col("key") <= F.col("cut"), F.lit(False)).cast("long")


def _with_plan(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    chosen = chosen.select(F.col("source").alias("s"), "source_size", "target", "epochs", "cut")
    return rows.join(chosen, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("copies", _copies())


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 7) -> DataFrame:
    """Per row: id, ``size``, ``source_size``, ``target``, ``copies``, ``taken``."""
    rows = stored(keyed(docs, id_col, text_col, source_col, seed), "mix-rows")
    out = _with_plan(rows, plan(rows, weights, share, epochs))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them."""
    rows = stored(keyed(docs, id_col, text_col, source_col, seed), "mix-rows")
    chosen = plan(rows, weights, share, epochs)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    out = _with_plan(keyed(docs, id_col, text_col, source_col, seed, [whole]), chosen)
    return out.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")
