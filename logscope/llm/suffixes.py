"""Repeated passages by a sparse suffix array.

A suffix is kept where the hash of its first ``GRAM`` words is the least of
some ``SPREAD`` word positions in a row. ``GRAM + SPREAD - 1`` is ``MIN_WORDS``,
so every passage of that length holds a kept suffix, at the same place in each
of its copies, and neighbouring kept suffixes of a copy overlap.

1. Kept suffixes whose first ``GRAM`` words stand in two documents survive.
2. Survivors get their context: the ``REACH`` words after and before the gram,
   all that is needed to decide on ``MIN_WORDS``. Equal contexts are one class.
3. Classes are range-sorted by (gram, words after, words before): the suffix
   array. Each compares itself with its neighbours, and the matches extend to
   the right and, word by word, to the left.
4. Neighbours settle a class if they share all its words on both sides. A gram
   with any other class has the at most ``SPREAD`` passages of ``MIN_WORDS``
   words of each of its classes hashed and grouped over all documents, so no
   repeat is lost to the order of the array.
5. Spans that overlap or touch in a document are merged.

Exact copies and hot passages are one class with partial counts, and no step
pairs the members of a group. Words are compared by 32-bit hashes, whole grams
by 64-bit hashes.

Defined results for odd input: null, empty and short texts have no passage; a
document is an (id, text) pair, so repeated rows are one document and repeat
nothing, but each is reported; null ids are documents like others; other
columns are ignored. Repeats inside one document only do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscope.llm.common import python_workers, stored

MIN_WORDS, GRAM = 50, 32
SPREAD = MIN_WORDS - GRAM + 1
REACH = MIN_WORDS - GRAM
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode(errors="surrogatepass").split()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))


def _grams(h: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash for each ``size`` words (a power of two) in a row, by doubling."""
    with np.errstate(over="ignore"):
        n = 1
        while n < size:
            h = h[:-n] * np.uint64(pow(_BASE, n, 1 << 64)) + h[n:]
            n *= 2
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``size`` values in a row."""
    n = 1
    while 2 * n <= size:
        x, n = pick(x[:-n], x[n:]), 2 * n
    return pick(x[:len(x) - (size - n)], x[size - n:]) if size > n else x


def kept(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) of the kept suffixes of a text."""
    if len(h) < MIN_WORDS:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = _grams(h)
    least = _sliding(grams, SPREAD, np.minimum)
    edge = np.zeros(SPREAD - 1, np.uint64)
    most = _sliding(np.concatenate([edge, least, edge]), SPREAD, np.maximum)
    at = np.flatnonzero(grams == most)  # the least of some window that holds it
    return at, grams[at]


def _around(h: np.ndarray, at: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """The words after and before each gram as bytes; 0 stands beyond the text."""
    short = ((h >> np.uint64(32)).astype(np.uint32) | 1).astype(">u4")
    none = np.zeros(REACH, ">u4")
    wide = np.concatenate([none, short, none])
    after = wide[(at + GRAM + REACH)[:, None] + np.arange(REACH)]
    before = wide[(at + REACH - 1)[:, None] - np.arange(REACH)]
    return [r.tobytes() for r in after], [r.tobytes() for r in before]


def _common(a: bytes, b: bytes) -> int:
    """Leading words that two contexts share (none beyond a text's end)."""
    x, y = np.frombuffer(a, ">u4"), np.frombuffer(b, ">u4")
    stop = (x != y) | (x == 0)
    return int(stop.argmax()) if stop.any() else REACH


CLASS = ["gram", "after", "before"]
PLACE = ["gram", "context"]  # a key of 128 bits, for rows without contexts


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Furthest extension of each class to either side by its neighbours from
    other documents. Extensions of two neighbours share the gram, so they are
    one span."""
    last = None

    def out(row: list) -> dict:
        full = row[7] == _common(row[1], row[1]) and row[8] == _common(row[2], row[2])
        return dict(zip([*PLACE, "name", "right", "left"], [row[0], row[6], row[5], row[7], row[8]])) | {"settled": full}

    for batch in batches:
        done = []
        for row in zip(*(batch[c] for c in [*CLASS, "lo", "hi", "name", "context"])):
            row = [*row, 0, 0]
            row[5] = None if pd.isna(row[5]) else int(row[5])
            if row[3] != row[4]:  # equal contexts in two documents
                row[7], row[8] = _common(row[1], row[1]), _common(row[2], row[2])
            if last is not None and last[0] == row[0] and not (last[3] == last[4] == row[3] == row[4]):
                r, l = _common(last[1], row[1]), _common(last[2], row[2])
                if r + l >= REACH:
                    least = min((x for x in (last[5], row[5]) if x is not None), default=None)
                    for one in (last, row):
                        one[5], one[7], one[8] = least, max(one[7], r), max(one[8], l)
            if last is not None:
                done.append(out(last))
            last = row
        if done:
            yield pd.DataFrame(done)
    if last is not None:
        yield pd.DataFrame([out(last)])


def _exhausted(classes: DataFrame) -> DataFrame:
    """Extensions by hashed passages, for all classes of the grams given."""
    at = F.explode(F.sequence(F.lit(0), F.lit(REACH))).alias("l")
    cut = classes.select(*CLASS, "context", "lo", "hi", "name", at).withColumns({
        "b": F.expr("substring(before, 1, 4 * l)"), "a": F.expr(f"substring(after, 1, 4 * ({REACH} - l))")})
    end = F.lit(b"\0\0\0\0")  # hashed words are odd, so only a text's end has four zero bytes at a word's place
    inside = cut.where((F.expr("l = 0") | (F.substring("b", -4, 4) != end)) & (F.expr(f"l = {REACH}") | (F.substring("a", -4, 4) != end)))
    keyed = inside.select(*PLACE, "lo", "hi", "name", "l", F.xxhash64("gram", "l", "b", "a").alias("key"))
    twice = keyed.groupBy("key", "gram").agg(F.min("lo").alias("klo"), F.max("hi").alias("khi"), F.min("name").alias("kname")).where("klo <> khi")
    return keyed.select(*PLACE, "key", "l").join(twice.select("key", "gram", "kname"), ["key", "gram"]).groupBy(*PLACE).agg(
        (F.lit(REACH) - F.min("l")).alias("right"), F.max("l").alias("left"), F.min("kname").alias("name"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated passage and document: id, ``start_word``,
    ``end_word`` (exclusive), ``n_words``, ``class_id`` (the smallest id among
    the documents it was matched with, its own included)."""
    python_workers(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.lit("doc"), id_col, text_col).alias("doc"))

    @F.pandas_udf("array<long>")
    def grams(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(kept(_word_hashes(t))[1]).view(np.int64) for t in texts], dtype=object)

    every = stored(rows.select("doc", F.explode(grams("text")).alias("gram")), "suffix-grams")
    twice = every.groupBy("gram").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("gram")
    of_doc = stored(every.join(twice, "gram").groupBy("doc").agg(F.collect_set("gram").alias("grams")), "suffix-survivors")

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, id_, text, mine in zip(batch["doc"], batch["id"], batch["text"], batch["grams"]):
                h = _word_hashes(text)
                at, gram = kept(h)
                gram = gram.view(np.int64)
                here = np.isin(gram, np.asarray(mine, np.int64))
                after, before = _around(h, at[here])
                yield pd.DataFrame({"doc": doc, "id": pd.array([None if pd.isna(id_) else int(id_)] * len(after), "Int64"),
                                    "pos": at[here].astype(np.int32), "gram": gram[here], "after": after, "before": before})

    members = stored(rows.join(of_doc, "doc").mapInPandas(
        contexts, "doc long, id long, pos int, gram long, after binary, before binary"), "suffix-members")
    named = F.xxhash64("after", "before").alias("context")
    classes = stored(members.groupBy(*CLASS).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("id").alias("name"))
                     .withColumn("context", named), "suffix-classes")
    array = classes.repartitionByRange(*CLASS).sortWithinPartitions(*CLASS)
    compared = stored(array.mapInPandas(_compared, "gram long, context long, name long, right int, left int, settled boolean"), "suffix-compared")
    open_ = compared.where(~F.col("settled")).select("gram").distinct()
    found = compared.where("settled").select(*PLACE, "right", "left", "name").union(
        _exhausted(classes.join(open_, "gram", "left_semi")).select(*PLACE, "right", "left", "name"))
    reach = stored(found.groupBy(*PLACE).agg(
        F.max("right").alias("right"), F.max("left").alias("left"), F.min("name").alias("name")), "suffix-reach")
    placed = members.select("doc", "id", "pos", "gram", named)
    spans = placed.join(reach, PLACE).select("doc", "id", "name", (F.col("pos") - F.col("left")).alias("start"),
                                             (F.col("pos") + GRAM + F.col("right")).alias("end")).distinct()
    order = Window.partitionBy("doc").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= before, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = spans.withColumn("island", island).groupBy("doc", "island").agg(
        F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("name").alias("class_id"))
    own = docs.select(F.col(id_col).alias(id_col), F.xxhash64(F.lit("doc"), id_col, text_col).alias("doc"))
    return own.join(merged, "doc").select(id_col, "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "class_id")
