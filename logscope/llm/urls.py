"""URL filters by a cascade of Bloom filters.

A rule is a host (with its subdomains) and a path prefix, to allow or to block.
The keys a url can match are its host suffixes joined with its path prefixes, of
just the label counts and lengths that rules have. The universe of a cascade is
every such key of the corpus, plus the rules' own.

Level 1 encodes the listed keys, level 2 the keys of the universe that level 1
takes wrongly, level 3 the listed keys that level 2 takes wrongly, and so on
until a level takes nothing wrongly. A key is listed if the first level that
does not hold it has an even number (or the last level does, by parity). So for
every key of the universe membership is exact, and the filter pass over the
corpus is one narrow projection: no join and no shuffle.

Each level is a tenth of the one two before it, so all levels together hold
some 20 bits per listed key. Their size is checked against ``max_bytes``
before they are built and broadcast; beyond it the listed keys are cut into
``parts`` by hash, and each part is a cascade and a pass of its own.

Defined results for odd input: a null url, or one without ``://``, has an empty
host and path, which no rule fits; what no rule fits is allowed; of several
rules the one with the longest host and path wins, then the one with the longer
host; a key that is listed both ways is blocked; repeated rows give repeated
rows; other columns are ignored; no rules at all allow everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.llm.common import python_workers, stored

ALLOW, BLOCK = "allow", "block"
RATE = 0.1  # of wrong positives, per level
HASHES = math.ceil(math.log2(1 / RATE))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit positions (keys x HASHES) of keys given by two 64-bit hashes."""
    with np.errstate(over="ignore"):
        a, b = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
        at = a ^ (np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))
        at = (at ^ (at >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + b * np.uint64(2 * level + 1)
        x = at[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x >> np.uint64(11)) % np.uint64(bits)


class Level:
    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def holds(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        at = _positions(h1, h2, level, self.bits)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


class Cascade:
    """Exact membership over the universe it was built on."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def lists(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether keys are listed."""
        listed = np.zeros(len(h1), bool)
        open_ = np.arange(len(h1))
        for k, level in enumerate(self.levels):
            open_ = open_[level.holds(h1[open_], h2[open_], k)]
            listed[open_] = k % 2 == 0
            if not len(open_):
                break
        return listed


def hashes(key: Column) -> list[Column]:
    """Two hashes that tell keys apart: 128 bits together."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def bits_for(n: int) -> int:
    return 64 * max(1, math.ceil(n * HASHES / math.log(2) / 64))


def _built(keys: DataFrame, level: int, bits: int) -> Level:
    """The filter of ``keys`` (h1, h2): words are or-ed per task, then by word."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.unique(_positions(batch["h1"].to_numpy(), batch["h2"].to_numpy(), level, bits).ravel())
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            if len(at):
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pd.DataFrame({"word": word.astype(np.int64), "value": value.view(np.int64)})

    words = np.zeros(bits // 64, np.uint64)
    rows = keys.select("h1", "h2").mapInPandas(partial, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
    for r in rows.toLocalIterator():  # at most bits / 64 rows: max_bytes holds
        words[r["word"]] = np.uint64(r["value"] & 0xFFFFFFFFFFFFFFFF)
    return Level(bits, words)


def _passing(keys: DataFrame, level: Level, k: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def holds(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(shared.value.holds(h1.to_numpy(), h2.to_numpy(), k))

    return keys.where(holds("h1", "h2"))


def cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = 64 << 20) -> Cascade:
    """A cascade for the keys ``listed`` (h1, h2) over ``universe`` (h1, h2)."""
    python_workers(listed.sparkSession)
    listed = stored(listed.select("h1", "h2").distinct(), "cascade-listed")
    levels: list[Level] = []
    inside, n = listed, listed.count()
    outside = None
    while n:
        bits = bits_for(n)
        if bits // 8 > max_bytes:
            raise ValueError(f"a level of {bits // 8} bytes is over max_bytes: use more parts")
        level = _built(inside, len(levels), bits)
        if outside is None:  # the only place where the whole universe is read
            wrong = _passing(universe.select("h1", "h2"), level, 0).distinct().join(listed, ["h1", "h2"], "left_anti")
        else:
            wrong = _passing(outside, level, len(levels))
        levels.append(level)
        inside, outside = stored(wrong, "cascade-wrong"), inside
        n = inside.count()
    return Cascade(levels)


class Filter:
    """Rules as cascades over the corpus, in ``parts`` by key hash."""

    def __init__(self, labels: list[int], lengths: list[int], parts: list[tuple[Cascade, Cascade]]):
        self.labels, self.lengths, self.parts = labels, lengths, parts


def _candidates(h: Column, p: Column, labels: list[int], lengths: list[int]) -> Column:
    """Keys that a url can match, longest first, then longer host first."""
    n_labels = F.size(F.split(h, r"\.", -1))
    found = [F.when((h != "") & (n_labels >= n) & (F.length(p) >= k), F.struct(
        (-F.length(F.substring_index(h, ".", -n)) - k).alias("order"), (-F.length(F.substring_index(h, ".", -n))).alias("by_host"),
        F.concat(F.substring_index(h, ".", -n), F.substring(p, 1, k)).alias("key"))) for n in labels for k in lengths]
    return F.transform(F.sort_array(F.filter(F.array(*found), lambda x: x.isNotNull())), lambda x: x["key"])


def build(pages: DataFrame, rules: DataFrame, url_col: str = "url", parts: int = 1, max_bytes: int = 64 << 20) -> Filter:
    """``rules``: verdict, host, path (rows with a null are ignored)."""
    python_workers(pages.sparkSession)
    rules = rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), "path").na.drop()
    shapes = rules.select(F.size(F.split("host", r"\.", -1)).alias("n"), F.length("path").alias("k")).distinct().collect()
    labels, lengths = sorted({r["n"] for r in shapes}), sorted({r["k"] for r in shapes})  # bounded by the longest rule
    if not shapes:
        return Filter([], [], [])
    listed = stored(rules.select("verdict", *hashes(F.concat("host", "path"))), "url-rules")
    cols = [F.explode(_candidates(host(F.col(url_col)), path(F.col(url_col)), labels, lengths)).alias("key")]
    keys = pages.select(*cols).distinct().select(*hashes(F.col("key")))
    universe = stored(keys.union(listed.select("h1", "h2")).distinct(), "url-keys")
    of = lambda df, i: df.where(F.pmod("h2", F.lit(parts)) == i)
    return Filter(labels, lengths, [tuple(
        cascade(of(listed.where(F.col("verdict") == v), i), of(universe, i), max_bytes) for v in (ALLOW, BLOCK)) for i in range(parts)])


def judge(pages: DataFrame, rules: Filter, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, ``rule`` (null: none fits), ``verdict``."""
    out = pages.select(F.col(id_col).alias(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    if not rules.parts:
        return out.select("*", F.lit(None).cast("string").alias("rule"), F.lit(ALLOW).alias("verdict"))
    keys = _candidates(F.col("host"), F.col("path"), rules.labels, rules.lengths)
    out = out.withColumn("_keys", keys)
    out = out.withColumn("_h1", F.transform("_keys", lambda k: hashes(k)[0])).withColumn("_h2", F.transform("_keys", lambda k: hashes(k)[1]))
    out = out.withColumn("_allow", F.lit(None).cast("int")).withColumn("_block", F.lit(None).cast("int"))
    n_parts = len(rules.parts)
    for i, pair in enumerate(rules.parts):
        for name, one in zip(("_allow", "_block"), pair):
            out = out.withColumn(name, F.least(name, _first(pages.sparkSession, one, i, n_parts)("_h1", "_h2")))
    won = F.least("_allow", "_block")
    return out.select(id_col, "host", "path", F.get("_keys", won).alias("rule"),
                      F.when(won == F.col("_block"), F.lit(BLOCK)).otherwise(F.lit(ALLOW)).alias("verdict"))


def _first(spark, one: Cascade, part: int, n_parts: int):
    """The index of a row's first listed key (null: none)."""
    shared = spark.sparkContext.broadcast(one)

    @F.pandas_udf("int")
    def first(h1: pd.Series, h2: pd.Series) -> pd.Series:
        n = h1.map(len).to_numpy()
        out = np.full(len(n), -1)
        if n.sum():
            a, b = np.concatenate(h1.to_list()).astype(np.int64), np.concatenate(h2.to_list()).astype(np.int64)
            row, at = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = np.flatnonzero(shared.value.lists(a, b) & (b % n_parts == part))[::-1]
            out[row[hit]] = at[hit]
        return pd.Series(out).astype("Int32").mask(pd.Series(out < 0))

    return first
