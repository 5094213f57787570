"""Periodic runs of words: stretches that repeat one block again and again.

A run is a longest stretch of consecutive words in which words ``q`` apart are
equal, ``q`` being its smallest period, of at least ``max(min_words, 2 q)``
words. Runs are found by Kruskal's order over a document's suffix array: the
suffixes are united, largest common prefix (LCP) first, in a union-find whose
classes hold their positions in order. Where a union makes two positions of
different classes neighbours at a distance ``q`` no larger than the LCP ``l``,
the words from the first on have period ``q`` for ``q + l`` words, and cannot
have a smaller one, as the position that it implies would lie between the two.
Such a pair seeds a run, which is then extended to the left. Every run is seeded:
its start and the position one period on are in one class from the level of
their own LCP on, with none between them.

A run of ``min_words`` words has a seed of at least ``min_words / 2`` LCP, so only
positions whose first ``min_words / 2`` words occur again in the document can
take part: documents without such a repeat end after one rolling hash (equal
hashes are only a hint), and unions below that LCP are left out.

The suffix array is built by prefix doubling on numpy arrays; the ranks of each
round are kept, so common prefixes and suffixes of any two positions follow from
them in one step a round. A document is one unit of work: memory is some 4 bytes
a word and round, time grows as n log n, and no text is cut.

Defined results for odd input: a null or empty text, or one without words, has
no run and collapses to the empty text; repeated rows give repeated rows; runs
of equal length, start or period are all listed, by start and then period; an
empty table gives an empty table; the input's columns are kept as they are, and
one named like the result is replaced by it.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.session import ship_package

RUNS = "runs array<struct<start: long, length: long, period: long>>, collapsed string"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _may_repeat(hashes: np.ndarray, width: int) -> bool:
    """Whether some ``width`` consecutive words may occur twice."""
    with np.errstate(over="ignore"):
        rolled = hashes[:len(hashes) - width + 1].copy()
        for k in range(1, width):
            rolled *= _FACTOR
            rolled += hashes[k:len(hashes) - width + 1 + k]
    rolled.sort()
    return bool((rolled[1:] == rolled[:-1]).any())


def ranks_by_doubling(ids: np.ndarray) -> list[np.ndarray]:
    """``out[k][i]``: how many positions start with fewer than the ``2**k`` words
    at ``i``, in one order of words. A suffix that ends early comes first. The
    last round has no equal ranks."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    first = np.concatenate([[0], np.flatnonzero(sorted_ids[1:] != sorted_ids[:-1]) + 1]).astype(np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    out, step = [rank], 1
    while True:
        size = np.bincount(rank, minlength=n)
        live = np.flatnonzero(size[rank] > 1)
        if not len(live):
            return out
        ahead = live + step
        key = rank[live] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        at = np.arange(len(live))
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        old = rank[live]
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        start = np.maximum.accumulate(np.where(new_key, at, 0)) - np.maximum.accumulate(np.where(new_old, at, 0))
        rank = rank.copy()
        rank[live] = old + start
        out.append(rank)
        step *= 2


def common_prefix(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words in common from ``i`` and from ``j`` on (``i != j``)."""
    n = len(ranks[0])
    found = np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = i + found, j + found
        fits = np.maximum(a, b) + (1 << k) <= n
        same = fits & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
        found += same.astype(np.int64) << k
    return found


def common_suffix(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words in common before ``i`` and before ``j`` (``i < j``)."""
    found = np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = i - found - (1 << k), j - found - (1 << k)
        same = (a >= 0) & (ranks[k][np.maximum(a, 0)] == ranks[k][np.maximum(b, 0)])
        found += same.astype(np.int64) << k
    return found


def _unite(large: list[int], small: list[int], lcp: int, seeds: list[tuple[int, int, int]]) -> None:
    """Put the ordered ``small`` into the ordered ``large``; neighbours that come
    from the two different lists at a distance within ``lcp`` are seeds."""
    last = len(small) - 1
    at = 0
    for m, x in enumerate(small):
        at = bisect_left(large, x, at)
        if at and (not m or large[at - 1] != small[m - 1]) and x - large[at - 1] <= lcp:
            seeds.append((large[at - 1], x, lcp))
        if at < len(large) and (m == last or small[m + 1] > large[at]) and large[at] - x <= lcp:
            seeds.append((x, large[at], lcp))
        large.insert(at, x)


def kruskal_seeds(first: np.ndarray, second: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(i, j, l): positions that become neighbours in a class at distance
    ``j - i <= l = lcp(i, j)``, from neighbours of the suffix array."""
    order = np.argsort(-lcp, kind="stable")
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    seeds: list[tuple[int, int, int]] = []

    def root(x: int) -> int:
        if x not in parent:
            parent[x], members[x] = x, [x]
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j, l in zip(first[order].tolist(), second[order].tolist(), lcp[order].tolist()):
        a, b = root(i), root(j)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        _unite(members[a], members[b], l, seeds)
        parent[b] = a
        del members[b]
    return seeds


def runs(words: list, min_words: int = 12) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and then period."""
    none = np.zeros((0, 3), np.int64)
    least = -(-min_words // 2)
    if len(words) < max(min_words, 2) or not _may_repeat(
            np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), least):
        return none
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    ranks = ranks_by_doubling(ids)
    array = np.empty(len(ids), np.int64)
    array[ranks[-1]] = np.arange(len(ids))
    level = min(least.bit_length() - 1, len(ranks) - 1)
    near = np.flatnonzero(ranks[level][array[1:]] == ranks[level][array[:-1]])
    i, j = array[near], array[near + 1]
    lcp = common_prefix(ranks, i, j)
    deep = lcp >= least
    seeds = np.array(kruskal_seeds(i[deep], j[deep], lcp[deep]), np.int64).reshape(-1, 3)
    i, j, l = seeds.T
    left = common_suffix(ranks, i, j)
    found = np.stack([i - left, l + left + j - i, j - i], axis=1)
    return np.unique(found[found[:, 1] >= min_words], axis=0) if len(found) else none


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words outside what a run says again, joined by one space."""
    if not len(found):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return b" ".join(words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist())


def periodic(text: Column, min_words: int = 12) -> Column:
    """Struct of a text column's ``runs`` and its ``collapsed`` text."""

    @F.pandas_udf(RUNS)
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in texts:
            words = (raw or b"").split()  # of bytes: at space and 9-13 only
            found = runs(words, min_words)
            rows.append(([dict(zip(("start", "length", "period"), r)) for r in found.tolist()],
                         collapsed(words, found).decode("utf-8", "replace")))
        return pd.DataFrame(rows, columns=["runs", "collapsed"])

    return of(text.cast("string").cast("binary"))


def find(docs: DataFrame, text_col: str = "text", min_words: int = 12) -> DataFrame:
    """``docs`` with ``runs`` and ``collapsed`` of every whole text."""
    ship_package(docs.sparkSession)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("runs", "collapsed")]
    found = docs.select(*kept, periodic(F.col(text_col), min_words).alias("_found"))
    return found.select(*kept, "_found.runs", "_found.collapsed")
