"""Exact top-k search by inner product: one KD-tree per shard of vectors.

Every input task cuts its rows into shards of at most ``shard_rows`` and builds
a tree for each: median splits along the widest side, a tight box per node. The
trees are written to the shared folder once. The query set is cut into blocks of
rows as well, and goes against the trees in cells: a cell is a block of queries and the
few trees (``CELL`` on average) whose number hashes to one value, so a cell's size
depends on neither table. A first round holds every block against one cell and
yields a kth best score per query, a bound that the true kth best cannot be below;
the second round hands it to every task, which searches its trees one after the other
and raises it further. Within a tree nodes are visited best first, by the largest
inner product that their box allows, until that is below the kth score. A cell
returns at most k rows per query, and a window over those picks the final k.
Both rounds are joins: the number of Spark jobs does not depend on the number
of queries or trees, and the driver sees one count.

Components are floored to integers (256 * x), and scores are integers: sums are
exact in doubles while they stay below 2^53, else Python integers are used and
scores end at the limits of a 64-bit integer.

Defined results for odd input: vectors that are null or hold a null or
non-finite component take no part, nor do rows without an id; rows with the
query's id are its own; repeated query rows are queries of their own; shorter
vectors are padded with zeros; fewer than k candidates give fewer rows; ties go
to smaller ids; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscope.llm.common import stored
from logscope.session import ship_package

EXACT = 2.0 ** 53
#: Trees of a cell, on average.
CELL = 4
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


class Tree:
    """A KD-tree over the rows of ``x``; nodes are ranges of the reordered rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = 128):
        order = np.arange(len(ids))
        nodes, todo = [], [(0, len(ids), -1, 0)]
        lo, hi = [], []
        while todo:
            a, b, parent, side = todo.pop()
            rows = x[order[a:b]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            at = len(nodes)
            nodes.append([a, b, -1, -1])
            lo.append(low)
            hi.append(high)
            if parent >= 0:
                nodes[parent][2 + side] = at
            if b - a > leaf and (high > low).any():
                d, mid = int(np.argmax(high - low)), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(rows[:, d], mid)]
                todo += [(a, a + mid, at, 0), (a + mid, b, at, 1)]
        self.ids, self.x = ids[order], x[order]
        self.nodes, self.lo, self.hi = np.array(nodes), np.array(lo), np.array(hi)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, x=_small(self.x), nodes=self.nodes, lo=_small(self.lo), hi=_small(self.hi))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Tree":
        self = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            self.ids, self.nodes = z["ids"], z["nodes"]
            self.x, self.lo, self.hi = (z[k].astype(float) for k in ("x", "lo", "hi"))
        return self

    def search(self, queries: np.ndarray, ids: np.ndarray, best: list["Best"]) -> int:
        """Improve ``best`` of each query; returns how many leaves were read."""
        width = max(queries.shape[1], self.x.shape[1])
        q, x, lo, hi = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (queries, self.x, self.lo, self.hi))
        if width * max(np.abs(q).max(initial=0), 1) * max(np.abs(lo).max(), np.abs(hi).max(), 1) >= EXACT:
            q, x, lo, hi = (_integers(m) for m in (q, x, lo, hi))
        bounds = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
        nodes, read = self.nodes.tolist(), 0
        for i, found in enumerate(best):
            bound, vector = bounds[i].tolist(), q[i]
            heap = [(-bound[0], 0)]
            while heap:
                top, at = heappop(heap)
                if -top < found.kth:
                    break
                a, b, left, right = nodes[at]
                if left >= 0:
                    for child in (left, right):
                        if bound[child] >= found.kth:
                            heappush(heap, (-bound[child], child))
                else:
                    found.take(x[a:b] @ vector, self.ids[a:b], ids[i])
                    read += 1
        return read


def _small(m: np.ndarray) -> np.ndarray:
    return m.astype(np.int16) if np.abs(m).max(initial=0) < 1 << 15 else m


def _integers(m: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in m.tolist()], dtype=object).reshape(m.shape)


class Best:
    """The k best (score, id) of a query so far."""

    __slots__ = ("k", "found", "kth")

    def __init__(self, k: int, kth: float = float("-inf")):
        self.k, self.found, self.kth = k, [], kth

    def take(self, scores: np.ndarray, ids: np.ndarray, own: int) -> None:
        near = np.flatnonzero(scores >= self.kth)
        near = near[ids[near] != own]
        if len(near) > self.k:  # the best k and what ties with the last of them
            near = near[scores[near] >= np.sort(scores[near])[-self.k]]
        new = [(-int(scores[j]), int(ids[j])) for j in near]
        if new:
            self.found = sorted(self.found + new)[:self.k]
            if len(self.found) == self.k:
                self.kth = -self.found[-1][0]


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _floored(vectors: pd.Series) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), max(width, 1)))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return np.floor(256 * out)


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, leaf: int = 128) -> DataFrame:
    """One row per shard: ``tree`` and its ``data``, stored in the shared folder."""
    ship_package(vectors.sparkSession)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, rows in _cut(batches, shard_rows):
            tree = Tree(rows["id"].to_numpy(np.int64), _floored(rows["v"]), leaf)
            yield pd.DataFrame({"tree": [number], "data": [tree.to_bytes()]})

    return stored(_vectors(vectors, id_col, vector_col).mapInPandas(build, "tree long, data binary"), "kd-trees")


def _vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return rows.where(F.col(id_col).isNotNull() & _usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def _cut(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[int, pd.DataFrame]]:
    """Numbered pieces of at most ``size`` rows of a task's batches."""
    number, held, n = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        while len(batch):
            part, batch = batch[:size - n], batch[size - n:]
            held.append(part)
            n += len(part)
            if n == size:
                yield number, pd.concat(held)
                number, held, n = number + 1, [], 0
    if n:
        yield number, pd.concat(held)


def _pack(ids: np.ndarray, x: np.ndarray, kth: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, ids=ids, x=_small(x), kth=kth)
    return out.getvalue()


def query_blocks(queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 4096) -> DataFrame:
    """``block`` and its ``queries``, stored; no bound is known yet."""
    ship_package(queries.sparkSession)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, rows in _cut(batches, block_rows):
            yield pd.DataFrame({"block": [number], "queries": [_pack(
                rows["id"].to_numpy(np.int64), _floored(rows["v"]), np.full(len(rows), -np.inf))]})

    return stored(_vectors(queries, id_col, vector_col).mapInPandas(build, "block long, queries binary"), "kd-queries")


def search(trees: DataFrame, blocks: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(block, at, query_id, vec_id, score, leaves): up to ``k`` rows for each query in
    every (block, cell) of ``pairs``; ``leaves`` is what its cell read in all."""

    def of(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        with np.load(io.BytesIO(right["queries"].iloc[0])) as z:
            ids, x, kth = z["ids"], z["x"].astype(float), z["kth"]
        best = [Best(k, bound) for bound in kth.tolist()]
        leaves = sum(Tree.from_bytes(data).search(x, ids, best) for data in left.sort_values("tree")["data"])
        rows = [(key[0], i, int(ids[i]), vec_id, min(max(-score, _LOW), _HIGH), leaves) for i, b in enumerate(best) for score, vec_id in b.found]
        return pd.DataFrame(rows, columns=["block", "at", "query_id", "vec_id", "score", "leaves"])

    work = pairs.join(trees, "cell").groupBy("block", "cell")
    owners = pairs.select(F.col("block").alias("block"), F.col("cell").alias("cell")).join(blocks, "block").groupBy("block", "cell")
    return work.cogroup(owners).applyInPandas(of, "block long, at int, query_id long, vec_id long, score long, leaves long")


def with_bounds(blocks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``blocks`` whose queries know the kth score among the rows found so far."""

    def of(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        with np.load(io.BytesIO(left["queries"].iloc[0])) as z:
            ids, x, kth = z["ids"], z["x"], z["kth"].copy()
        if len(right):
            kth[right["at"].to_numpy(int)] = right["score"].to_numpy(float)
        return pd.DataFrame({"block": [key[0]], "queries": [_pack(ids, x, kth)]})

    # a bound as a double must not be above the exact score
    bounds = _first(found, k).where(F.col("rank") == k).where(F.abs("score") < int(EXACT)).select("block", "at", "score")
    return stored(blocks.groupBy("block").cogroup(bounds.groupBy("block")).applyInPandas(of, "block long, queries binary"), "kd-bounds")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("block", "at").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(trees: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows in ``trees`` for each
    row of ``queries``."""
    cells = max(1, -(-trees.count() // CELL))
    trees = trees.withColumn("cell", F.pmod(F.xxhash64("tree"), F.lit(cells)))
    blocks = query_blocks(queries, id_col, vector_col, block_rows)
    one = blocks.select("block", F.pmod(F.xxhash64("block"), F.lit(cells)).alias("cell"))
    blocks = with_bounds(blocks, search(trees, blocks, one, k), k)
    every = blocks.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"))
    found = _first(search(trees, blocks, every, k), k)
    return stored(found.select("query_id", "rank", "vec_id", "score"), "kd-found")
