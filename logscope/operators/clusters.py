"""Principal components, k-means and silhouette as aggregates.

Each fit is a handful of one-pass aggregates whose results are tiny: one row of
moments for the scaler and the components, k rows a round for k-means. They are
computed when the plan is built, as an estimator fit does, and go back into narrow
projections as literals. Nothing depends on how rows are partitioned, so any number of
partitions gives the same components and segments.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 20


@dataclass(frozen=True)
class Components:
    """Scaler and loadings: ``loadings[i][c]`` of column i in component c."""

    columns: list[str]
    mean: np.ndarray
    std: np.ndarray
    loadings: np.ndarray
    variance: np.ndarray

    def scaled(self) -> list[Column]:
        """Z-score of each column; 0 where a column does not vary."""
        return [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) if s > 0 else F.when(F.col(c).isNotNull(), F.lit(0.0))
                for c, m, s in zip(self.columns, self.mean, self.std)]

    def projected(self) -> list[Column]:
        z = self.scaled()
        return [sum((x * F.lit(float(w)) for x, w in zip(z[1:], by[1:])), z[0] * F.lit(float(by[0]))) for by in self.loadings.T]


def components(x: DataFrame, columns: Sequence[str], k: int) -> Components:
    """The ``k`` leading principal components of the standardised columns, from one
    row of means, deviations and covariances. The largest loading of each is positive."""
    cols, d = list(columns), len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = x.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(d)])
    cov = np.zeros((d, d))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    std = np.sqrt(np.maximum(np.diag(cov), 0))
    unit = np.where(std > 0, std, 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(unit, unit))
    top = np.argsort(-values, kind="stable")[:k]
    loadings = vectors[:, top]
    largest = loadings[np.abs(loadings).argmax(axis=0), np.arange(len(top))]
    return Components(cols, mean, std, loadings * np.where(largest < 0, -1.0, 1.0), values[top])


def _squared(columns: Sequence[str], center: Sequence[float]) -> Column:
    terms = [(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, center)]
    return sum(terms[1:], terms[0])


def _distances(columns: Sequence[str], centers: Sequence[Sequence[float]]) -> Column:
    return F.array(*[_squared(columns, c) for c in centers])


def nearest(columns: Sequence[str], centers: Sequence[Sequence[float]]) -> Column:
    """Number of the nearest centre; the first of those that tie."""
    d = _distances(columns, centers)
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def farthest_first(points: DataFrame, columns: Sequence[str], key: str, k: int) -> list[tuple[float, ...]]:
    """Starting centres: the point farthest from the origin, then always the one
    farthest from all so far, ties by the least key; fewer if points coincide."""
    centers: list[tuple[float, ...]] = []
    while len(centers) < k:
        far = F.array_min(_distances(columns, centers)) if centers else _squared(columns, [0.0] * len(columns))
        row = points.select(far.alias("far"), key, *columns).orderBy(F.col("far").desc(), key).first()
        if row is None or (centers and row["far"] <= 0):
            break
        centers.append(tuple(float(row[c]) for c in columns))
    return centers


def kmeans(points: DataFrame, columns: Sequence[str], key: str, k: int = 4, rounds: int = ROUNDS) -> list[tuple[float, ...]]:
    """Centres after at most ``rounds`` Lloyd rounds; a round is one aggregate by
    nearest centre over ``points``, which should be checkpointed. A centre that
    loses all its points stays where it is."""
    centers = farthest_first(points, columns, key, k)
    for _ in range(rounds if centers else 0):
        means = points.groupBy(nearest(columns, centers).alias("segment")).agg(*[F.avg(c).alias(c) for c in columns])
        moved = list(centers)
        for r in means.collect():  # at most k rows
            moved[r["segment"]] = tuple(float(r[c]) for c in columns)
        still = np.allclose(moved, centers, rtol=1e-12, atol=1e-12)
        centers = moved
        if still:
            break
    return centers


def labelled(points: DataFrame, columns: Sequence[str], key: str, k: int = 4, rounds: int = ROUNDS) -> DataFrame:
    """``points`` with the ``segment`` of their nearest centre, numbered in the order of the starts."""
    centers = kmeans(points, columns, key, k, rounds)
    return points.withColumn("segment", nearest(columns, centers) if centers else F.lit(None).cast("int"))


def silhouettes(rows: DataFrame, columns: Sequence[str], label: str = "segment", max_labels: int = 1000) -> DataFrame:
    """``rows`` with their ``silhouette`` on squared Euclidean distance, in closed
    form: the distances of x to n points with sum S and squared norms Q add up to
    n |x|^2 - 2 x S + Q. One aggregate gives these by segment; they come back as
    literals, so the rows take one narrow pass, however many there are. 0 for a point
    alone in its segment or without another segment; points without label are no points."""
    norm = sum((F.col(c) * F.col(c) for c in columns[1:]), F.col(columns[0]) * F.col(columns[0]))
    known = rows.where(F.col(label).isNotNull())
    stats = known.groupBy(label).agg(F.count("*").alias("n"), F.sum(norm).alias("q"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]
                                     ).orderBy(label).limit(max_labels + 1).collect()
    if len(stats) > max_labels:
        raise ValueError(f"more than {max_labels} segments")
    near, far = F.lit(None).cast("double"), F.lit(None).cast("double")
    for r in stats:
        cross = sum((F.col(c) * F.lit(float(r[f"s{i}"])) for i, c in enumerate(columns)), F.lit(0.0))
        total = F.greatest(norm * F.lit(float(r["n"])) - 2 * cross + F.lit(float(r["q"])), F.lit(0.0))
        own = F.col(label) == F.lit(r[label])
        near = F.when(own, total / F.lit(float(r["n"] - 1)) if r["n"] > 1 else F.lit(None).cast("double")).otherwise(near)
        far = F.least(far, F.when(~own, total / F.lit(float(r["n"]))))
    out = known.withColumn("_near", near).withColumn("_far", far)
    top = F.greatest("_near", "_far")
    return out.withColumn("silhouette", F.when(F.col("_near").isNull() | F.col("_far").isNull() | (top <= 0), F.lit(0.0)).otherwise(
        (F.col("_far") - F.col("_near")) / top)).drop("_near", "_far")


def evaluation(rows: DataFrame, columns: Sequence[str], label: str = "segment") -> DataFrame:
    """(segment, size, silhouette, wssse): size of each segment; the silhouette of
    all points and their squared distance to the means of their segments."""
    scored = silhouettes(rows, columns, label).groupBy(label).agg(
        F.count("*").alias("size"), F.sum("silhouette").alias("_s"),
        sum((F.var_pop(c) for c in columns[1:]), F.var_pop(columns[0])).alias("_v"))
    total = scored.agg((F.sum("_s") / F.sum("size")).alias("silhouette"), F.sum(F.col("_v") * F.col("size")).alias("wssse"))
    return scored.select(label, "size", total.select("silhouette").scalar().alias("silhouette"),
                         total.select("wssse").scalar().alias("wssse")).orderBy(label)
