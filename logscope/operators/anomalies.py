"""Isolation-forest anomaly scores for host features.

Spark job layout (Liu, Ting and Zhou, 2008):

1. Subsampling without a cross product: each row tests all tree ids in
   one JVM higher-order ``filter`` over a hash and keeps the few trees
   whose threshold it passes (expected ``4 * psi`` rows per tree); a
   window per tree then keeps the ``psi`` smallest hashes. Every tree
   partition is bounded (about ``4 * psi`` rows).
2. ``groupBy('tree').applyInPandas`` grows one random isolation tree per
   group (numpy); at most ``n_trees * (2 * psi - 1)`` nodes in total. A hash
   of (tree, node) picks a node's feature and cut.
3. Rows meet the node table (bounded by the line above) in one broadcast
   join a level, and the path lengths of a row's trees are summed. Path
   lengths are whole millionths, so a sum does not depend on its order and
   equal rows get equal scores.
4. The outlier threshold is the exact (1 - contamination) quantile of the
   scores, found in bounded memory (``ranks``); label -1 above it, 1
   otherwise, as ``fit_predict`` does.

Choices come from md5, so SQL can grow the same forest.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscope.functions.numeric import round_to
from logscope.operators.features import FEATURES, host_features_derived, ml_ready
from logscope.operators.ranks import linear_quantile
from logscope.session import checkpointed, ship_package

NODE_SCHEMA = "tree int, node int, feature int, threshold double, n bigint"
EULER = 0.5772156649
#: Unit of a path length.
MICRO = 1_000_000
#: Rows that one task takes through all trees.
TASK_ROWS = 20_000
#: Hex digits of a hash that are used: 52 bits, exact in a double.
DIGITS = 13


def avg_path(n: float) -> float:
    """Average unsuccessful-search path length c(n) of a binary search tree."""
    if n > 2:
        return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
    return 1.0 if n == 2 else 0.0


def _avg_path_micro(n: Column) -> Column:
    long = 2.0 * (F.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
    return F.when(n > 2, F.floor(long * float(MICRO) + 0.5)).otherwise(F.when(n == 2, MICRO).otherwise(0)).cast("bigint")


def _hash(*parts) -> Column:
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, DIGITS)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _sample(x: DataFrame, id_col: str, n_trees: int, psi: int, n: int, seed: int) -> DataFrame:
    """``psi`` rows of ``x`` for each ``tree``: those of the smallest hashes."""
    def h(t):
        return _hash(t.cast("string"), F.lit(str(seed)), F.col(id_col).cast("string"))

    share = 4.0 * psi / max(n, 1)
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    if share < 1:
        bound = F.lit(format(int(share * 16 ** DIGITS), f"0{DIGITS}x"))
        trees = F.filter(trees, lambda t: h(t) < bound)
    w = Window.partitionBy("tree").orderBy(h(F.col("tree")), id_col)
    drawn = x.withColumn("tree", F.explode(trees)).repartition(min(n_trees, _tasks(x)), "tree")  # few bytes, but trees take time
    return drawn.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= psi).drop("_at")


def _grow(pdf: pd.DataFrame, cols: list[str], max_depth: int, seed: int) -> pd.DataFrame:
    """One tree from its at most ``psi`` rows. Node 1 is the root, 2 i and 2 i + 1 the
    sides of node i below its threshold and from it on."""
    tree, x = int(pdf["tree"].iloc[0]), pdf[cols].to_numpy(dtype=float)

    def unit(what: str, node: int) -> float:
        digest = hashlib.md5(f"{what}:{tree}:{node}:{seed}".encode()).hexdigest()
        return (int(digest[:DIGITS], 16) + 0.5) / float(16 ** DIGITS)

    nodes, level = [], {1: np.arange(len(x))}
    for depth in range(max_depth + 1):
        below = {}
        for node, rows in level.items():
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            varying = np.flatnonzero(low < high)
            if depth == max_depth or not len(varying):
                nodes.append((tree, node, None, None, len(rows)))
                continue
            f = int(varying[int(unit("feature", node) * len(varying))])
            cut = float(low[f] + unit("threshold", node) * (high[f] - low[f]))
            nodes.append((tree, node, f, cut, len(rows)))
            right = x[rows, f] >= cut
            below |= {n: r for n, r in ((2 * node, rows[~right]), (2 * node + 1, rows[right])) if len(r)}
        level = below
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "n"]).astype({"feature": "Int32"})


def grow(sample: DataFrame, cols: list[str], depth: int, seed: int) -> DataFrame:
    """Nodes (tree, node, feature, threshold, n) of one isolation tree per ``tree`` of
    ``sample``; ``feature`` (place in ``cols``) and ``threshold`` are null at a leaf."""
    ship_package(sample.sparkSession)  # the workers import this module
    return sample.groupBy("tree").applyInPandas(lambda pdf: _grow(pdf, cols, depth, seed), NODE_SCHEMA)


def path_lengths(x: DataFrame, nodes: DataFrame, cols: list[str], id_col: str, n_trees: int, depth: int) -> DataFrame:
    """(id, total): the path lengths, in millionths, of each row of ``x`` through
    all trees, a level a join. A side that no sampled row took ends the path."""
    width = 2 ** (depth + 1)
    level_of = F.length(F.bin("node")) - 1
    table = F.broadcast(nodes.select(  # at most n_trees * (2 * psi - 1) rows
        (F.col("tree").cast("bigint") * width + F.col("node")).alias("key"), "feature", "threshold",
        F.when(F.col("feature").isNull(), level_of * MICRO + _avg_path_micro(F.col("n"))).alias("leaf")))
    base = F.col("tree").cast("bigint") * width
    at = x.select(id_col, F.array(*cols).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
    at = at.select("*", (base + 1).alias("key"), F.lit(None).cast("bigint").alias("path"))
    for level in range(depth + 1):
        right = (F.get("x", F.col("feature")) >= F.col("threshold")).cast("int")
        ends = F.when(F.col("key").isNotNull() & F.col("feature").isNull(), F.coalesce("leaf", F.lit(level * MICRO)))
        at = at.join(table, "key", "left").select(
            id_col, "x", "tree", F.when(F.col("feature").isNotNull(), base + 2 * (F.col("key") - base) + right).alias("key"),
            F.coalesce("path", ends).alias("path"))
    return at.groupBy(id_col).agg(F.sum("path").alias("total"))


def isolation_forest(features: DataFrame, cols: list[str], id_col: str = "host", n_trees: int = 100,
                     sample_size: int = 256, contamination: float = 0.1, seed: int = 42, digits: int = 6) -> DataFrame:
    """``(id, anomaly_score, label)`` for every id, one row each; label -1 = anomaly.
    Null features count as 0. Features are rounded to ``digits`` places, so that the last bit
    of an average never makes a column vary. A single row scores 0.5."""
    x = features.select(id_col, *[round_to(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), digits).alias(c) for c in cols])
    n = x.count()
    psi = max(1, min(sample_size, n))
    depth = int(math.ceil(math.log2(max(psi, 2))))
    nodes = checkpointed(grow(_sample(x, id_col, n_trees, psi, n, seed), cols, depth, seed))
    mean = F.col("total") / F.lit(float(n_trees * MICRO))
    score = F.pow(F.lit(2.0), -mean / F.lit(avg_path(psi))) if psi > 1 else F.lit(0.5)
    spread = x.repartition(max(_tasks(x), n // TASK_ROWS + 1), id_col)  # the sums by id need no other shuffle
    scored = path_lengths(spread, nodes, cols, id_col, n_trees, depth).select(id_col, score.alias("anomaly_score"))
    scored = checkpointed(scored)  # the threshold passes and the result read it
    cut = F.lit(linear_quantile(scored, 1.0 - contamination, "anomaly_score"))
    return scored.withColumn("label", F.when(F.col("anomaly_score") > cut, F.lit(-1)).otherwise(F.lit(1)))


def host_anomalies(df: DataFrame, **kw) -> DataFrame:
    """Isolation-forest scores of the per-host features. The feature table
    is checkpointed first: the forest reads it four times (count, sample,
    score, threshold) and must not re-aggregate the requests each time."""
    feats = checkpointed(ml_ready(host_features_derived(df)))
    return isolation_forest(feats, FEATURES, "host", **kw)


def anomaly_facts(scored: DataFrame, contamination: float = 0.1) -> DataFrame:
    """What the labels must satisfy, recomputed from the scores."""
    flagged, s = F.col("label") == -1, F.col("anomaly_score")
    n = F.count_if(flagged)
    apart = F.min(F.when(flagged, s)) > F.max(F.when(~flagged, s))
    return scored.agg(F.count("*").alias("n_hosts"), ((n > 0) & (n <= F.ceil(F.count("*") * contamination))).alias("share_kept"),
                      apart.alias("separated"), F.count_if((s <= 0) | (s >= 1)).alias("out_of_range"))
