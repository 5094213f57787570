import math
import random

import numpy as np
import pytest

from logscope.llm import kdtree

SCHEMA = "vec_id long, embedding array<double>, score int, id string"


def brute(rows, k=5, each=50):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % each == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return sorted(out)


def found(spark, rows, k=5, each=50, **sizes):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    trees = kdtree.index(df, shard_rows=sizes.get("shard_rows", 64), leaf=sizes.get("leaf", 8))
    out = kdtree.top_k(trees, df.where(df.vec_id % each == 0), k, block_rows=sizes.get("block_rows", 7))
    return sorted(tuple(r) for r in out.collect())


def test_equals_brute_force_with_ties_and_clusters(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, .01) for c in rng.choice(centres)]) for i in range(500)]
    rows += [(500 + i, [0.5] * 6) for i in range(200)]
    assert found(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [math.nan, 1.0]), (4, [math.inf, 0.0]), (None, [1.0, 1.0]),
            (50, [3.0]), (51, []), (52, [-1.0, 0.25, 9.0]), (100, None)]
    got = found(spark, rows)
    assert got == brute(rows)
    repeated = found(spark, rows + [(0, [1.0, 2.0]), (53, [1.0, 1.0]), (53, [1.0, 1.0])])
    each = [(0, 1, 50, 3 * 65536), (0, 2, 53, 3 * 65536), (0, 3, 53, 3 * 65536)]
    assert [r for r in repeated if r[0] == 0 and r[1] <= 3] == sorted(each * 2)


def test_large_components_stay_exact(spark):
    rows = [(i, [2.0 ** 21 + i, 2.0 ** 20 - i, 1.0]) for i in range(0, 60)]
    assert found(spark, rows) == brute(rows)
    assert len(found(spark, [(i, [1e300, -1e300]) for i in range(3)])) == 2


def test_best_first_prunes():
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(64, 8))[rng.integers(0, 64, 8192)] * 4 + rng.normal(size=(8192, 8)) * .01))
    tree = kdtree.Tree.from_bytes(kdtree.Tree(np.arange(8192), x).to_bytes())
    best = [kdtree.Best(5) for _ in range(20)]
    read = tree.search(x[:20], np.arange(20), best)
    assert read < 20 * len(x) / 128 / 4
    for i, b in enumerate(best):
        want = sorted((-int(s), j) for j, s in enumerate(x @ x[i]) if j != i)[:5]
        assert b.found == want


def test_handed_bound_spares_leaves_and_jobs_do_not_grow(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(16, 4))[rng.integers(0, 16, 3000)] * 3 + rng.normal(size=(3000, 4)) * .02
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    trees = kdtree.index(df, shard_rows=100, leaf=8)
    cells = 8
    trees_in = trees.withColumn("cell", kdtree.F.pmod(kdtree.F.xxhash64("tree"), kdtree.F.lit(cells)))
    blocks = kdtree.query_blocks(df.where("vec_id % 50 = 0"), block_rows=16)
    every = blocks.select("block", kdtree.F.explode(kdtree.F.sequence(kdtree.F.lit(0), kdtree.F.lit(cells - 1))).alias("cell"))
    bare = kdtree.search(trees_in, blocks, every, 5)
    known = kdtree.with_bounds(blocks, bare, 5)  # the final kth score itself
    read = lambda found: found.groupBy("block").agg(kdtree.F.sum_distinct("leaves").alias("n")).agg({"n": "sum"}).first()[0]
    with_kth = kdtree.search(trees_in, known, every, 5)
    assert read(with_kth) < 0.8 * read(bare)
    pick = lambda f: sorted(tuple(r) for r in kdtree._first(f, 5).select("query_id", "rank", "vec_id", "score").collect())
    assert pick(with_kth) == pick(bare)

    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n, size in ((50, 4096), (50, 4)):  # one block of queries, many blocks
        spark.sparkContext.setJobGroup(f"kd-{size}", "count jobs")
        kdtree.top_k(trees, df.where(df.vec_id % n == 0), block_rows=size).count()
        jobs.append(len(tracker.getJobIdsForGroup(f"kd-{size}")))
    spark.sparkContext.setJobGroup("rest", "")
    assert abs(jobs[0] - jobs[1]) <= 6


def test_session_stays_as_it_was(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found(spark, [(i, [float(i), 1.0]) for i in range(60)])
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(0, [1.0]), (7, [2.0])]])
def test_few_rows(spark, rows):
    assert found(spark, rows) == brute(rows)
