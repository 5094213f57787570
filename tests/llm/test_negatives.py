import math
import random

import numpy as np
from pyspark.sql import functions as F

from logscope.llm import negatives as N

SCHEMA = "vec_id long, embedding array<double>, label int, score int, id string, `block.rows` int"


def brute(rows, each=10, positives=5, negatives=10, low=30, high=90):
    ok = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, y in ok:
        if a % each:
            continue
        s = sorted((-max(min(sum(p * q for p, q in zip(v, w)), (1 << 63) - 1), -(1 << 63)), i, z) for i, w, z in ok if i != a)
        for ps, p, _ in [t for t in s if t[2] == y][:positives]:
            inside = [t for t in s if t[2] != y and low * -ps <= 100 * -t[0] <= high * -ps][:negatives]
            out += [(a, p, r + 1, n, -ps, -ns) for r, (ns, n, _) in enumerate(inside)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "x", 2) for i, v, y in rows], SCHEMA).repartition(3)


def found(spark, rows, each=10, **sizes):
    out = N.mine(frame(spark, rows), F.col("vec_id") % each == 0, **{"block_rows": 32, "group_rows": 7, **sizes})
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def clustered(n, seed=1, width=6, spread=.1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)], rng.randrange(4)) for i in range(n)]


def test_equals_brute_force(spark):
    rows = clustered(300)
    assert found(spark, rows) == brute(rows) != []


def test_ties_copies_and_a_hot_vector(spark):
    rows = clustered(150, seed=2) + [(150 + i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.125], i % 3) for i in range(150)]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (10, None, 1), (20, [1.0, None], 1), (30, [math.nan, 1.0], 1), (40, [math.inf, 0.0], 1),
            (None, [1.0, 1.0], 1), (50, [3.0, 1.0], None), (60, [], 1), (70, [1.0], 2), (1, [1.0, 1.0, 9.0], 1), (2, [1.0, .5], 2),
            (3, [.7, .5], 2), (80, [-1.0, -1.0], 1), (4, [0.0, 0.0], 3)]
    assert found(spark, rows) == brute(rows) != []
    assert found(spark, [r for r in rows if r[2] != 2]) == brute([r for r in rows if r[2] != 2])
    assert found(spark, rows[:0] + [(10, None, 1)]) == []
    huge = [(i, [1e17 * (i - 3), 1.0], i % 2) for i in range(12)]  # beyond exact doubles
    assert found(spark, huge, each=4) == brute(huge, each=4)


def test_repeated_rows_are_rows(spark):
    rows = clustered(60, seed=4)
    once, twice = brute(rows + rows[1:9]), found(spark, rows + rows[1:9])
    assert [r[:1] + r[2:] for r in twice] and len(twice) == len(once)
    assert sorted(r[4:] for r in twice) == sorted(r[4:] for r in once)
    doubled = found(spark, rows + rows[10:11])  # an anchor twice: both have their rows
    assert len([r for r in doubled if r[0] == 10]) == 2 * len([r for r in brute(rows) if r[0] == 10])


def test_curve_visits_neighbours():
    bits, d = 2, 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), axis=-1).reshape(-1, d)
    key = N.hilbert(cells, bits)
    assert sorted(key) == list(range(1 << bits * d))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_spare_blocks(spark):
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 50, (40, 8)))
    a = np.floor(rng.normal(0, 50, (9, 8)))
    least, most = N.bounds(a, x.min(axis=0)[None], x.max(axis=0)[None])
    s = N.scores(a, x)
    assert (least <= s).all() and (s <= most).all()
    rows = frame(spark, clustered(600, seed=6, spread=.01))
    blocks = N.block_table(rows, F.col("vec_id") % 10 == 0, block_rows=32)
    groups = N.anchor_groups(blocks, group_rows=1)
    wanted = N.wanted_blocks(groups, blocks, windows=False).count()
    assert wanted < 0.7 * groups.count() * blocks.count()


def test_query_equals_sql_on_random_vectors(spark, tmp_path):
    import duckdb
    from logscope.llm.queries import ORACLE, QUERIES
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, .2) for _ in range(8)], rng.choice([None, *range(10)])) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE["op13_hard_negatives"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op13_hard_negatives"](spark, str(tmp_path)).collect()) == want != []
