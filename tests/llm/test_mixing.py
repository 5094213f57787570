import re
from collections import defaultdict

import pytest

from logscope.llm import mixing
from logscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        w, rest = sum(weight[s] for s in open_), total - sum(full.values())
        goal = {s: rest * weight[s] / w for s in open_}
        above = [s for s in open_ if goal[s] > epochs * sizes[s]]
        if not above:
            return {**goal, **full}
        full.update({s: float(epochs * sizes[s]) for s in above})


def check(rows, docs):
    """``rows``: (id, size, source_size, target, taken); ``docs``: id -> (source, text), ids unique."""
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (_, t) in docs.items()}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, (s, _) in docs.items():
        sizes[s] += words[i]
        largest[s] = max(largest[s], words[i])
    goals = brute_targets(sizes)
    assert sorted(r[0] for r in rows) == sorted(docs)
    for i, size, source_size, target, got in rows:
        s = docs[i][0]
        assert (size, source_size) == (words[i], sizes[s]) and target == pytest.approx(goals[s])
        assert got in ({0, size, 2 * size})
        taken[s] += got
    for s in sizes:
        assert abs(taken[s] - goals[s]) <= largest[s] / 2 + 1e-6


def test_query_meets_targets_and_reruns_agree(spark):
    docs = {r.doc_id: (r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first = sorted(tuple(r) for r in QUERIES["op7_mix_sources"](spark, SF).collect())
    check(first, docs)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = sorted(tuple(r) for r in QUERIES["op7_mix_sources"](spark, SF).collect())
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert first == again


def test_hot_source_odd_rows_and_carried_columns(spark):
    rows = [(i, "w " * (i % 40), "hot" if i % 3 else f"s{i % 7}", "k", i) for i in range(600)]
    rows += [(1000, None, None, None, None), (1001, "", None, "x", 1), (1002, "a b c", None, "x", 2), (1003, "z " * 50000, "big", "x", 3),
             (1004, None, "empty", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key string, size int")
    out = [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mix(df).collect()]
    check(out, {r[0]: (r[2], r[1]) for r in rows})
    emitted = mixing.mixed(df)
    assert emitted.columns == df.columns
    counts = {r.doc_id: r["count"] for r in emitted.groupBy("doc_id").count().collect()}
    assert all(counts.get(i, 0) * size == taken for i, size, _, _, taken in out)


def test_equal_rows_go_together(spark):
    rows = [(1, "a b", "x")] * 5 + [(None, "c d e", "x")] * 4 + [(i, "f " * 3, "y") for i in range(10, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    assert len({r.taken for r in out if r.doc_id == 1}) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.mixed(df).count() == 0
