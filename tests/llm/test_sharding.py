import random
import zlib
from collections import Counter, defaultdict

import pytest

from logscope.llm import sharding
from logscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_best_fit(items, capacity, max_bins=None):
    room, out = [], {}
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        fits = [(r, b) for b, r in enumerate(room) if r >= size]
        if fits:
            b = min(fits)[1]
        elif max_bins is None or len(room) < max_bins:
            room.append(capacity)
            b = len(room) - 1
        else:
            b = max((r, b) for b, r in enumerate(room))[1]
        room[b] -= size
        out[item] = b
    return out


@pytest.mark.parametrize("max_bins", [None, 5])
def test_best_fit_equals_brute_force(max_bins):
    rng = random.Random(3)
    for _ in range(20):
        items = [(rng.randint(0, 60), f"i{i}") for i in range(rng.randint(0, 200))]
        assert sharding.best_fit(items, 100, max_bins) == brute_best_fit(items, 100, max_bins)


def check(rows, docs, n_shards=24, split=()):
    """``docs``: id -> text, ids unique."""
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    bytes_of, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw)) and 0 <= r.shard < n_shards
        bytes_of[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[raw].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for t, h in homes.items() if t not in split)
    return [bytes_of[s] for s in range(n_shards)]


def test_query_balances_whole_groups(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op8_shards"](spark, SF).collect()
    sizes = check(rows, docs)
    assert max(sizes) <= 1.02 * sum(sizes) / 24 and min(sizes) >= 0.98 * sum(sizes) / 24
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_hot_group_is_split_and_many_buckets_have_no_gap(spark):
    hot = "same " * 20
    docs = {i: hot if i % 3 == 0 else f"text {i} " * (i % 30) for i in range(3000)}
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs.items()], "doc_id long, text string, shard int, item string")
    sizes = check(sharding.shards(df, bucket_rows=10).collect(), docs, split={hot.encode()})
    assert max(sizes) <= 1.05 * sum(sizes) / 24 and min(sizes) >= 0.95 * sum(sizes) / 24


def test_fixed_capacity_uses_few_shards(spark):
    docs = {i: "y" * (i % 90) + str(i) for i in range(500)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = sharding.shards(df, n_shards=None, capacity=4000).collect()
    n = max(r.shard for r in rows) + 1
    sizes = check(rows, docs, n)
    assert max(sizes) <= 4000 and n <= -(-sum(sizes) // 4000) + 1


def test_odd_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, None), (None, ""), (1, "é" * 50000), (1, "é" * 50000), (2, None)], "doc_id long, text string")
    rows = sharding.shards(df, n_shards=3).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        [("None", 8, 0), ("None", 8, 0), ("2", 8, 0)] + [("1", 100008, zlib.crc32(("é" * 50000).encode()))] * 2)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shards(df.limit(0)).count() == 0


@pytest.mark.parametrize("max_bins", [None, 4])
def test_classes_pack_as_their_items_one_by_one(max_bins):
    rng = random.Random(8)
    for _ in range(60):
        classes = sorted({rng.randint(1, 60): rng.randint(1, 40) for _ in range(rng.randint(1, 9))}.items(), reverse=True)
        steps, bins = sharding.pack(classes, 100, max_bins)
        got = {}
        for (size, count), runs in zip(classes, steps):
            for i in range(count):
                number, first, each = max(r for r in runs if r[0] <= i)
                got[f"{1000 - size:04d}.{i:04d}"] = first + (i - number) // each
        want = brute_best_fit([(s, f"{1000 - s:04d}.{i:04d}") for s, c in classes for i in range(c)], 100, max_bins)
        assert Counter(got.values()) == Counter(want.values()) and bins == len(set(want.values()))
        assert got == want


def test_driver_work_does_not_grow_with_items_or_bins():
    steps, bins = sharding.pack([(100.0, 10_000_000), (33.0, 50_000_000), (1.0, 10)], 1000)
    assert bins == 1_000_000 + 50_000_000 // 30 + 1 and sum(map(len, steps)) < 10


def test_third_of_the_rows_are_copies_with_null_id(spark):
    rows = [(None, "same " * 20) for _ in range(3000)] + [(i, f"text {i} " * (i % 30)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sharding.shards(df, bucket_rows=50).collect()
    size, slots = Counter(), defaultdict(list)
    for r in out:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(out) == 9000 and len(size) == 24
    assert max(size.values()) <= 1.02 * sum(size.values()) / 24 and min(size.values()) >= 0.98 * sum(size.values()) / 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_groups_of_all_sizes_follow_best_fit(spark):
    rng = random.Random(12)
    docs = {i: chr(97 + i % 26) * (1 << rng.randrange(4, 12)) + "%04d" % i for i in range(400)}  # few sizes: a class is one size
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    sizes = Counter(r.shard for r in sharding.shards(df, n_shards=None, capacity=5000).collect())
    bytes_of = Counter()
    for r in sharding.shards(df, n_shards=None, capacity=5000).collect():
        bytes_of[r.shard] += r.size
    want = Counter()
    for item, b in brute_best_fit([(len(t) + 8, i) for i, t in docs.items()], 5000).items():
        want[b] += len(docs[item]) + 8
    assert sorted(bytes_of.values()) == sorted(want.values()) and len(sizes) == len(want)
