import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from logscope.llm import common, simhash
from logscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, max_bits=4):
    """Smallest id reachable, for a list of (id, fingerprint)."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= max_bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    names = {}
    for i, (name, _) in enumerate(fps):
        if name is not None:
            names[find(i)] = min(name, names.get(find(i), name))
    return [names.get(find(i)) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def components_of(spark, fps, max_bits=4):
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long").distinct()
    edges = simhash.links(df, max_bits)
    return {r.node: r.root for r in simhash.components(edges).collect()}, df


def check_links(spark, fps, max_bits=4):
    found, _ = components_of(spark, fps, max_bits)
    distinct = sorted({signed(x) for x in fps})
    want = brute_components([(x, x & (1 << 64) - 1) for x in distinct], max_bits)
    assert [found.get(x, x) for x in distinct] == want


def flipped(rng, x, bits):
    for b in rng.sample(range(64), bits):
        x ^= 1 << b
    return x


@pytest.mark.parametrize("text", [
    None, "", " \t\n", "One", "a b c", "a b c d", "A b C d e", "x " * 40000, "Ä ä   z w",
    " ".join(str(i) for i in range(70000))])
def test_fingerprint_is_the_defined_one(text):
    assert simhash.fingerprint(text) == signed(brute_fingerprint(text))


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(150)] + [0, (1 << 64) - 1]
    fps = seeds + [flipped(rng, rng.choice(seeds), rng.randint(0, 9)) for _ in range(500)]
    check_links(spark, fps)


def test_heavy_nodes_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_KEYS", 8)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    rng = random.Random(6)
    base = rng.getrandbits(64)
    fps = [flipped(rng, base, rng.randint(0, 7)) for _ in range(300)] + [rng.getrandbits(64) for _ in range(100)]
    check_links(spark, fps)


def test_more_blocks_than_bits_plus_one(spark, monkeypatch):
    monkeypatch.setattr(simhash, "block_count", lambda n, k: 7)
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    check_links(spark, seeds + [flipped(rng, rng.choice(seeds), rng.randint(1, 6)) for _ in range(150)])


def test_long_chain_is_one_component(spark):
    chain, x = [], 0
    for i in range(60):
        chain.append(x)
        x ^= 0b1111 << (i % 15) * 4 if i % 2 else 1 << (i % 64)
    check_links(spark, chain)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in docs]
    want = {(i, f"{fp:016x}", c) for (i, fp), c in zip(fps, brute_components(fps))}
    got = [tuple(r) for r in QUERIES["op10_simhash"](spark, SF).collect()]
    assert set(got) == want and len(got) == len(docs)


ODD = [(None, "same text here now ok"), (7, "same text here now ok"), (7, "same text here now ok"), (3, None),
       (4, ""), (None, "all alone in this place with words"), (9, "word " * 3000)]


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id long, text string, fp string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (3, 3), (4, 3), (None, None), (9, 9)], key=str)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([7, 3, None, 9], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.deduplicate(df).count() == 0


def test_deduplicate_keeps_one_row_per_component(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = simhash.deduplicate(docs)
    named = simhash.near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        r.c for r in named.select(F.col("component_id").alias("c")).distinct().collect())


def test_hub_and_hot_keys_join_by_broadcast(spark, monkeypatch):
    """Two hubs and a chain: heavy nodes by broadcast, the others by shuffle, no link lost."""
    monkeypatch.setattr(common, "HEAVY", 4)
    star = [(5, 100 + i) for i in range(200)] + [(300 + i, 900) for i in range(50)] + [(i, i + 1) for i in range(1000, 1020)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(star, "u long, v long")).collect()}
    assert got == {n: 5 for n in [5, *range(100, 300)]} | {n: 300 for n in [*range(300, 350), 900]} | {n: 1000 for n in range(1000, 1021)}

    rows = spark.createDataFrame([(0, i) for i in range(60)] + [(k, 0) for k in range(1, 21)], "k long, x long")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("top"))
    joined = common.spread_join(rows, facts, "k", "n", 80)
    assert joined.columns == ["k", "x", "top"]
    assert sorted(map(tuple, joined.collect())) == sorted([(0, i, 59) for i in range(60)] + [(k, 0, 0) for k in range(1, 21)])
