import random
import re
from collections import defaultdict

import numpy as np

from logscope.llm import suffixes
from logscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(docs, size=50):
    """Words of each document inside a ``size``-word window that another
    document has too. ``docs``: {key: text}."""
    where = defaultdict(set)
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs.items()}
    for d, w in words.items():
        for i in range(len(w) - size + 1):
            where[tuple(w[i:i + size])].add(d)
    covered = {}
    for d, w in words.items():
        own = set()
        for i in range(len(w) - size + 1):
            if len(where[tuple(w[i:i + size])]) > 1:
                own |= set(range(i, i + size))
        if own:
            covered[d] = own
    return covered


def covered(rows):
    out = defaultdict(set)
    for r in rows:
        assert r.n_words == r.end_word - r.start_word >= 50
        out[r.doc_id] |= set(range(r.start_word, r.end_word))
    return dict(out)


def found(spark, docs):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs.items()], "doc_id long, text string, gram int, start_word string")
    return covered(suffixes.repeats(df).collect())


def prose(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_kept_suffixes_cover_every_window():
    rng = random.Random(1)
    for text in (" ".join(prose(rng, 400)), " ".join(prose(rng, 300, 2)), "a " * 200):
        h = suffixes._word_hashes(text)
        at, _ = suffixes.kept(h)
        for s in range(len(h) - 49):
            assert ((at >= s) & (at <= s + suffixes.REACH)).any()
    at, _ = suffixes.kept(suffixes._word_hashes(" ".join(prose(rng, 5000))))
    assert len(at) < 5000 * 2.4 / suffixes.SPREAD


def test_planted_passages_equal_brute_force(spark):
    rng = random.Random(2)
    passages = [prose(rng, n) for n in (49, 50, 51, 60, 120, 400)]
    docs = {}
    for i in range(60):
        parts = prose(rng, rng.randint(0, 120))
        for p in rng.sample(passages, rng.randint(0, 3)):
            parts += p + prose(rng, rng.randint(0, 30))
        docs[i] = " \n".join(parts)
    assert found(spark, docs) == brute(docs)


def test_overlapping_contexts_lose_nothing(spark):
    rng = random.Random(3)
    core = prose(rng, 34)
    docs = {}
    for i in range(120):  # one hot core, with shared and own words on both sides
        left, right = rng.choice([3, 8, 12, 16]), rng.choice([3, 8, 12, 16])
        a, b = random.Random(rng.randrange(6)), random.Random(100 + rng.randrange(6))
        docs[i] = " ".join(prose(rng, 20) + prose(a, 16)[-left:] + core + prose(b, 16)[:right] + prose(rng, 20))
    got, want = found(spark, docs), brute(docs)
    assert set(got) == set(want)


def test_query_finds_the_documents_of_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got, want = covered(QUERIES["op3_repeated_passages"](spark, SF).collect()), brute(docs)
    assert set(got) == set(want)
    assert all(got[d] <= want[d] for d in got)
    assert sum(map(len, got.values())) >= 0.99 * sum(map(len, want.values()))


def test_odd_rows_and_empty_table(spark):
    rng = random.Random(4)
    p = " ".join(prose(rng, 70))
    rows = [(None, p), (1, p + " end"), (2, None), (3, ""), (4, "short"), (5, "x " * 100000), (6, " ".join(["q r s"] * 60)),
            (7, p.replace(" ", "  \t\n")), (8, " ".join(prose(rng, 90))), (8, " ".join(prose(rng, 90)))]
    rows.append(rows[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.start_word, r.end_word, r.class_id) for r in suffixes.repeats(df).collect()), key=str)
    assert got == sorted([(None, 0, 70, 1), (1, 0, 70, 1), (7, 0, 70, 1)], key=str)
    assert suffixes.repeats(df.limit(0)).count() == 0


def test_context_words_end_with_the_text():
    h = suffixes._word_hashes(" ".join(str(i) for i in range(60)))
    after, before = suffixes._around(h, np.array([0, 28]))
    assert suffixes._common(after[1], after[1]) == 0 and suffixes._common(before[0], before[0]) == 0
    assert suffixes._common(after[0], after[0]) == suffixes.REACH == suffixes._common(before[1], before[1])


def test_partners_beyond_the_best_neighbour_count(spark):
    tried = 0
    while True:  # words such that G is the one kept gram and the array's order is C, A, B
        rng = random.Random(tried := tried + 1)
        left, gram, right, x, y = (prose(rng, n, 10 ** 6) for n in (18, 32, 18, 18, 18))
        texts = {"C": left + gram + x, "A": left + gram + right, "B": y + gram + right}
        rows = []
        for k, words in texts.items():
            h = suffixes._word_hashes(" ".join(words))
            at, _ = suffixes.kept(h)
            if list(at) != [18]:
                break
            after, before = suffixes._around(h, at)
            rows.append((after[0], before[0], k))
        if [k for _, _, k in sorted(rows)] == ["C", "A", "B"]:
            break
    docs = {i: " ".join(texts[k]) for i, k in enumerate("CAB")}
    assert found(spark, docs) == brute(docs) == {0: set(range(50)), 1: set(range(68)), 2: set(range(18, 68))}


def test_overlapping_contexts_equal_brute_force(spark):
    rng = random.Random(3)
    core = prose(rng, 34)
    docs = {}
    for i in range(120):
        left, right = rng.choice([3, 8, 12, 16]), rng.choice([3, 8, 12, 16])
        a, b = random.Random(rng.randrange(6)), random.Random(100 + rng.randrange(6))
        docs[i] = " ".join(prose(rng, 20) + prose(a, 16)[-left:] + core + prose(b, 16)[:right] + prose(rng, 20))
    assert found(spark, docs) == brute(docs)


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert covered(QUERIES["op3_repeated_passages"](spark, SF).collect()) == brute(docs)
