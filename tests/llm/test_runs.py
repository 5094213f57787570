import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logscope.llm import runs as R
from logscope.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=12):
    """Runs by trying every period."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q) and not any(
                    all(w[i + t] == w[i + t + d] for t in range(length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def drop(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return [x for k, x in enumerate(w) if k not in gone]


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def check(w, least=12):
    got = [tuple(r) for r in R.runs(w, least).tolist()]
    want = brute(w, least)
    assert sorted(got, key=lambda r: (r[0], r[2])) == want
    assert R.collapsed([str(x).encode() for x in w], R.runs(w, least)) == b" ".join(str(x).encode() for x in drop(w, want))
    return want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 14))
def test_random_words_of_a_small_alphabet(w, least):
    check(w, least)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=12), st.integers(1, 9), st.integers(0, 8), st.lists(st.integers(0, 3), max_size=20))
def test_repeated_blocks_between_other_words(block, times, rest, around):
    check(around + block * times + block[:rest] + around)


def test_nested_and_overlapping_runs():
    inner = ["a", "b"] * 7 + ["c"]
    found = check(inner * 3 + ["z"] * 20 + ["a", "b"] * 6)
    assert any(q == 15 for _, _, q in found) and any(q == 2 for _, _, q in found) and any(q == 1 for _, _, q in found)
    check(list("abaababaabaababaababaabaababaabaab") * 2)  # Fibonacci words hold many overlapping runs


def test_a_long_text_of_one_word_and_of_a_long_block():
    assert R.runs(["x"] * 50_000).tolist() == [[0, 50_000, 1]]
    rng = random.Random(1)
    block = [rng.randrange(50) for _ in range(9_000)]
    found = R.runs([7] * 3 + block * 4 + block[:10])
    assert [4 * 9_000 + 10, 9_000] in found[:, 1:].tolist() or [4 * 9_000 + 13, 9_000] in found[:, 1:].tolist()


def test_common_prefix_and_suffix_equal_plain_comparison():
    rng = random.Random(3)
    w = np.array([rng.randrange(2) for _ in range(70)])
    ranks = R.ranks_by_doubling(w)
    i, j = np.triu_indices(70, 1)
    for a, b, p, s in zip(i, j, R.common_prefix(ranks, i, j), R.common_suffix(ranks, i, j)):
        n = 0
        while b + n < 70 and w[a + n] == w[b + n]:
            n += 1
        m = 0
        while a - m - 1 >= 0 and w[a - m - 1] == w[b - m - 1]:
            m += 1
        assert (p, s) == (n, m)
    starts = sorted(range(70), key=lambda k: w[k:].tolist())
    assert np.argsort(ranks[-1]).tolist() == starts


def test_odd_rows_and_other_columns(spark):
    rows = [(1, None, 5, "u"), (2, "", 5, "u"), (None, " \t\n", 5, "u"), (3, "a b " * 12, 5, "u"), (3, "a b " * 12, 5, "u"),
            (4, "é\x0b" * 11, 5, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, `w.x` string")
    out = R.find(df)
    assert out.columns == ["doc_id", "text", "w.x", "runs", "collapsed"]
    got = {(r["doc_id"], r["text"]): ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()}
    assert out.count() == 6
    assert got[(3, "a b " * 12)] == ([(0, 12, 1)], "a b")
    assert got[(4, "é\x0b" * 11)] == ([], " ".join("é" * 11))
    assert got[(1, None)] == got[(2, "")] == ([], "")
    assert R.find(df.limit(0)).count() == 0


def digests(doc_id, text):
    w = planted(doc_id, WORD.findall(text or ""))
    found = brute(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    s, n, q = best or (None, None, None)
    return (doc_id, len(found), s, n, q, 1000 * n // q if best else None,
            sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(drop(w, found))))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        w = [rng.choice(["the", "of", "é", "x1", "Zu", "a,"]) for _ in range(rng.choice([0, 3, 11, 12, 30, 80]))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w * rng.choice([1, 1, 3])), "en", None, 0))
    rows += [(None, "q " * 40, None, None, None), (7, None, None, None, None), (8, "", None, None, None), rows[0]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    out = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert out.columns[:8] == cols
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[c] for c in cols) for r in out.collect()), key=key) == sorted((digests(r[0], r[1]) for r in rows), key=key)


@pytest.mark.parametrize("setting", ["spark.sql.execution.arrow.maxRecordsPerBatch"])
def test_query_leaves_the_session_as_it_was(spark, setting):
    before = spark.conf.get(setting)
    QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").count()
    assert spark.conf.get(setting) == before
