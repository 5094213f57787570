import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logscope.llm import common
from logscope.llm import langid as L
from logscope.llm.queries import QUERIES


def letters(text):
    out = " "
    for c in (text or "").lower():
        c = c if c.isalpha() else " "
        if c != " " or out[-1] != " ":
            out += c
    out = out.strip(" ")
    return out + " " if out else ""


class Plain:
    """Interpolated Kneser-Ney with dictionaries, for one language."""

    def __init__(self, texts, symbols):
        full = Counter()
        for t in texts:
            s = "   " + letters(t)
            full.update(s[i - 3:i + 1] for i in range(3, len(s)) if letters(t))
        self.order = {4: full}
        for k in (3, 2, 1):
            self.order[k] = Counter(g[1:] for g in self.order[k + 1])
        self.symbols, self.total, self.types, self.d = symbols, {}, {}, {}
        for k, c in self.order.items():
            self.total[k], self.types[k] = Counter(), Counter()
            for g, n in c.items():
                self.total[k][g[:-1]] += n
                self.types[k][g[:-1]] += 1
            n1, n2 = (sum(v == n for v in c.values()) for n in (1, 2))
            self.d[k] = n1 / (n1 + 2 * n2) if n1 else 0.5

    def p(self, g):
        if not g:
            return 1 / self.symbols
        k, h = len(g), g[:-1]
        if h not in self.total[k]:
            return self.p(g[1:])
        return (max(self.order[k][g] - self.d[k], 0) + self.d[k] * self.types[k][h] * self.p(g[1:])) / self.total[k][h]

    def entropy(self, text):
        s = "   " + letters(text)
        return -sum(math.log(self.p(s[i - 3:i + 1])) for i in range(3, len(s))) / (len(s) - 3)


ROWS = {"xx": ["abra kadabra, bar", "Ra! Ba aab", "cab abc", "abra abra"], "yy": ["ooze moo", "zoom; ozone nome", "no one", "Moon é"]}


def trained(spark, rows, **more):
    df = spark.createDataFrame([(t, y) for y, ts in rows.items() for t in ts], "text string, lang string")
    by_order = L.orders(L.counts(df, "text", "lang"))
    langs = sorted(rows)
    model = L.Model(langs, by_order[0].select("gram").distinct().count() + 1)
    for o in by_order:
        seen, rest = L.kneser_ney(o)
        model.seen.append(L._lookup(seen, langs, 40, 0.0))
        model.rest.append(L._lookup(rest, langs, 40, 1.0))
    return model


def test_cross_entropy_equals_plain_kneser_ney(spark):
    model = trained(spark, ROWS)
    assert model.symbols == len(set("".join(letters(t) for ts in ROWS.values() for t in ts))) + 1
    plain = [Plain(ROWS[y], model.symbols) for y in sorted(ROWS)]
    texts = ["abra", "one abc", "zzz qq", "É", "moon  1 ra", *ROWS["xx"]]
    got, sizes = model.entropy(texts)
    assert sizes.tolist() == [len(letters(t)) for t in texts]
    np.testing.assert_allclose(got, [[p.entropy(t) for p in plain] for t in texts], rtol=1e-5)


def test_probabilities_of_a_context_add_up_to_one(spark):
    model = trained(spark, ROWS)
    symbols = sorted(set("".join(letters(t) for ts in ROWS.values() for t in ts)))
    for context in ("   ", "abr", "oze", "qqq", "  a"):
        grams = [sum(ord(c) << 16 * (3 - i) for i, c in enumerate(context + s)) for s in symbols]
        total = np.exp(model.logs(np.array(grams, np.uint64))).sum(axis=0)
        assert (total < 1 + 1e-6).all() and (total > 1 - 1.5 / model.symbols).all()  # the rest is for the unknown symbol


def test_hash_is_sparks(spark):
    v = [0, 1, -1, 2 ** 62, -2 ** 63, 123456789]
    want = [r["h"] & (2 ** 64 - 1) for r in spark.createDataFrame([(x,) for x in v], "v long").select(F.xxhash64("v").alias("h")).collect()]
    assert L.xxh64(np.array(v, np.int64).view(np.uint64)).tolist() == want


def test_size_bound_keeps_the_most_frequent_gram_of_a_place(spark):
    rows = [("xx", g, n, 0.5) for g, n in [(5, 9), (6, 1), (7, 3), (8, 2)]]
    df = spark.createDataFrame(rows, "lang string, gram long, n long, value double")
    one = L._lookup(df, ["xx"], 1, 0.0)
    place = lambda g: int(L.xxh64(np.array([g], np.uint64))[0]) >> 63
    best = {p: max((n, g) for _, g, n, _ in rows if place(g) == p)[1] for p in {place(g) for _, g, _, _ in rows}}
    assert [g for g in (5, 6, 7, 8) if one.of(np.array([g], np.uint64))[0, 0] > 0] == sorted(best.values())
    for langs in (1, 4, 100, 1000):
        assert (2 ** L.place_bits(langs, 256 << 20)) * 2 * L.ORDER * (8 + 4 * langs) <= 256 << 20


def test_shares_are_monotone():
    got = L.monotone(np.array([1, 0, 5, 3, 9]), np.array([2, 0, 6, 6, 9]))
    assert len(got) == 5 and (np.diff(got) >= 0).all() and 0 < got[0] <= got[-1] < 1


def invented(rng, lang):
    syllables = {"aa": ["an", "der", "ich", "sch"], "bb": ["ou", "eau", "ez", "que"], "cc": ["ko", "mi", "na", "ta"]}[lang]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 30)))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(i, invented(rng, y), y, 1) for i in range(900) for y in [rng.choice(["aa", "bb", "cc"])]]
    return rows, L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int"))


def test_held_out_accuracy_and_scores(spark, corpus):
    rng = random.Random(6)
    rows = [(i, invented(rng, y), y) for i in range(300) for y in [rng.choice(["aa", "bb", "cc"])]]
    out = L.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), corpus[1]).collect()
    right = [r["lang_pred"] == r["lang"] for r in out]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert sum(r["rejected"] for r in out) <= 0.05 * len(out)


def test_foreign_text_is_rejected(spark, corpus):
    df = spark.createDataFrame([("zxw vvvq jjj wxz " * 5,), ("привет мир " * 5,)], "text string")
    assert all(r["rejected"] and r["lang_pred"] in ("aa", "bb", "cc") for r in L.predict(df, corpus[1]).collect())


def test_odd_rows_and_other_columns(spark, corpus):
    rows = [(1, None, 1), (2, "", 1), (3, " 12 !?\n", 1), (4, "́", 1), (5, "anderich sch " * 20_000, 1), (5, "anderich sch " * 20_000, 1),
            (6, "İstanbul 𝒜𝒷 汉字", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    out = L.predict(df, corpus[1])
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "rejected", "cross_entropy"]
    got = defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append((r["lang_pred"], r["score"]))
    assert all(got[i] == [("und", 0.0)] for i in (1, 2, 3, 4))
    assert [x[0] for x in got[5]] == ["aa", "aa"] and got[6][0][0] in ("aa", "bb", "cc")
    assert L.predict(df.limit(0), corpus[1]).count() == 0


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([("a b", None), (None, "en")], "text string, lang string")
    for df in (empty, empty.limit(0)):
        model = L.fit(df)
        assert [tuple(r) for r in L.predict(empty, model).select("lang_pred", "score", "rejected").distinct().collect()] == [("und", 0.0, True)]


def test_query_on_the_table(spark):
    out = QUERIES["op11_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = out.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r["lang_pred"] == r["lang"] for r in rows if r["held_out"]]
    assert len(held) > 100 and sum(held) >= 0.98 * len(held)


def test_a_language_never_counted_twice_by_rows_of_any_order(spark):
    df = spark.createDataFrame([(t, y) for y, ts in ROWS.items() for t in ts * 3], "text string, lang string")
    want = Counter((y, g) for y, ts in ROWS.items() for t in ts * 3 for s in ["   " + letters(t)] for g in
                   [s[i - 3:i + 1] for i in range(3, len(s))])
    got = {(r["lang"], "".join(chr((r["gram"] >> 16 * k) & 0xFFFF) for k in (3, 2, 1, 0))): r["n"]
           for r in L.counts(df.repartition(3), "text", "lang").collect()}
    assert got == dict(want)


def test_grams_that_fit_are_all_kept_and_others_are_told(spark):
    grams = list(range(100, 164))
    df = spark.createDataFrame([("xx", g, g, 0.5) for g in grams], "lang string, gram long, n long, value double")
    every = np.array(grams, np.uint64)
    fits, small = L._lookup(df, ["xx"], 6, 0.0), L._lookup(df, ["xx"], 3, 0.0)
    assert (fits.of(every) > 0).all() and not fits.left_out(every).any()  # 64 grams share less than 64 places
    assert ((small.of(every)[:, 0] == 0) == small.left_out(every)).all() and small.left_out(every).sum() == 64 - len(small.keys) >= 56
    assert small.table.count() == 64


@pytest.mark.parametrize("heavy", [1, 1 << 40])
def test_grams_beyond_the_size_bound_come_from_the_tables(spark, corpus, monkeypatch, heavy):
    monkeypatch.setattr(common, "HEAVY", heavy)  # 1: rows join by shuffle
    whole = corpus[1]
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string, lang string, score int")
    small = L.fit(docs, max_bytes=16 * 2 * L.ORDER * (8 + 4 * 3))
    assert whole.whole and not small.whole and all(len(x.keys) <= 16 for x in small.seen + small.rest)
    np.testing.assert_allclose(small.usual, whole.usual, rtol=1e-6)
    np.testing.assert_allclose(small.right, whole.right)
    rng = random.Random(7)
    rows = [(i, invented(rng, y), y) for i in range(100) for y in ["aa", "bb", "cc"]]
    rows += [(None, "anderich zxw", "aa")] * 50 + [(1, None, "aa"), (2, "", None), (3, " 12 !?", "bb"), (4, "𝒜𝒷 汉字", "cc"), (5, "koou " * 9000, "cc")]
    odd = spark.createDataFrame(rows, "`a.id` long, text string, lang string")
    key = lambda r: (str(r["a.id"]), str(r["text"]), str(r["lang"]))
    want, got = (sorted(L.predict(odd, m).collect(), key=key) for m in (whole, small))
    assert len(want) == len(got) == len(rows)
    for w, g in zip(want, got):
        assert (key(w), w["lang_pred"], w["score"], w["rejected"]) == (key(g), g["lang_pred"], g["score"], g["rejected"])
        known = w["cross_entropy"] is not None
        assert g["cross_entropy"] == (pytest.approx(w["cross_entropy"], rel=1e-6) if known else None)
    assert L.predict(odd.limit(0), small).count() == 0
