import re
from collections import Counter

import duckdb
import pytest

from logscope.llm import rules
from logscope.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t ", "a", "a a a", "a a a a", "a b c a b c", "x\nx\n \nx \nx", "é€😀 #*$ <b>|&%", "a b c d " * 5000,
         " ".join(str(i % 977) for i in range(40000)), "w" * 200000, "\x0b\x0c\r", "p q r s p q r s", "ONE TWO! " * 60]


def test_measures_equal_brute_force(spark):
    rows = [(i if i % 4 else None, t, "x", 1) for i, t in enumerate(TEXTS)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, p int")
    got = sorted((tuple(r)[1:] for r in rules.ledger(df).select("doc_id", *rules.MEASURES[:5]).collect()))
    assert got == sorted(brute(t) for _, t, _, _ in rows)


def test_bits_and_policies(spark):
    df = spark.createDataFrame([(1, "few words"), (2, "of " * 60), (3, " ".join(f"w{i}x" for i in range(60))), (4, None)], "doc_id long, text string")
    book = {r.doc_id: r for r in rules.apply_policy(rules.ledger(df), "v1").collect()}
    assert book[1].failed_bits == book[4].failed_bits == rules.bit("min_words")
    assert book[2].failed_bits & rules.bit("repeat_words")
    assert book[3].failed_bits == 0 and [i for i in book if book[i].kept] == [3]
    assert rules.mask("base") == 3 and rules.mask("v1") & 3 == 3


@pytest.mark.parametrize("policy", sorted(rules.POLICIES))
def test_ablation_equals_recount(spark, policy):
    book = rules.ledger(spark.read.parquet(f"{SF}/documents.parquet"))
    bits = [r.failed_bits & rules.mask(policy) for r in book.collect()]
    for r in rules.ablation(book, policy).collect():
        own = rules.bit(r.rule)
        assert (r.failing, r.failing_alone) == (sum(b & own != 0 for b in bits), bits.count(own))
        assert (r.kept_with, r.kept_without) == (bits.count(0), sum(b & ~own == 0 for b in bits))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rules.ledger(df).count() == 0
    assert {r.failing for r in rules.ablation(rules.ledger(df), "v1").collect()} == {0}


def test_plan_has_no_shuffle_and_no_python(spark):
    plan = QUERIES["op2_quality_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want))


def test_policies_agree_with_their_ablation(spark):
    book = rules.ledger(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for policy in rules.POLICIES:
        alone = book.where(rules.blocks_alone(policy)).count()
        table = rules.ablation(book, policy).collect()
        assert sum(r["failing_alone"] for r in table) == alone
        assert all(r["kept_without"] - r["kept_with"] == r["failing_alone"] for r in table)
    assert book.where(rules.passes("v1") & ~rules.passes("v2")).count() == 0  # v2 only leaves rules out
