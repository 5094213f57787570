import itertools
import zlib

import numpy as np

from logscope.llm import linecrf
from logscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    sizes = [3, 0, 1, 5, 2]
    starts = np.cumsum([0, *sizes])
    e, trans = rng.normal(size=(starts[-1], 2)), rng.normal(size=(2, 2))
    p, pairs, _ = linecrf.forward_backward(e, trans, starts)
    want_pairs = np.zeros((2, 2))
    for a, b in zip(starts[:-1], starts[1:]):
        total, own, joint = 0.0, np.zeros((b - a, 2)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(e[a + t, v] for t, v in enumerate(y)) + sum(trans[u, v] for u, v in zip(y, y[1:])))
            total += w
            for t, v in enumerate(y):
                own[t, v] += w
            for u, v in zip(y, y[1:]):
                joint[u, v] += w
        if b > a:
            assert np.allclose(p[a:b], own / total)
            want_pairs += joint / total
    assert np.allclose(pairs, want_pairs)


def test_neighbours_stay_in_their_document():
    own = np.arange(4 * linecrf.N_OWN, dtype=float).reshape(4, -1) + 1
    x = linecrf.with_neighbours(own, np.array([0, 1, 1, 4]))
    n = linecrf.N_OWN
    assert (x[0, n:3 * n] == 0).all() and (x[1, n:2 * n] == 0).all() and (x[3, 2 * n:3 * n] == 0).all()
    assert (x[1, 2 * n:3 * n] == own[2]).all() and (x[3, n:2 * n] == own[2]).all()
    assert x[:, -3].tolist() == [1, 1, 0, 0] and x[:, -2].tolist() == [1, 0, 0, 1]


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op1_quality_classifier"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.98
    assert np.mean([a == 0 for a, b in held if b == 0]) > 0.93 and np.mean([a == 1 for a, b in held if b == 1]) > 0.98


def test_labels_of_held_out_rows_are_never_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", linecrf.F.when(linecrf.held_out(), 1 - labels.quality).otherwise(labels.quality))
    one, two = linecrf.fit(docs, labels), linecrf.fit(docs, flipped)
    assert np.array_equal(one.weights, two.weights) and (one.slope, one.shift, one.prior) == (two.slope, two.shift, two.prior)


def test_odd_rows_and_tables(spark):
    rows = [(None, None, "x", 1.0), (1, "", "y", 1.0), (1, "", "y", 1.0), (2, "word " * 100000, "z", 2.0), (3, "a b c.\n" * 50000, "q", 1.0),
            (4, "Good line here. Another one\nand more of it.", "g", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, y double")
    labels = spark.createDataFrame([(3, 0), (4, 1), (4, None), (None, 1), (2, 7), (77, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        out = linecrf.score(df, linecrf.fit(df, known)).collect()
        assert [r.doc_id for r in out] == [r[0] for r in rows]
        assert all(0 <= r.score <= 1 for r in out) and out[0].score == out[1].score
    assert linecrf.score(df.limit(0), linecrf.fit(df, labels)).count() == 0


def test_copies_of_a_labelled_id_count_once_and_long_documents_are_learned_from(spark):
    rng = np.random.default_rng(2)
    text = lambda good: "\n".join(("Plain words follow here, quite calmly." if good else "### $$$ BUY %% NOW ###") + f" {rng.integers(99)}" for _ in range(6))
    rows = [(i, text(i % 2)) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    plain = linecrf.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    many = linecrf.fit(spark.createDataFrame(rows + [rows[1]] * 2000, "doc_id long, text string").repartition(6), labels)
    assert np.array_equal(plain.weights, many.weights) and plain.shift == many.shift
    odd = [i for i in range(200) if i % 2 == 0 and zlib.crc32(str(i).encode()) % 5]
    long = [(i, "a b\n" * 6000 if i == odd[0] else t) for i, t in rows]  # longer than any bound on one document
    assert not np.array_equal(plain.weights, linecrf.fit(spark.createDataFrame(long, "doc_id long, text string"), labels).weights)
    few = linecrf.fit(spark.createDataFrame(long, "doc_id long, text string"), labels, max_lines=600)
    assert 0 < few.prior < 1 and np.isfinite(few.weights).all()


def test_session_stays_as_it_was(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    QUERIES["op1_quality_classifier"](spark, "/root/testdata/sf0.001").count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
