import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from logscope.llm import bpe
from logscope.llm.queries import QUERIES, encoder

SF = "/root/testdata/sf0.001"
ENCODER = encoder()
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENCODER.rank_of, special_tokens={})


def test_perfect_hash_is_minimal_and_exact():
    assert sorted(ENCODER.hash.order) == list(range(len(ENCODER.keys)))
    assert all(ENCODER.rank(k) == r for k, r in ENCODER.rank_of.items())
    assert ENCODER.rank(b"not a token of this set") is None


@pytest.mark.parametrize("n", [1, 2, 3, 50])
def test_small_perfect_hashes(n):
    keys = [f"k{i}".encode() for i in range(n)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(n))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_library(text):
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)
    assert ENCODER.decode(ENCODER.encode(text)) == text.encode()


def test_every_block_of_unicode():
    chars = [c for c in range(0x20, 0x110000, 7) if not 0xD800 <= c < 0xE000] + list(range(0x27, 0xD800, 64))
    text = "".join(f"{chr(c)}a 1{chr(c)}\n " for c in chars)
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)


@pytest.mark.parametrize("text", ["x" * 30000, "ab " * 70000, "<|endoftext|>", "\n\n  \t", "é" * 5000, "'S 'll"])
def test_long_and_odd_texts(text):
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)


def test_recent_table_is_bounded():
    small = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    small.recent.kept = 4
    text = " ".join(f"word{i} wrod{i % 3}" for i in range(50))
    assert small.encode(text) == REFERENCE.encode_ordinary(text)
    assert len(small.recent) <= 4


def test_vocabulary_size_is_checked():
    with pytest.raises(ValueError):
        bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, max_bytes=1000)


def expected(text):
    ids = REFERENCE.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def test_query_equals_the_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op9_byte_bpe"](spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: expected(t) for i, t in docs.items()}
    assert len(got) == len(docs)


def test_round_trip_odd_rows_and_empty_table(spark):
    rows = [(None, None, "x"), (1, "", "y"), (1, "", "y"), (2, "naïve 中文 text", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").drop("ids")
    out = bpe.decoded(bpe.encoded(df, ENCODER), ENCODER).collect()
    assert [(r.doc_id, bytes(r.decoded).decode()) for r in out] == [(i, t or "") for i, t, _ in rows]
    assert bpe.encoded(df.limit(0), ENCODER).count() == 0
