import re
from collections import Counter

import tiktoken
import public_tokenizers

import corpus_pipeline
from logscope.llm import mixing, pii
from logscope.llm.common import stored
from logscope.llm.queries import ORACLE, QUERIES, encoder
from tests.llm.test_mixing import check as check_mix
from tests.llm.test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stage_order_and_entry():
    import __spark_entry__
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash", "pii", "source_mix", "byte_bpe"]
    assert {"pipeline", *QUERIES} <= set(__spark_entry__.queries())
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql())


def test_every_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = {name: lambda *a, f=f: stored(f(*a), "test-stage") for name, f in corpus_pipeline.STAGES}
    rows = {r.doc_id: r for r in docs.collect()}

    kept = {r.doc_id for r in QUERIES["op2_quality_rules"](spark, SF).collect() if r.kept}
    good = stages["quality_rules"](spark, docs, SF)
    assert good.columns == columns and {tuple(r) for r in good.collect()} == {tuple(rows[i]) for i in kept}

    ids = sorted(kept)
    first = set(brute_components([(i, brute_fingerprint(rows[i].text)) for i in ids]))
    single = stages["simhash"](spark, good, SF)
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(first)

    clean = stages["pii"](spark, single, SF)
    assert clean.columns == columns
    model = pii.fit(single)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts == {i: pii.mask_text(rows[i].text, model) for i in first}
    assert all(not pii.base_spans(t) for t in texts.values())

    mixed = stages["source_mix"](spark, clean, SF)
    assert mixed.columns == columns
    times = Counter(r.doc_id for r in mixed.collect())
    plan = mixing.mix(clean).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    check_mix([(r.doc_id, r.size, r.source_size, r.target, times[r.doc_id] * size[r.doc_id]) for r in plan],
              {i: (rows[i].source, texts[i]) for i in first})

    tokens = stages["byte_bpe"](spark, mixed, SF).collect()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder().rank_of, special_tokens={})
    assert Counter(r.doc_id for r in tokens) == times
    assert all(r.ids == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in tokens)


def test_run_and_odd_rows(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and out.count() > 0
    odd = [(None, None, None, None, None, 5, "a"), (1, "", "en", "s", 0, 6, "b"), (2, "word " * 60, None, None, None, 7, "c"),
           (None, " ".join(f"w{i}" for i in range(80)), "en", "s", 1, 8, "d")] * 2
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, n_words int, key string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "test-stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "key"]
    assert [r.doc_id for r in docs.dropDuplicates().collect()] == [None]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, SF), "test-stage")
        assert empty.count() == 0
