"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.llm import bpe, kdtree, langid, linecrf, mixing, negatives, pii, rules, runs, sharding, simhash, suffixes, urls
from logscope.llm.common import table, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linecrf.score(docs, linecrf.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


_BITS_SQL = " + ".join(f"CASE WHEN {rule} THEN {rules.bit(name)} ELSE 0 END" for name, rule in rules.RULES.items())

OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t,
             list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
i AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM i),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
             length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, CAST({_BITS_SQL} AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & {rules.mask('base')}) <> 0 AS base_failed, (failed_bits & {rules.mask('v1')}) = 0 AS kept, failed_bits,
       failed_bits & {rules.mask('v1')} AS blocking_bits, bit_count(failed_bits & {rules.mask('v1')}) = 1 AS blocks_alone,
       (failed_bits & {rules.mask('v2')}) = 0 AS kept_v2
FROM b"""


@register("op2_quality_rules", OP2_SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")), "v1")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~rules.passes("base")).alias("base_failed"), "kept", "failed_bits", "blocking_bits",
                       rules.blocks_alone("v1").alias("blocks_alone"), rules.passes("v2").alias("kept_v2"))


@register("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def encoder(path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> bpe.Encoder:
    return bpe.load(path or public_tokenizers.path(TOKENIZER), pattern)


@register("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = bpe.digest(spark, encoder(), F.col("text"))
    return docs.select("doc_id", digest.alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


@register("op7_mix_sources")
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, epochs=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@register("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.report(docs, pii.fit(docs))


@register("op8_shards")
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = sharding.shards(table(spark, sf_dir, "documents"), n_shards=24)
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]

_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

OP4_SQL = rf"""
WITH k(verdict, host, path) AS (VALUES {_RULES_SQL}),
u AS (SELECT row_number() OVER () AS rid, page_id, strpos(coalesce(url, ''), '://') AS sep, coalesce(url, '') AS url FROM pages),
s AS (SELECT rid, page_id, CASE WHEN sep > 0 THEN substr(url, sep + 3) ELSE '' END AS s FROM u),
p AS (SELECT rid, page_id, translate(regexp_extract(s, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(s, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
f AS (SELECT p.*, k.verdict, k.host || k.path AS rule,
             row_number() OVER (PARTITION BY rid ORDER BY length(k.host || k.path) DESC, length(k.host) DESC, k.verdict DESC) AS n
      FROM p LEFT JOIN k ON (p.host = k.host OR ends_with(p.host, '.' || k.host)) AND starts_with(p.path, k.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1"""


@register("op4_url_filter", OP4_SQL)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules_table = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urls.judge(pages, urls.build(pages, rules_table))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@register("op6_exact_top_k", OP6_SQL)
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return kdtree.top_k(kdtree.index(vectors), vectors.where(F.col("vec_id") % 50 == 0), k=5)


@register("op3_repeated_passages")
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """Contract of op12: in documents whose hash of the id is divisible by ten, all
    words from one on repeat the block that starts there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, w = F.floor(h / 10), F.col("_w")
    n = F.size(w)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    repeated = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))))
    listed = docs.select("doc_id", "text", F.when(h % 10 == 0, words(F.col("text"))).alias("_w"))
    return listed.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))


@register("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(_with_planted_runs(table(spark, sf_dir, "documents")), min_words=12)
    # longest, then first, then shortest: array_max over (length, -start, -period)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    return found.select("doc_id", "runs", "collapsed", best.alias("b")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.s")).alias("start"), F.col("b.n").alias("length"),
        (-F.col("b.p")).alias("period"), F.floor(1000 * F.col("b.n") / -F.col("b.p")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
             row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same),
r AS (SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
      WHERE n <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10"""


@register("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


@register("op11_language_id")
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = langid.fit(docs.where(~held_out).select("text", "lang"))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
