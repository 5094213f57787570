"""Quality rules as a bitmask ledger, with DataFrame functions only.

``ledger`` reads every text once and stores, per document, the measurements
and one failure bit per rule. Policies are versioned sets of rule bits, so a
new policy, a comparison of two policies, or an ablation never reads a text
again: ``apply_policy`` is one bitwise ``and`` per row, and ``ablation`` groups
the ledger by its bits (at most 2^rules groups) before it looks at any rule.

Everything is one narrow projection over the documents: no shuffle, no Python.

Defined results for odd input: a null or empty text has no word, so it fails
``min_words`` and nothing else; null ids stay null; repeated rows give repeated
ledger rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.llm.common import words

#: name -> condition of failure, over the measurements. The order fixes the
#: bits: only append. Ratios are integer comparisons, so they are exact.
RULES: dict[str, str] = {
    "min_words": "n_words < 50",
    "repeat_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "dup_lines": "100 * n_dup_lines > 60 * n_lines",
    "shouting": "100 * n_upper > 50 * word_chars",
    "word_length": "word_chars > 20 * n_words OR word_chars < 2 * n_words",
}

#: version -> the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("min_words", "repeat_words"),
    "v1": ("min_words", "repeat_words", "symbols", "dup_lines", "shouting", "word_length"),
    "v2": ("min_words", "repeat_words", "symbols", "shouting"),
}

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def _chars(text: Column, kept: str) -> Column:
    """Code points of ``text`` that the class ``kept`` has."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


#: A hash for each 3-word window, from the hashes of its words.
_WINDOWS = """CASE WHEN size(_g) >= 3 THEN zip_with(
    zip_with(slice(_g, 1, size(_g) - 2), slice(_g, 2, size(_g) - 2), (a, b) -> xxhash64(a, b)),
    slice(_g, 3, size(_g) - 2), (ab, c) -> xxhash64(ab, c)) ELSE cast(array() AS array<bigint>) END"""

#: (hash, position) in order, for texts with two equal windows: those stand together.
_SORTED = """CASE WHEN size(array_distinct(_h)) < size(_h)
    THEN sort_array(transform(_h, (x, i) -> named_struct('x', x, 'i', i)))
    ELSE cast(array() AS array<struct<x: bigint, i: int>>) END"""

_POSITIONS = "sort_array(transform(filter(_s, (e, j) -> get(_s, j - 1).x <=> e.x OR get(_s, j + 1).x <=> e.x), e -> e.i))"

#: Each window adds what it reaches beyond the one before it, three words at most.
_COVERED = """cast(CASE WHEN size(_p) = 0 THEN 0 ELSE aggregate(zip_with(
    slice(_p, 2, size(_p) - 1), slice(_p, 1, size(_p) - 1), (b, a) -> least(b - a, 3)),
    3, (total, gap) -> total + gap) END AS bigint)"""


def _with_repeated_words(df: DataFrame, rest: list[str]) -> DataFrame:
    """``n_repeat_words`` from the words in ``_w``: how many words are covered
    by 3-word windows found twice or more, by 64-bit window hashes."""
    for name, step in (("_g", "transform(_w, w -> xxhash64(w))"), ("_h", _WINDOWS), ("_s", _SORTED),
                       ("_p", _POSITIONS), ("n_repeat_words", _COVERED)):
        df = df.select(*rest, F.expr(step).alias(name))
    return df


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           keep: list[str] | None = None) -> DataFrame:
    """One row per document: id, measurements, ``failed_bits``; ``keep`` names
    columns of ``docs`` to carry along (their names may not clash with these)."""
    carried = [F.col(id_col).alias(id_col), *[F.col(c) for c in keep or []]]
    names = [id_col, *(keep or [])]
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(*carried, text.alias("_text"), words(F.col(text_col)).alias("_w"),
                       F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "").alias("_lines"))
    n = F.size("_w")
    counted = base.select(
        *names, "_w",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _chars(F.col("_text"), "#*$%&|<>").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        _chars(F.col("_text"), r"\p{Lu}").alias("n_upper"))
    measured = _with_repeated_words(counted, [c for c in counted.columns if c != "_w"])
    # one-element generator: a filter on the ledger is not pushed below it, where
    # it would work every measurement out anew inside each lambda
    measured = measured.select(F.explode(F.array(F.struct("*"))).alias("m")).select("m.*")
    bits = reduce(lambda a, b: a.bitwiseOR(b), [
        F.when(F.expr(rule), F.lit(bit(name))).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()])
    return measured.select(*names, *MEASURES, bits.alias("failed_bits"))


def passes(policy: str, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def apply_policy(book: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``policy``, ``blocking_bits`` and ``kept``."""
    return book.withColumns({
        "policy": F.lit(policy), "blocking_bits": F.col("failed_bits").bitwiseAND(F.lit(mask(policy))),
        "kept": passes(policy)})


def blocks_alone(policy: str, bits: str = "failed_bits") -> Column:
    """Whether just one rule of a policy rejects the document: it would be kept
    without that rule."""
    return F.bit_count(F.col(bits).bitwiseAND(F.lit(mask(policy)))) == 1


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents failing it, failing it alone (they
    would come back without it), and kept with and without it. One row per
    rule, all zero over an empty ledger."""
    by_bits = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask(policy))).alias("b")).agg(F.count("*").alias("n"))
    sums = []
    for i, rule in enumerate(POLICIES[policy]):
        own = F.lit(bit(rule))
        sums.append(F.struct(
            F.lit(i).alias("position"), F.lit(rule).alias("rule"),
            F.coalesce(F.sum(F.when(F.col("b").bitwiseAND(own) != 0, F.col("n"))), F.lit(0)).alias("failing"),
            F.coalesce(F.sum(F.when(F.col("b") == own, F.col("n"))), F.lit(0)).alias("failing_alone"),
            F.coalesce(F.sum(F.when(F.col("b") == 0, F.col("n"))), F.lit(0)).alias("kept_with"),
            F.coalesce(F.sum(F.when(F.col("b").bitwiseAND(F.lit(mask(policy) & ~bit(rule))) == 0, F.col("n"))),
                       F.lit(0)).alias("kept_without")))
    return by_bits.agg(F.array(*sums).alias("rules")).selectExpr("inline(rules)")
