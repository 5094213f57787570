"""Language identification by character language models.

One interpolated Kneser-Ney model of order ``ORDER`` (4) per language, over lower-case
letters and marks, with every stretch of other characters as one space. A text is
of the language whose model gives it the lowest cross-entropy a character.

Counting covers all labelled documents: Python turns slices of texts into
distinct (language, gram) counts, Spark adds them up, and everything after that
(continuation counts, context totals, discounts, interpolation weights) is
DataFrame aggregates over the table of distinct grams. A gram is four 16-bit
characters in one long; letters beyond that are folded into the private-use range,
which holds no letters.

For scoring, each order's discounted probabilities and each context's
interpolation weights are arrays sorted by the gram's 64-bit hash (XXH64), one
column a language. Their size has a fixed bound, whatever the corpus: ``2 ** bits``
grams, where ``bits`` follows from ``max_bytes`` and the number of languages. The
arrays are what the driver gathers and every task gets. Up to that bound they hold all
grams. Beyond it the upper bits of the hash choose one of ``2 ** bits`` places, the
arrays hold the most frequent gram of each, and the whole tables stay Parquet: of a
text, a task adds up what the arrays settle; its other grams whose place has left grams
out are joined to the tables, so no gram is lost at any size.

Calibration uses the labelled documents whose text hash is 0 modulo ``CALIBRATE``;
those are not counted. Documents are grouped by how many nats the best language is
ahead of the next; the share that is right in each group, made monotone, is the
``score``. A text is ``rejected`` if its cross-entropy is too far above what
its language's documents have, in units of their spread for its length; the limit
leaves out the share ``reject`` of the calibration documents.

Defined results for odd input: a null text, or one without a letter, is ``und`` with
score 0, as is every text if no language was learned; rows with a null text or
language are not learned from; languages that tie are taken in code point order;
repeated rows count as often as they occur; very long texts are one slice of their
own, read whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.llm.common import slices, spread_join, stored
from logscope.session import ship_package

ORDER = 4
CALIBRATE = 8
SPACE = 32
UNKNOWN = "und"
BINS = 48


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the 16-bit character (a space for others), whether it is a letter."""
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    point = np.arange(0x110000)
    point = np.where(point < 0x10000, point, 0xE000 + point % 0x1900)
    return np.where((kinds == "L") | (kinds == "M"), point, SPACE).astype(np.uint16), kinds == "L"


def normal(text: str | None) -> np.ndarray:
    """The characters that models see; empty without a letter."""
    table, letter = _characters()
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not letter[points].any():
        return np.zeros(0, np.uint16)
    c = np.append(table[points], np.uint16(SPACE))
    keep = c != SPACE
    keep[1:] |= keep[:-1].copy()
    return c[keep]


def grams(texts) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts: the gram that ends at each character, and characters a text."""
    parts = [normal(t) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    pad = np.full(ORDER - 1, SPACE, np.uint16)
    flat = np.concatenate([x for p in parts for x in (pad, p)] or [pad]).astype(np.uint64)
    out = flat.copy()
    for k in range(1, ORDER):
        out[k:] |= flat[:-k] << np.uint64(16 * k)
    inside = np.ones(len(flat), bool)
    starts = np.cumsum(np.append(0, sizes + ORDER - 1))[:-1]
    for k in range(ORDER - 1):
        inside[starts + k] = False
    return (out[inside] if len(parts) else out[:0]), sizes


def xxh64(values: np.ndarray) -> np.ndarray:
    """XXH64 (seed 42) of 8-byte integers, as ``F.xxhash64`` of a long."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (  # fixed values: primes of XXH64
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = (np.uint64(42) + p5 + np.uint64(8)) ^ (turn(values.astype(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def _tail(gram: np.ndarray, k: int) -> np.ndarray:
    return gram & np.uint64((1 << 16 * k) - 1)


@dataclass
class Lookup:
    """Values of languages by gram, in an array sorted by the gram's hash: of all grams, or
    of one a place, where ``crowded`` tells which places have others in ``table``."""

    keys: np.ndarray
    values: np.ndarray
    missing: float
    table: DataFrame | None = None  # (gram, v) of all grams; not sent to tasks
    bits: int = 0
    crowded: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "table": None}

    def left_out(self, gram: np.ndarray) -> np.ndarray:
        """Whether a gram is not here but may be in the table."""
        if self.crowded is None:
            return np.zeros(len(gram), bool)
        h, shift = xxh64(gram), np.uint64(64 - self.bits)
        places = self.keys >> shift
        at = np.minimum(np.searchsorted(places, h >> shift), len(places) - 1)
        return self.crowded[at] & (places[at] == h >> shift) & (self.keys[at] != h)

    def of(self, gram: np.ndarray) -> np.ndarray:
        out = np.full((len(gram), self.values.shape[1]), self.missing)
        if len(self.keys):
            h = xxh64(gram)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            out[hit] = self.values[at[hit]]
        return out


@dataclass
class Model:
    langs: list[str]
    symbols: int
    seen: list[Lookup] = field(default_factory=list)  # by order: discounted probability of a gram
    rest: list[Lookup] = field(default_factory=list)  # by order: weight of the lower order, by context
    right: np.ndarray = field(default_factory=lambda: np.zeros(BINS))
    usual: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))  # mean, spread, limit by language

    def logs(self, gram: np.ndarray) -> np.ndarray:
        """Natural log of the probability of grams' last characters, by language."""
        p = np.full((len(gram), len(self.langs)), 1.0 / self.symbols)
        for k in range(1, ORDER + 1):
            tail = _tail(gram, k)
            p = self.seen[k - 1].of(tail) + self.rest[k - 1].of(tail >> np.uint64(16)) * p
        return np.log(p)

    @property
    def whole(self) -> bool:
        """Whether the arrays hold all grams."""
        return all(look.crowded is None for look in self.seen + self.rest)

    def left_out(self, gram: np.ndarray) -> np.ndarray:
        """Whether a probability that the gram needs may be in the tables only."""
        out = np.zeros(len(gram), bool)
        for k in range(1, ORDER + 1):
            tail = _tail(gram, k)
            out |= self.seen[k - 1].left_out(tail) | self.rest[k - 1].left_out(tail >> np.uint64(16))
        return out

    def sums(self, logs: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rows of ``logs`` added up a text; ``codes`` are the rows, text by text."""
        out = np.zeros((len(sizes), len(self.langs)))
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.cumsum(np.append(0, sizes[full]))[:-1]
            for k in range(len(self.langs)):
                out[full, k] = np.add.reduceat(logs[codes, k], starts)
        return out

    def entropy(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character (texts by languages), characters a text."""
        gram, sizes = grams(texts)
        codes, distinct = pd.factorize(gram)
        return -self.sums(self.logs(distinct), codes, sizes) / np.maximum(sizes, 1)[:, None], sizes

    def parts(self, texts) -> tuple[np.ndarray, ...]:
        """Per text: log probability by language of the grams that the arrays settle, and
        characters. Then text number, gram and how often it occurs, of the other grams."""
        gram, sizes = grams(texts)
        codes, distinct = pd.factorize(gram)
        left = self.left_out(distinct)
        logs = self.sums(np.where(left[:, None], 0.0, self.logs(distinct)), codes, sizes)
        other = left[codes]
        pairs, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[other] * len(distinct) + codes[other], return_counts=True)
        text, code = np.divmod(pairs, max(len(distinct), 1))
        return logs, sizes, text, distinct[code].view(np.int64), times

    def best(self, texts) -> pd.DataFrame:
        """Per text: language number (-1: none), its cross-entropy, characters, nats ahead."""
        if not self.langs:
            return pd.DataFrame({"lang": [-1] * len(texts), "entropy": 0.0, "chars": 0, "ahead": 0.0})
        return self.ranked(*self.entropy(texts))

    def ranked(self, entropy: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
        first = entropy.argmin(axis=1)
        low = entropy.min(axis=1)
        entropy[np.arange(len(first)), first] = np.inf
        ahead = (entropy.min(axis=1) - low) * sizes if len(self.langs) > 1 else sizes.astype(float)
        return pd.DataFrame({"lang": np.where(sizes > 0, first, -1), "entropy": low, "chars": sizes,
                             "ahead": np.where(sizes > 0, ahead, 0.0)})

    def batch(self, texts: pd.Series) -> pd.DataFrame:
        parts = [self.best(texts.iloc[a:b]) for a, b in slices(texts)] or [self.best([])]
        return pd.concat(parts, ignore_index=True)

    def bin(self, ahead: np.ndarray) -> np.ndarray:
        return np.clip(2 * np.log2(1 + ahead), 0, BINS - 1).astype(int)

    def binned(self, best: pd.DataFrame) -> pd.DataFrame:
        best["bin"] = self.bin(best["ahead"].to_numpy())
        return best[["lang", "entropy", "chars", "bin"]]

    def named(self, best: pd.DataFrame) -> pd.DataFrame:
        lang, chars = best["lang"].to_numpy(int), best["chars"].to_numpy()
        known = lang >= 0
        names = np.array([*self.langs, UNKNOWN], dtype=object)[lang]
        score = np.where(known, self.right[self.bin(best["ahead"].to_numpy())], 0.0)
        far = np.zeros(len(best))
        limit = np.zeros(len(best))
        if self.langs:
            usual = self.usual[np.where(known, lang, 0)]
            with np.errstate(invalid="ignore"):
                far = (best["entropy"].to_numpy() - usual[:, 0]) * np.sqrt(chars)
            limit = usual[:, 2]
        return pd.DataFrame({"lang_pred": names, "score": score, "rejected": ~known | (far > limit),
                             "cross_entropy": np.where(known, best["entropy"], np.nan)})


def counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over all documents with a language, stored."""
    ship_package(docs.sparkSession)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, which = np.unique(batch["lang"].to_numpy(dtype=object).astype(str), return_inverse=True)
            for a, b in slices(batch["text"]):
                gram, sizes = grams(batch["text"].iloc[a:b])
                codes, distinct = pd.factorize(gram)
                pair = codes * len(names) + np.repeat(which[a:b], sizes)
                n = np.bincount(pair, minlength=1)
                at = np.flatnonzero(n)
                if len(gram):
                    yield pd.DataFrame({"lang": names[at % len(names)].astype(object), "gram": distinct[at // len(names)].view(np.int64),
                                        "n": n[at]})

    part = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).mapInPandas(
        of, "lang string, gram long, n long")
    return stored(part.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang-grams")


def orders(grams: DataFrame) -> list[DataFrame]:
    """(lang, gram, n) of orders 1 to ``ORDER``: counts at the top, else by how many
    different characters a gram follows."""
    out = [grams]
    for k in range(ORDER - 1, 0, -1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))
        out.append(stored(out[-1].groupBy("lang", tail.alias("gram")).agg(F.count("*").alias("n")), f"lang-grams-{k}"))
    return out[::-1]


def kneser_ney(order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, n, value): discounted probabilities by gram, and the weight that
    is left for the lower order by context. The discount of a language is
    n1 / (n1 + 2 n2), or a half where no gram occurs once."""
    discounts = order.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).select(
        "lang", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5).alias("d"))
    contexts = order.groupBy("lang", F.shiftrightunsigned("gram", 16).alias("context")).agg(
        F.sum("n").alias("total"), F.count("*").alias("types")).join(discounts, "lang")
    seen = order.withColumn("context", F.shiftrightunsigned("gram", 16)).join(contexts, ["lang", "context"]).select(
        "lang", "gram", "n", ((F.col("n") - F.col("d")) / F.col("total")).alias("value"))
    rest = contexts.select("lang", F.col("context").alias("gram"), F.col("total").alias("n"),
                           (F.col("d") * F.col("types") / F.col("total")).alias("value"))
    return seen, rest


def _lookup(values: DataFrame, langs: list[str], bits: int, missing: float) -> Lookup:
    """At most ``2 ** bits`` rows come to the driver: all grams, or the most frequent of
    each place. All grams stay in the lookup's table."""
    by = F.map_from_entries(F.collect_list(F.struct("lang", "value")))  # one entry a language
    table = stored(values.groupBy("gram").agg(F.sum("n").alias("n"), by.alias("by")).select(
        "gram", "n", F.array(*[F.coalesce(F.try_element_at("by", F.lit(x)), F.lit(missing)).cast("float") for x in langs]).alias("v")),
        "lang-values")
    rows = table.select(F.xxhash64("gram").alias("hash"), "n", "v")
    whole = table.count() <= 1 << bits
    if not whole:
        place = F.shiftrightunsigned("hash", 64 - bits).alias("place")
        rows = rows.groupBy(place).agg(F.max_by(F.struct("hash", "v"), F.struct("n", "hash")).alias("row"),
                                       (F.count("*") > 1).alias("crowded")).select("row.hash", "row.v", "crowded")
    kept = rows.drop("n").toPandas()
    keys = kept["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    of = np.array(kept["v"].tolist(), np.float32).reshape(len(keys), len(langs))
    return Lookup(keys[order], of[order], missing, table.select("gram", "v"), bits, None if whole else kept["crowded"].to_numpy(bool)[order])


def place_bits(langs: int, max_bytes: int) -> int:
    """So that 2 * ORDER arrays of hash and languages fit in ``max_bytes``."""
    return max(1, min(40, (max_bytes // (2 * ORDER * (8 + 4 * max(langs, 1)))).bit_length() - 1))


def monotone(right: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Shares that never fall, by pooling neighbours that do; a group without
    documents has the share of the group below it."""
    pools: list[list[float]] = []
    for r, t in zip(right, total):
        pools.append([r, t, 1])
        while len(pools) > 1 and (pools[-1][1] == 0 or pools[-2][0] * pools[-1][1] > pools[-1][0] * pools[-2][1]):
            r2, t2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + r2, pools[-1][1] + t2, pools[-1][2] + n2]
    return np.concatenate([np.full(n, (r + 1) / (t + 2)) for r, t, n in pools])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_bytes: int = 256 << 20, max_langs: int = 1000,
        reject: float = 0.005) -> Model:
    """Models of all languages in ``lang_col``, from all rows of ``docs``."""
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    apart = F.pmod(F.xxhash64(F.col(text_col)), F.lit(CALIBRATE)) == 0
    by_order = orders(counts(known.where(~apart), text_col, lang_col))
    langs = sorted(r["lang"] for r in by_order[0].select("lang").distinct().limit(max_langs + 1).collect())
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages: not a column of languages")
    symbols = by_order[0].select("gram").distinct().count() + 1  # one for what was never seen
    bits = place_bits(len(langs), max_bytes)
    model = Model(langs, symbols)
    for order in by_order if langs else []:
        seen, rest = kneser_ney(order)
        model.seen.append(_lookup(seen, langs, bits, 0.0))
        model.rest.append(_lookup(rest, langs, bits, 1.0))
    return calibrated(model, known.where(apart), text_col, lang_col, reject)


def calibrated(model: Model, docs: DataFrame, text_col: str, lang_col: str, reject: float) -> Model:
    if not model.langs:
        return model
    code = F.array_position(F.array(*[F.lit(x) for x in model.langs]), F.col(lang_col).cast("string")) - 1
    known = docs.select(code.cast("int").alias("truth"), F.col(text_col).alias("text"))
    found = stored(_with_best(known, model, "text", Model.binned, "lang int, entropy double, chars long, bin int").select(
        "truth", "_found.*").where(F.col("lang") >= 0), "lang-calibration")
    groups = found.groupBy("bin").agg(F.count_if(F.col("lang") == F.col("truth")).alias("right"), F.count("*").alias("n")).collect()
    right, total = np.zeros(BINS), np.zeros(BINS)
    for r in groups:  # at most BINS
        right[r["bin"]], total[r["bin"]] = r["right"], r["n"]
    model.right = monotone(right, total)
    mean = found.groupBy("truth").agg((F.sum(F.col("entropy") * F.col("chars")) / F.sum("chars")).alias("mean"))
    far = found.join(mean, "truth").withColumn("far", (F.col("entropy") - F.col("mean")) * F.sqrt("chars"))
    usual = far.groupBy("truth").agg(F.first("mean").alias("mean"), F.sqrt(F.avg(F.col("far") * F.col("far"))).alias("spread"),
                                     F.percentile_approx("far", 1 - reject, 10_000).alias("limit")).collect()
    model.usual = np.full((len(model.langs), 3), np.inf)
    for r in usual:  # one a language
        if r["truth"] is not None and r["truth"] >= 0:
            model.usual[r["truth"]] = r["mean"], r["spread"], r["limit"]
    return model


def _with_best(docs: DataFrame, model: Model, text_col: str, finish: Callable[[Model, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``docs`` with the struct ``_found``: what ``finish`` makes of each text's best language."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(schema)
    def of(texts: pd.Series) -> pd.DataFrame:
        return finish(shared.value, shared.value.batch(texts))

    @F.pandas_udf(schema)
    def of_sums(logs: pd.Series, chars: pd.Series) -> pd.DataFrame:
        m, sizes = shared.value, chars.to_numpy()
        total = np.array(logs.tolist(), float).reshape(len(sizes), len(m.langs))
        return finish(m, m.ranked(-total / np.maximum(sizes, 1)[:, None], sizes))

    if model.whole:
        return docs.withColumn("_found", of(F.col(text_col).cast("string")))
    return _with_sums(docs, model, shared, text_col).withColumn("_found", of_sums("_sum.logs", "_sum.chars"))


def _with_sums(docs: DataFrame, model: Model, shared, text_col: str) -> DataFrame:
    """``docs`` with the struct ``_sum``: log probability of the text by language, over all
    its grams, and its characters. Grams that the arrays leave out are joined once for
    equal texts (by SHA-256)."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                key = batch["_key"].to_numpy()[a:b]
                logs, chars, text, gram, times = shared.value.parts(batch["text"].iloc[a:b])
                yield pd.DataFrame({"_key": key, "logs": list(logs), "chars": chars, "gram": 0, "times": 0})
                yield pd.DataFrame({"_key": key[text], "logs": None, "chars": 0, "gram": gram, "times": times})

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.unhex(F.sha2(text.cast("binary"), 256)).alias("_key")
    flat = stored(docs.select(key, text.alias("text")).mapInPandas(
        parts, "_key binary, logs array<double>, chars long, gram long, times long"), "lang-parts")
    texts = flat.where(F.col("times") == 0).groupBy("_key").agg(F.count("*").alias("_n"), F.first("logs").alias("logs"), F.max("chars").alias("chars"))
    other = stored(flat.where(F.col("times") > 0).groupBy("_key", "gram").agg(F.max("times").alias("times")), "lang-others")
    facts = _from_tables(other.groupBy("gram").agg(F.count("*").alias("n")), model)
    more = spread_join(other, facts, "gram", "n", facts.agg(F.sum("n")).first()[0] or 0).groupBy("_key").agg(
        F.array(*[F.sum(F.col("times") * F.col("logs")[k]) for k in range(len(model.langs))]).alias("more"))
    logs = F.when(F.col("more").isNull(), F.col("logs")).otherwise(F.zip_with("logs", "more", lambda a, b: a + b))
    sums = stored(texts.join(more, "_key", "left").select("_key", "_n", F.struct(logs.alias("logs"), "chars").alias("_sum")), "lang-sums")
    return spread_join(docs.select("*", key), sums, "_key", "_n", sums.agg(F.sum("_n")).first()[0] or 0).drop("_key")


def _from_tables(grams: DataFrame, model: Model) -> DataFrame:
    """(gram, n) with ``logs``, as ``Model.logs`` but from the whole tables, order by order."""
    size = len(model.langs)
    rows = stored(grams.withColumn("logs", F.array_repeat(F.lit(1.0 / model.symbols), size)), "lang-logs")
    total = rows.count()
    for k in range(1, ORDER + 1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)) if k < ORDER else F.col("gram")
        for look, key, step in ((model.rest[k - 1], F.shiftrightunsigned(tail, 16), lambda p, v: p * v),
                                (model.seen[k - 1], tail, lambda p, v: p + v)):
            keyed = rows.withColumn("key", key)
            none = F.array_repeat(F.lit(look.missing).cast("float"), size)
            facts = keyed.groupBy("key").agg(F.count("*").alias("rows")).join(
                look.table.withColumnRenamed("gram", "key"), "key", "left").withColumn("v", F.coalesce("v", none))
            rows = stored(spread_join(keyed, facts, "key", "rows", total).select("gram", "n", F.zip_with("logs", "v", step).alias("logs")), "lang-logs")
    return rows.withColumn("logs", F.transform("logs", lambda p: F.log(p)))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``rejected`` and ``cross_entropy``."""
    added = ["lang_pred", "score", "rejected", "cross_entropy"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    found = _with_best(docs, model, text_col, Model.named, "lang_pred string, score double, rejected boolean, cross_entropy double")
    return found.select(*kept, *[f"_found.{c}" for c in added])
