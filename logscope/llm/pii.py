"""Personal data in texts: exact base patterns and a skip-chain CRF.

The base patterns find emails, ip addresses, card and phone numbers. The CRF
then labels the words that hold a digit or an ``@`` (no other word can be one):
neighbouring words share a chain potential, and equal words, however far
apart and whatever their punctuation, share a skip potential, as do words at
which numbers with the same last ``SUFFIX`` digits end, however grouped. Words inside a
base match are observed; loopy message passing carries their labels to the
other mentions in the document. Words that a label reaches with at least
``threshold`` become spans too. Base spans always stay.

The CRF runs on every text that has such a word, with or without a base match.
``fit`` counts word shapes with the labels of the words linked to them, chain
pairs and skip pairs over all documents: partial counts per task, then sums.
From them it takes pair potentials (smoothed log ratios) and, given these, node
weights by pseudo-likelihood: what the linked words explain is not learned again
as a property of the word. A word without neighbours that is no base match by
itself has a feature for it: alone, a part of a number is weaker evidence.
The model is a few kilobytes and is sent to the tasks; texts are read where
they are, without a shuffle.

The base patterns label only what has their form, so a word outside of them is
not known to be clean. Three kinds of words teach the node weights:

* words of base matches, and words that fail the test of a pattern that they fit
  (a number of 16 digits without Luhn's sum): known;
* each base match, in ``COPIES`` copies of the text, in another form (``other_forms``: a phone without its
  plus, a card with dots) in its own place, in half of the cases with the base match
  after it (then also in its ``short_form``), and one number that is nobody's (``decoys``): known;
* all other words: unlabelled. They start as clean, and ``EM_ROUNDS`` rounds of
  expectation and maximisation give them the model's own posterior.

A skip pair of a base match and an unlabelled word is not counted: it may be the
same number in another form. At most ``max_rows`` different (shape, labels of the linked
words) reach the driver, the most frequent ones; rarer ones are left out of the
node weights (not of the pair potentials).

Mentions are linked in the order of the text, so a word or number with k
mentions has k - 1 skip edges, not k * k. All scans are linear in the length of the text.

Defined results for odd input: a null text counts as empty and stays null when
masked; a text whose messages do not come to rest within its sweeps (they are damped
from ``DAMPED`` sweeps on) has ``settled`` false; ids are carried as they are; repeated rows give repeated rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.llm.common import python_workers

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
OTHER = 0  # the label of other words; kind k has label k + 1
N_LABELS = len(KINDS) + 1
SUFFIX = 7  # digits that similar numbers end with
EM_ROUNDS = 3
COPIES = 4
DAMPED = 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPACES = frozenset(" \t\n\x0b\x0c\r")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_MARK = re.compile(r"[0-9@]")
_NOT_CORE = re.compile(r"[\W_]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_INNER_AT = re.compile(r"[A-Za-z0-9]@[A-Za-z0-9]")
_GROUP = re.compile(r"[0-9]+")
_DIGITS = b"0123456789"

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        at = text.find("@", at + 1)


def _is_ip(text: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in text.split(".")))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    raw = text.encode(errors="surrogatepass")
    if len(raw.translate(None, _DIGITS)) == len(raw):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if _is_ip(m[0])]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def words(text: str) -> list[tuple[int, int]]:
    """Words that hold a digit or an ``@``."""
    out, at = [], 0
    while m := _MARK.search(text, at):
        start = m.start()
        while start > at and text[start - 1] not in _SPACES:
            start -= 1
        end = _SPACE.search(text, m.end())
        at = end.start() if end else len(text)
        out.append((start, at))
    return out


def shape(word: str) -> str:
    """Features of a word, each of few values."""
    digits = _NOT_DIGIT.sub("", word)
    bare = word.strip(".,;:!?\"'()[]#*$%&|<>")
    letters = sum(1 for _ in islice(filter(str.isalpha, word), 3))
    return "|".join(f"{name}={value}" for name, value in (
        ("at", min(word.count("@"), 2)), ("digits", len(digits) if len(digits) < 20 else 20),
        ("dots", min(bare.count("."), 4)), ("ip", bool(_IP.fullmatch(bare)) and _is_ip(bare)),
        ("luhn", 16 <= len(digits) <= 19 and luhn(digits)), ("plus", word.startswith("+")),
        ("letters", letters), ("hyphen", "-" in word), ("round", "(" in word), ("equals", "=" in word),
        ("inner", bool(_INNER_AT.search(word))), *_groups(word)))


def _groups(word: str) -> tuple[tuple[str, int | str], ...]:
    """Number, longest and lengths of the digit groups: of the first 6, to 6 digits each."""
    sizes = [min(m.end() - m.start(), 6) for m in islice(_GROUP.finditer(word), 6)]
    return (("groups", len(sizes)), ("longest", max(sizes, default=0)),
            ("sizes", "-".join(map(str, sizes)) if len(sizes) < 6 else "many"))


@dataclass
class Graph:
    """The labelled part of one text."""
    words: list[tuple[int, int]]
    shapes: list[str]
    label: np.ndarray  # of the base span that the word touches; -1: none
    chain: np.ndarray  # pairs of neighbours
    skip: np.ndarray  # pairs of equal or similar words, each with its next mention


def graph(text: str, base: list[Span]) -> Graph:
    found = words(text)
    label, ends = np.full(len(found), -1), np.array([b for _, b in found])
    for kind, start, end in reversed(base):  # an earlier kind wins a word
        lo = np.searchsorted(ends, start, side="right")
        for i in range(int(lo), len(found)):
            if found[i][0] >= end:
                break
            label[i] = kind + 1
    chain = [(i, i + 1) for i in range(len(found) - 1) if not text[found[i][1]:found[i + 1][0]].strip(" \t\n\x0b\x0c\r")]
    last: dict[str, int] = {}
    skip, run, linked = [], "", {b for _, b in chain}
    for i, (a, b) in enumerate(found):
        core = _NOT_CORE.sub("", text[a:b]).lower()
        digits = _NOT_DIGIT.sub("", core)
        run = ((run if i in linked else "") + digits)[-SUFFIX:] if len(digits) == len(core) else ""
        keys = {core, "#" + run} if len(run) == SUFFIX else {core}
        skip += sorted({(last[k], i) for k in keys if k in last})
        last.update((k, i) for k in keys)
    beside = {i for pair in chain for i in pair}
    alone = ["" if i in beside or base_spans(text[a:b]) else "|alone" for i, (a, b) in enumerate(found)]
    return Graph(found, [shape(text[a:b]) + x for (a, b), x in zip(found, alone)], label,
                 np.array(chain, dtype=np.int64).reshape(-1, 2), np.array(skip, dtype=np.int64).reshape(-1, 2))


class Model:
    """Node weights by shape feature, and pair potentials."""

    def __init__(self, weights: dict[str, np.ndarray], chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip
        self._nodes: dict[str, np.ndarray] = {}

    def node(self, word_shape: str) -> np.ndarray:
        if (v := self._nodes.get(word_shape)) is None:
            none = np.zeros(N_LABELS)
            v = self._nodes[word_shape] = sum((self.weights.get(f, none) for f in ["", *word_shape.split("|")]), none)
        return v

    def marginals(self, g: Graph) -> np.ndarray:
        return self.settled_marginals(g)[0]

    def settled_marginals(self, g: Graph) -> tuple[np.ndarray, bool]:
        """Label marginals, and whether they came to rest, by loopy sum-product messages, in sweeps forwards and
        backwards over the text until they rest. A sweep carries a label along a
        whole chain, whatever its length; a path of n words turns less than n
        times, so n sweeps bound the loop. Without loops few sweeps are enough;
        those after ``DAMPED`` go half of the way."""
        potential = np.array([self.node(s) for s in g.shapes])
        seen = np.flatnonzero(g.label >= 0)
        potential[seen] = -40.0
        potential[seen, g.label[seen]] = 0.0
        edges = np.concatenate([g.chain, g.skip])
        if not len(edges):
            return _softmax(potential), True
        pair = [*[np.exp(self.chain)] * len(g.chain), *[np.exp(self.skip)] * len(g.skip)]
        # message 2e goes forwards over edge e, 2e + 1 backwards
        message = np.full((2 * len(edges), N_LABELS), 1 / N_LABELS)
        belief = np.exp(potential - potential.max(axis=1, keepdims=True))
        ends = edges.tolist()
        forwards = [(2 * e, *ends[e], pair[e]) for e in sorted(range(len(ends)), key=lambda e: ends[e])]
        backwards = [(2 * e + 1, *ends[e][::-1], pair[e].T) for e in sorted(range(len(ends)), key=lambda e: ends[e][::-1], reverse=True)]
        rest = False
        for sweep in range(max(2 * DAMPED, len(g.words))):
            moved = 1.0
            for m, source, target, table in forwards + backwards:
                out = (belief[source] / message[m ^ 1]) @ table
                out /= out.sum()
                if sweep >= DAMPED:
                    out = np.sqrt(out * message[m])
                    out /= out.sum()
                step = out / message[m]
                moved = max(moved, step.max(), 1 / step.min())
                belief[target] *= step
                belief[target] /= belief[target].max()
                message[m] = out
            if rest := moved < 1 + 1e-4:
                break
        return belief / belief.sum(axis=1, keepdims=True), bool(rest)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def spans(text: str | None, model: Model, threshold: float = 0.95) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, by kind and start."""
    return settled_spans(text, model, threshold)[:2]


def settled_spans(text: str | None, model: Model, threshold: float = 0.95) -> tuple[list[Span], list[Span], bool]:
    """Base spans, all spans, and whether the messages came to rest."""
    text, rest = text or "", True
    base = base_spans(text)
    added: list[Span] = []
    g = graph(text, base)
    if (g.label < 0).any():
        p, rest = model.settled_marginals(g)
        kind = p.argmax(axis=1)
        for i in np.flatnonzero((g.label < 0) & (kind != OTHER) & (p.max(axis=1) >= threshold)):
            a, b = g.words[i]
            while a < b and not text[a].isalnum() and text[a] != "+":
                a += 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
            if a < b:
                added.append((int(kind[i]) - 1, a, b))
    return sorted(base), sorted(base + added), rest


def written(found: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


# ------------------------------------------------------------ training


def other_forms(kind: int, said: str) -> list[str]:
    """A base match as people write it that the patterns do not take."""
    if kind == 0:
        user, host = said.split("@", 1)
        return [f"{user}@{host.split('.')[0]}", f"{user}@{host.replace('.', ',')}"]
    if kind == 1:
        return [said.replace(".", "-"), "ip-" + said.replace(".", "-")]
    d = _digits(said)
    if kind == 2:
        fours = [d[i:i + 4] for i in range(0, len(d), 4)]
        return [".".join(fours), "/".join(fours)]
    area, office, line = d[-10:-7], d[-7:-4], d[-4:]
    return [f"{area}-{office}-{line}", f"({area}) {office}-{line}", f"{area}.{office}.{line}"]


def short_form(kind: int, said: str) -> str | None:
    """What stands for a base match only in a text that has it in full."""
    d = _digits(said)
    return f"{d[-7:-4]}-{d[-4:]}" if kind == 3 else None


def decoys(said: str) -> list[str]:
    """Numbers and handles that are nobody's, with the digits of a base match."""
    d = (_digits(said) + "20210304")[:8]
    return [f"{d[:4]}-{d[4:6]}-{d[6:]}", f"{d[:2]}.{d[2:4]}.{d[4:]}", f"{d[:2]}:{d[2:4]}", f"{d[:1]}.{d[1:2]}.{d[2:3]}",
            f"{d[:3]}-{d[3:6]}", f"{d[:3]}-{d[3:7]}", f"{d[:1]},{d[1:4]}.{d[4:6]}", f"AB-{d[:6]}", "@name", f"@name{d[:2]}",
            d, d[:4], f"{d[:2]}/{d[2:4]}/{d[4:]}", f"{d[:1]}-{d[1:4]}-{d[4:]}-{d[:1]}", f"{d[:2]}%", f"#{d[:5]}"]


def _replanted(text: str, base: list[Span], copy: int = 0) -> tuple[str, list[Span]]:
    """``text`` with each base match in another form, and what is known of it. The
    match and the number of the copy choose the form, whether a mention of it follows,
    the decoy, and the parts of an ip, as their lengths shape its words."""
    out, known, at, size, end = [], [], 0, 0, []
    for a, b, kind in sorted((a, b, k) for k, a, b in base):
        if a < at:  # inside a match of another kind
            continue
        said = text[a:b]
        lot = crc32(f"{copy} {said}".encode(errors="surrogatepass"))
        if kind == 1:
            said = ".".join(map(str, lot.to_bytes(4)))
        follows, nobody, short = lot // 7 % 2, decoys(said), short_form(kind, said)
        forms = [short] if follows and short and lot % 2 else other_forms(kind, said)
        form = forms[lot // 2 % len(forms)]
        out += [text[at:a], form]
        size += a - at
        known.append((kind, size, size + len(form)))
        size, at = size + len(form), b
        end += [(OTHER - 1, nobody[lot // 17 % len(nobody)])] + [(kind, said)] * follows
    out.append(text[at:])
    size += len(text) - at
    for kind, said in end:
        out += [" and ", said]
        known.append((kind, size + 5, size + 5 + len(said)))
        size += 5 + len(said)
    return "".join(out), known


def _failed(text: str) -> list[Span]:
    """Matches of a pattern that fail its test."""
    out = [(OTHER - 1, *m.span()) for m in _IP.finditer(text) if not _is_ip(m[0])]
    out += [(OTHER - 1, *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and not luhn(d)]
    return out


UNLABELLED = -1


def _counts(texts: pd.Series) -> pd.DataFrame:
    n: Counter = Counter()

    def count(g: Graph, only_known: bool) -> None:
        label = np.maximum(g.label, OTHER)
        linked: list[tuple[list[int], list[int]]] = [([], []) for _ in g.shapes]
        for side, (name, pairs) in enumerate((("chain", g.chain), ("skip", g.skip))):
            for a, b in pairs:
                linked[a][side].append(int(label[b]))
                linked[b][side].append(int(label[a]))
                unsure = g.label[a] < 0 or g.label[b] < 0
                if not (unsure and (only_known or name == "skip" and label[a] != label[b])):
                    n[(name, "", int(label[a]), int(label[b]))] += 1
        for s, (chain, skip), y in zip(g.shapes, linked, g.label):
            if y >= 0 or not only_known:
                around = "/".join("".join(map(str, sorted(x))) for x in (chain, skip))
                n[("node", f"{s}\t{around}", int(y), 0)] += 1

    for text in texts:
        text = text or ""
        base = base_spans(text)
        count(graph(text, base + _failed(text)), only_known=False)
        for copy in range(COPIES if base else 0):
            count(graph(*_replanted(text, base, copy)), only_known=True)
    return pd.DataFrame([(*k, v) for k, v in n.items()], columns=["what", "shape", "a", "b", "n"])


def _potential(rows: list, what: str, prior: float, most: float) -> np.ndarray:
    """log p(a, b) / p(a) p(b) from counts, both ways, p(a) over all words; smoothed by
    ``prior`` pairs without a tie, and at most ``most`` either way."""
    c, own = np.zeros((N_LABELS, N_LABELS)), np.ones(N_LABELS)
    for r in rows:
        if r["what"] == what:
            c[r["a"], r["b"]] += r["n"] / 2
            c[r["b"], r["a"]] += r["n"] / 2
        elif r["what"] == "node":
            own[max(r["a"], OTHER)] += r["n"]
    own /= own.sum()
    expected = np.outer(own, own)
    return np.clip(np.log((c + prior * expected + 1e-9) / ((c.sum() + prior) * expected)), -most, most)


def _train(shapes: list[str], label: np.ndarray, n: np.ndarray, given: np.ndarray, rounds: int = 400, l2: float = 1e-3) -> dict[str, np.ndarray]:
    """Node weights; ``given`` holds the potentials from the labels of linked words."""
    split = [["", *s.split("|")] for s in shapes]
    names = sorted({f for fs in split for f in fs})
    at, width = {f: i for i, f in enumerate(names)}, max(map(len, split))
    x = np.array([[at[f] for f in fs] + [len(names)] * (width - len(fs)) for fs in split])  # the last weight stays 0
    share, free = (n / n.sum())[:, None], label == UNLABELLED
    y, w = np.eye(N_LABELS)[np.maximum(label, OTHER)], np.zeros((len(names) + 1, N_LABELS))
    for em in range(EM_ROUNDS + 1):
        if em:
            y[free] = _softmax(w[x[free]].sum(axis=1) + given[free])
        m, v = 0.0, 0.0
        for t in range(1, (rounds // 4 if em else rounds) + 1):  # Adam
            off, g = share * (_softmax(w[x].sum(axis=1) + given) - y), l2 * w / len(names)
            for column in x.T:
                np.add.at(g, column, off)
            g[-1] = 0
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
    return {f: w[i] for f, i in at.items()}


def fit(docs: DataFrame, text_col: str = "text", max_rows: int = 20000) -> Model:
    """A model from the counts over all texts that hold a digit or an ``@``."""
    python_workers(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _counts(batch["text"])

    marked = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    counted = marked.mapInPandas(count, "what string, shape string, a int, b int, n long").groupBy(
        "what", "shape", "a", "b").agg(F.sum("n").alias("n"))
    # pairs (at most 2 x 25 rows) first, then nodes by frequency
    rows = counted.orderBy(F.col("what") == "node", "what", F.desc("n"), "shape", "a", "b").limit(max_rows).collect()
    # neighbours may well differ; the same number seldom does
    chain, skip = _potential(rows, "chain", prior=4, most=4), _potential(rows, "skip", prior=1, most=6)
    nodes = [r for r in rows if r["what"] == "node"]
    if not nodes:
        return Model({}, chain, skip)
    shapes, around = zip(*(r["shape"].split("\t") for r in nodes))
    given = np.array([sum((pair[int(y)] for pair, near in zip((chain, skip), r.split("/")) for y in near), np.zeros(N_LABELS)) for r in around])
    weights = _train(list(shapes), np.array([r["a"] for r in nodes], dtype=int), np.array([r["n"] for r in nodes], dtype=float), given)
    return Model(weights, chain, skip)


# ------------------------------------------------------------ application


def report(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.95) -> DataFrame:
    """Per row: id, base counts by kind, ``base_sha256``, ``spans``, ``n_added``, ``settled``."""
    python_workers(docs.sparkSession)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, settled boolean")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, every, rest = settled_spans(text, model, threshold)
            n = Counter(k for k, _, _ in base)
            rows.append((*(n[k] for k in range(len(KINDS))), hashlib.sha256(written(base).encode()).hexdigest(),
                         written(every), len(every) - len(base), rest))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "settled"])

    return docs.select(id_col, found(F.col(text_col)).alias("_f")).select(id_col, "_f.*")


def mask_text(text: str | None, model: Model, threshold: float = 0.95) -> str | None:
    if text is None:
        return None
    _, every = spans(text, model, threshold)
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in every):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(text: Column, model: Model, threshold: float = 0.95) -> Column:
    """A text column with each span replaced by its kind in brackets."""
    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return pd.Series([mask_text(t, model, threshold) for t in texts], dtype=object)

    return mask(text)
