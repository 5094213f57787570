"""Document quality by a linear-chain CRF over lines.

Every line with a word gets features of its own form (word count, word length,
capitals, symbols, repeats, ...) and those of its neighbours. A binary
linear-chain CRF labels the lines good or bad; forward-backward marginals,
weighted by line length, average into one number per document, and a logistic
curve turns that into the probability of the label.

``fit`` trains on a bounded sample: at most ``max_docs`` labelled ids, those with
the smallest hash, one row of each, and of these, in the same order, as many as have
``max_lines`` lines together (a document that no longer fits is passed over). A
document's length alone never keeps it out while it has at most ``max_lines`` lines;
its lines are trained on as chains of at most ``CHAIN``. Only
ids and line counts, and then the features (some 50 bytes a line) of the chosen
ones, reach the driver. Scoring is one narrow pass over whole texts with the model (a few
hundred numbers) in the closure.

Slices of a batch are scored line by line of all their documents at once, on ragged
arrays, so memory follows the text of a slice, not its longest document.

Defined results for odd input: a null or empty text, or one without words, has
the share of good documents in the sample as its score (0.5 without labels, as
has every document then); a label other than 0 and 1 is no label; an id that is
labelled twice counts with the smaller label; of rows that repeat a labelled id the one
whose text has the least hash is learned from; repeated rows give repeated rows;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.llm.common import slices, stored
from logscope.session import ship_package

#: ASCII classes of the line features.
_UPPER, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&|<>"
_DIGITS, _STOPS = b"0123456789", b".,;:?"
N_OWN = 12
#: Lines of a chain in training; scoring runs over whole documents.
CHAIN = 500


def _line(raw: bytes, copies: int) -> list[float]:
    words = raw.split()
    n, size = len(words), sum(map(len, words))
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    return [np.log1p(n) / 8, size / n / 16, min(1.0, without(_UPPER) / size), min(1.0, without(_SYMBOLS) / n),
            min(1.0, raw.count(b"!") / n), without(_DIGITS) / size, min(1.0, without(_STOPS) / n),
            sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n, float(copies > 1),
            float(words[-1][-1:] in (b".", b"!", b"?")), float(n < 5)]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(own features of the lines, their lengths) of a text."""
    lines = [x for x in (text or "").encode(errors="surrogatepass").split(b"\n") if x.strip()]
    copies = Counter(lines)
    own = np.array([_line(x, copies[x]) for x in lines], dtype=np.float32).reshape(-1, N_OWN)
    return own, np.array([len(x) for x in lines], dtype=np.float64)


def with_neighbours(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of own, previous and next features, and whether there is one."""
    n = len(own)
    first = np.zeros(n, bool)
    first[starts[:-1][starts[:-1] < n]] = True
    last = np.roll(first, -1)
    out = np.zeros((n, 3 * N_OWN + 3))
    out[:, :N_OWN] = own
    if n:
        out[1:, N_OWN:2 * N_OWN] = np.where(first[1:, None], 0, own[:-1])
        out[:-1, 2 * N_OWN:3 * N_OWN] = np.where(last[:-1, None], 0, own[1:])
        last[-1] = True
    out[:, -3], out[:, -2], out[:, -1] = first, last, 1
    return out


def _steps(starts: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Sequence starts, longest first, and how many have a line at each step."""
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    active = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), side="right")
    return starts[:-1][order], active.tolist()


def _lse(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def forward_backward(e: np.ndarray, trans: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label marginals of all lines, expected transitions, log normalisers by
    sequence (longest first), from emissions ``e`` (lines x 2)."""
    first, active = _steps(starts)
    a, b = e.copy(), np.zeros_like(e)
    for t in range(1, len(active)):
        at = first[:active[t]] + t
        a[at] += np.stack([_lse(a[at - 1] + trans[:, y]) for y in (0, 1)], axis=1)
    pairs = np.zeros((2, 2))
    end = np.zeros(len(first))
    for t in range(len(active) - 1, -1, -1):
        here = active[t]
        more = active[t + 1] if t + 1 < len(active) else 0
        ends = slice(more, here)
        end[ends] = _lse(a[first[ends] + t])
        at = first[:more] + t
        if more:
            ahead = e[at + 1] + b[at + 1]
            b[at] = np.stack([_lse(trans[x] + ahead) for x in (0, 1)], axis=1)
            joint = a[at][:, :, None] + trans + ahead[:, None, :] - end[:more, None, None]
            pairs += np.exp(joint).sum(axis=0)
    total = _lse(a + b) if len(e) else np.zeros(0)
    return np.exp(a + b - total[:, None]), pairs, end


@dataclass
class Model:
    weights: np.ndarray  # features, of label good against bad
    trans: np.ndarray
    slope: float
    shift: float
    prior: float

    def raw(self, own: np.ndarray, length: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of good by document; nan without lines."""
        x = with_neighbours(own, starts)
        e = np.stack([np.zeros(len(x)), x @ self.weights], axis=1)
        p = forward_backward(e, self.trans, starts)[0][:, 1]
        total = np.concatenate([[0], np.cumsum(p * length)])
        weight = np.concatenate([[0], np.cumsum(length)])
        with np.errstate(invalid="ignore"):
            return (total[starts[1:]] - total[starts[:-1]]) / (weight[starts[1:]] - weight[starts[:-1]])

    def score(self, texts) -> np.ndarray:
        parts = [features(t) for t in texts]
        starts = np.cumsum([0, *[len(n) for _, n in parts]])
        own = np.concatenate([np.zeros((0, N_OWN), np.float32), *[x for x, _ in parts]])
        mean = self.raw(own, np.concatenate([np.zeros(0), *[n for _, n in parts]]), starts)
        return np.where(np.isnan(mean), self.prior, _sigmoid(self.slope * _logit(mean) + self.shift))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _adam(grad, size: int, rounds: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
    return w


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 150, l2: float = 0.02) -> Model:
    """From (own features, line lengths, label) of documents with lines."""
    y = np.array([d[2] for d in docs], dtype=float)
    if not len(docs) or y.min() == y.max():
        prior = float(y.mean()) if len(docs) else 0.5
        return Model(np.zeros(3 * N_OWN + 3), np.zeros((2, 2)), 0.0, float(_logit(np.array(prior))), prior)
    starts = np.cumsum([0, *[len(d[1]) for d in docs]])
    x = with_neighbours(np.concatenate([d[0] for d in docs]), starts)
    length = np.concatenate([d[1] for d in docs])
    sizes = np.diff(starts)
    label = np.repeat(y, sizes)
    # chains are swept step by step, so long documents are several chains; their line features still see all neighbours
    chains = np.concatenate([*[np.arange(a, b, CHAIN) for a, b in zip(starts[:-1], starts[1:])], starts[-1:]])
    seen = np.zeros((2, 2))
    for v in (0, 1):
        seen[v, v] = (np.diff(chains)[label[chains[:-1]] == v] - 1).sum()

    def grad(w: np.ndarray) -> np.ndarray:
        e = np.stack([np.zeros(len(x)), x @ w[:-4]], axis=1)
        p, pairs, _ = forward_backward(e, w[-4:].reshape(2, 2), chains)
        g = np.concatenate([x.T @ (p[:, 1] - label), (pairs - seen).ravel()])
        return (g + l2 * len(docs) * w * np.r_[np.full(len(w) - 4, 0.05), np.ones(4)]) / len(docs)

    w = _adam(grad, x.shape[1] + 4, rounds, 0.15)
    model = Model(w[:-4], w[-4:].reshape(2, 2), 1.0, 0.0, float(y.mean()))
    z = _logit(model.raw(np.concatenate([d[0] for d in docs]), length, starts))

    def curve(c: np.ndarray) -> np.ndarray:
        gap = _sigmoid(c[0] * z + c[1]) - y
        return np.array([(gap * z).mean() + 0.002 * (c[0] - 1), gap.mean()])

    model.slope, model.shift = map(float, _adam(curve, 2, 400, 0.05))
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Whether an id is never learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_docs: int = 3000, max_lines: int = 500_000) -> Model:
    """A model from labelled rows that are not held out."""
    ship_package(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"), (~held_out(id_col)).alias("use"))
    chosen = known.where("use AND y IN (0, 1) AND id IS NOT NULL").groupBy("id").agg(F.min("y").cast("int").alias("y")).orderBy(
        F.xxhash64("id"), "id").limit(max_docs)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, y, place, text in zip(batch["id"], batch["y"], batch["place"], batch["text"]):
                own, n = features(text)
                if len(n):
                    yield pd.DataFrame([(i, y, place, own.tobytes(), n.astype(np.float32).tobytes(), len(n))],
                                       columns=["id", "y", "place", "own", "size", "n_lines"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    mine = texts.join(F.broadcast(chosen), "id").withColumn("text_hash", F.xxhash64("text"))  # at most max_docs ids are broadcast
    least = mine.groupBy("id", "y").agg(F.min("text_hash").alias("text_hash"))
    # an id's rows with that hash have one text: the aggregate keeps one of them in every task
    one = mine.join(F.broadcast(least), ["id", "y", "text_hash"]).groupBy("id", "y").agg(F.max("text").alias("text"))
    rows = stored(one.select(F.col("id").cast("string").alias("id"), "y", F.xxhash64("id").alias("place"), "text").mapInPandas(
        of, "id string, y int, place long, own binary, size binary, n_lines long"), "crf-sample")
    room, use = max_lines, []
    for r in sorted(rows.select("id", "place", "n_lines").collect(), key=lambda r: (r["place"], r["id"])):  # at most max_docs
        if r["n_lines"] <= room:
            room -= r["n_lines"]
            use.append(r["id"])
    found = sorted(rows.where(F.col("id").isin(use)).collect(), key=lambda r: (r["id"], bytes(r["own"])))  # at most max_lines lines
    return train([(np.frombuffer(r["own"], np.float32).reshape(-1, N_OWN), np.frombuffer(r["size"], np.float32).astype(float), r["y"])
                  for r in found])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: id, ``held_out``, ``score``, ``predicted``."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([np.zeros(0), *[model.score(texts.iloc[a:b]) for a, b in slices(texts)]]))

    out = docs.select(F.col(id_col).alias(id_col), held_out(id_col).alias("held_out"), of(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
