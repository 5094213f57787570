"""Byte-level BPE encoding and decoding by a rank file and a split pattern.

Two-tier lookup per pre-token: a minimal perfect hash over the vocabulary
answers pre-tokens that are tokens themselves; the others are merged from
single bytes, lowest rank first, by a heap over a linked list of byte spans.
Workers keep the answers for recent pre-tokens in a table of bounded size.

The vocabulary is built once on the driver and broadcast; its size is bounded
by ``max_bytes`` and does not grow with the corpus. Texts are encoded where
they are read, one narrow pass, and long texts in blocks of pre-tokens, so a
task never holds more than one block of one text besides its ids.

Defined results for odd input: a null text is an empty one, without tokens;
special-token strings are ordinary text; null ids in a list to decode are
skipped and an id outside the vocabulary fails.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.llm.common import python_workers

_MASK = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: buckets,
    largest first, try displacements until their keys fall on free slots; a
    bucket of one takes a free slot outright."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        buckets: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key)
            buckets.setdefault(h % self.buckets, []).append((h, i))
        taken, self.order, self.shift = bytearray(n), [0] * n, [0] * self.buckets
        free = None
        for b, own in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(own) == 1:
                free = free or (s for s in range(n) if not taken[s])
                slots = [next(free)]
                self.shift[b] = -slots[0] - 1
            else:
                d = 0
                while True:
                    slots = [self._slot(h, d) for h, _ in own]
                    if not any(map(taken.__getitem__, slots)) and len(set(slots)) == len(slots):
                        break
                    d += 1
                self.shift[b] = d
            for s, (_, i) in zip(slots, own):
                taken[s] = 1
                self.order[s] = i

    def _slot(self, h: int, d: int) -> int:
        h = (h ^ d * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & _MASK
        return (h >> 32) % self.n

    def slot(self, key: bytes) -> int:
        """The slot of a key of the set; any slot for other bytes."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        return -d - 1 if d < 0 else self._slot(h, d)


#: Ranges with the letters and numbers that Unicode 16 added. The
#: tokenizer library's tables are of that version, this Python's of the one before.
_UNICODE_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x113D5), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9),
    (0x13460, 0x143FA), (0x16100, 0x16139), (0x16D40, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FA),
]


@lru_cache(1)
def _new_characters() -> str:
    """Class members for letters and numbers that ``regex`` knows and Unicode
    16 doesn't: a newer version assigned them."""
    at, spans = regex.compile(r"[\p{L}\p{N}]"), []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) == "Cn" and at.match(chr(c)) and not any(a <= c <= b for a, b in _UNICODE_16):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def _as_assigned(pattern: str) -> str:
    """``pattern`` with \\p{L} and \\p{N} as they were before those characters."""
    new = _new_characters()
    if not new:
        return pattern
    old = {x: f"[\\p{{{x}}}--[{new}]]" for x in "LN"}
    return pattern.replace(r"\p{L}", old["L"]).replace(r"\p{N}", old["N"])


class _Recent(dict):
    """Ids of recent pre-tokens; works out those it hasn't."""

    def __init__(self, encoder: "Encoder", kept: int):
        super().__init__()
        self.encoder, self.kept = encoder, kept

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.kept:
            self.clear()
        ids = self[piece] = self.encoder.piece_ids(piece.encode())
        return ids


class Encoder:
    """Encodes and decodes by ``ranks`` and ``pattern``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = 1 << 18):
        tokens = list(ranks)
        self.hash = PerfectHash(tokens)
        self.keys = [tokens[i] for i in self.hash.order]
        self.ranks = [ranks[k] for k in self.keys]
        self.rank_of = dict(ranks)  # of the spans that merges make
        self.bytes_of = {rank: key for key, rank in ranks.items()}
        self.pattern, self.kept = pattern, kept
        self._start()

    def _start(self) -> None:
        self.split = regex.compile(self.pattern)
        self.exact = regex.compile(_as_assigned(self.pattern), regex.V1)
        self.recent = _Recent(self, self.kept)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "exact", "recent")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def rank(self, piece: bytes) -> int | None:
        s = self.hash.slot(piece)
        return self.ranks[s] if self.keys[s] == piece else None

    def piece_ids(self, piece: bytes) -> tuple[int, ...]:
        whole = self.rank(piece)
        return (whole,) if whole is not None else self._merged(piece)

    def _merged(self, piece: bytes) -> tuple[int, ...]:
        rank, n = self.rank_of.get, len(piece)
        end = list(range(1, n + 1))  # of the span that starts here; 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(piece[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, mid, to = heappop(heap)
            if end[i] != mid or end[mid] != to:
                continue
            end[i], end[mid] = to, 0
            if to < n:
                before[to] = i
                if (r := rank(piece[i:end[to]])) is not None:
                    heappush(heap, (r, i, to, end[to]))
            if (p := before[i]) >= 0 and (r := rank(piece[p:to])) is not None:
                heappush(heap, (r, p, i, to))
        out, i = [], 0
        while i < n:
            out.append(self.rank_of[piece[i:end[i]]])
            i = end[i]
        return tuple(out)

    def _of(self, pieces: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.recent.__getitem__, pieces)))

    def blocks(self, text: str, block: int = 1 << 16) -> Iterator[list[int]]:
        """Ids of ``text``, up to ``block`` pre-tokens at a time."""
        try:
            text.encode("latin-1")  # such characters are the same in all Unicode versions
            split = self.split
        except UnicodeEncodeError:
            split = self.exact
        if len(text) <= block:
            yield self._of(split.findall(text))
            return
        found = (m[0] for m in split.finditer(text))
        while pieces := list(islice(found, block)):
            yield self._of(pieces)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.blocks(text or "")))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Token count, SHA-256 of the comma-joined ids, of the decoded bytes."""
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.blocks(text or ""):
            if ids:
                ids_hash.update(("," * (n > 0) + ",".join(map(str, ids))).encode())
                text_hash.update(self.decode(ids))
                n += len(ids)
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


def load(path: str, pattern: str, max_bytes: int = 64 << 20) -> Encoder:
    """An encoder from a rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        data = f.read(max_bytes + 1)
    if len(data) > max_bytes:
        raise ValueError(f"{path} is over {max_bytes} bytes: too large to broadcast")
    pairs = (line.split() for line in data.splitlines() if line)
    return Encoder({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)


def encoded(df: DataFrame, encoder: Encoder, text_col: str = "text", name: str = "ids") -> DataFrame:
    """``df`` with the ids of its texts as an array column."""
    shared = _share(df.sparkSession, encoder)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.encode(t) for t in texts], dtype=object)

    return df.withColumn(name, ids(F.col(text_col)))


def decoded(df: DataFrame, encoder: Encoder, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the bytes of an id array column (null: null)."""
    shared = _share(df.sparkSession, encoder)

    @F.pandas_udf("binary")
    def text(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else shared.value.decode(int(i) for i in x if i is not None and i == i)
                          for x in ids], dtype=object)

    return df.withColumn(name, text(F.col(ids_col)))


def digest(spark: SparkSession, encoder: Encoder, text: Column) -> Column:
    """A struct column (n_tokens, ids_sha256, decoded_sha256) of a text column."""
    shared = _share(spark, encoder)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.digest(t) for t in texts],
                            columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return of(text)


def _share(spark: SparkSession, encoder: Encoder):
    python_workers(spark)
    return spark.sparkContext.broadcast(encoder)
