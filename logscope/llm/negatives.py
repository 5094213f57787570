"""Hard negatives: per anchor and positive, the best rows of other labels whose
score lies in a window below the positive's.

Candidates are put on a Hilbert curve over the ``axes`` components that vary
most, sorted along it by Spark's range partitioning and cut into blocks of at
most ``block_rows`` rows. A block is one row of a Parquet table: its vectors, and
as zone map the minimum and maximum of every component and of the label. From a
zone map, interval arithmetic bounds all inner products between an anchor and
the rows of a block from both sides.

Anchors go in groups along the same curve. A group first looks at the blocks that
its anchors come from: the kth best score there is a bound that the true kth best
cannot be below. Then every group is held against the zone maps, not the vectors:
a block is read for the positives if its upper bound reaches that kth score, and
for the negatives if its bounds touch the window of a positive. What is to be
read becomes (group, block) pairs, which meet the block table in an equi-join and
are worked off in cells of some ``CELL`` blocks, the largest upper bound first; a
cell returns at most k rows for each anchor or window, and a window function
picks the final ones.

The driver sees the range of ``axes`` components and two counts. A cell holds
one group and its blocks, whatever the table's size. Rows with equal vectors are
spread by id, and by a hash of the row where ids repeat, so no key of the range
sort grows with the copies of one vector.

Components are floored integers (256 * x) and scores exact integers, as in the
top-k search. The window of a positive with score s holds scores n with
``low * s <= 100 * n <= high * s``.

Defined results for odd input: rows with a null id or label, or whose vector is
null or holds a null or non-finite component, take no part; rows with the
anchor's id are its own and never its positives or negatives; repeated anchor
rows are anchors of their own and repeated candidates are candidates of their
own; ties go to smaller ids; shorter vectors are padded with zeros; fewer rows
than asked for give fewer rows; an empty table gives none; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscope.llm.common import stored
from logscope.llm.kdtree import _HIGH, _LOW, EXACT, Best, _floored, _integers, _usable
from logscope.session import ship_package

#: Blocks of a cell and zone maps of a chunk, on average.
CELL, CHUNK = 16, 512


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of rows of ``bits``-bit coordinates (at most
    63 bits together), by Skilling's transform (2004) of all rows at once."""
    x, (n, d) = cells.astype(np.int64).copy(), cells.shape
    for level in range(bits - 1, 0, -1):
        top, below = 1 << level, (1 << level) - 1
        for i in range(d):
            on = (x[:, i] & top) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & below)
            x[:, 0] ^= np.where(on, below, swap)
            x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, d - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> level) & 1)
    return key


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int16) if np.abs(x).max(initial=0) < 1 << 15 else x


def _aligned(*rows: np.ndarray) -> list[np.ndarray]:
    """Matrices of one width, in a type in which their inner products are exact."""
    width = max(m.shape[1] for m in rows)
    out = [np.pad(m.astype(np.float64), ((0, 0), (0, width - m.shape[1]))) for m in rows]
    sizes = [max(np.abs(m).max(initial=0), 1) for m in out]
    return out if width * sizes[0] * max(sizes[1:]) < EXACT else [_integers(m) for m in out]


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    a, x = _aligned(anchors, rows)
    s = a @ x.T
    return s.astype(np.int64) if s.dtype != object else np.clip(s, _LOW, _HIGH).astype(np.int64)


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product that boxes allow, anchors by boxes."""
    a, lo, hi = _aligned(anchors, lo, hi)
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


def block_table(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                label_col: str = "label", block_rows: int = 2048, axes: int = 12, bits: int = 5) -> DataFrame:
    """The blocks along the curve: ``block``, zone map (``lo``, ``hi``,
    ``label_lo``, ``label_hi``) and ``rows``; rows with ``anchor`` are marked."""
    ship_package(vectors.sparkSession)
    used = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & _usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("v"))
    widest = used.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.var_pop("x").alias("spread")).orderBy(
        F.col("spread").desc(), "at").limit(axes).collect()  # at most axes rows

    @F.pandas_udf("long")
    def key(v: pd.Series) -> pd.Series:
        cells = np.zeros((len(v), max(len(widest), 1)), np.int64)
        for i, x in enumerate(v):
            for k, r in enumerate(widest):
                if r["at"] < len(x) and r["hi"] > r["lo"]:
                    share = (x[r["at"]] / 2 - r["lo"] / 2) / (r["hi"] / 2 - r["lo"] / 2)
                    cells[i, k] = min(int(share * (1 << bits)), (1 << bits) - 1)
        return pd.Series(hilbert(cells, bits))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while len(batch):
                part, batch = batch[:block_rows - n], batch[block_rows - n:]
                held.append(part)
                n += len(part)
                if n == block_rows:
                    yield one(number, held)
                    number, held, n = number + 1, [], 0
        if n:
            yield one(number, held)

    def one(number: int, held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held)
        x, labels = _small(_floored(rows["v"])), rows["label"].to_numpy(dtype=str)
        data = pack(ids=rows["id"].to_numpy(np.int64), labels=labels, x=x, anchor=rows["anchor"].to_numpy(bool))
        return pd.DataFrame({"block": [number], "lo": [x.min(axis=0).astype(float).tolist()], "hi": [x.max(axis=0).astype(float).tolist()],
                             "label_lo": [min(rows["label"])], "label_hi": [max(rows["label"])], "rows": [data]})

    placed = used.withColumn("key", key("v")).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    along = placed.repartitionByRange("key", "id", "salt").sortWithinPartitions("key", "id", "salt")
    return stored(along.select("id", "label", "anchor", "v").mapInPandas(
        cut, "block long, lo array<double>, hi array<double>, label_lo string, label_hi string, rows binary"), "hn-blocks")


def _rows_by_label(labels: np.ndarray) -> dict[str, np.ndarray]:
    names, inverse = np.unique(labels, return_inverse=True)
    return {str(name): np.flatnonzero(inverse == k) for k, name in enumerate(names)}


def anchor_groups(blocks: DataFrame, positives: int = 5, group_rows: int = 512) -> DataFrame:
    """``grp`` and ``anchors``: anchors along the curve, each with the score of
    its last positive within its own block (``kth``; the least there is without)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for data in batch["rows"]:
                b = unpack(data)
                at = np.flatnonzero(b["anchor"])
                if not len(at):
                    continue
                s, mine = scores(b["x"][at], b["x"]), _rows_by_label(b["labels"])
                kth = np.full(len(at), _LOW)
                for i, k in enumerate(at):
                    same = mine[str(b["labels"][k])]
                    near = s[i, same[b["ids"][same] != b["ids"][k]]]
                    if len(near) >= positives:
                        kth[i] = np.partition(near, -positives)[-positives]
                held.append({"ids": b["ids"][at], "labels": b["labels"][at], "x": b["x"][at], "kth": kth})
                n += len(at)
                if n >= group_rows:
                    yield group(number, held)
                    number, held, n = number + 1, [], 0
        if n:
            yield group(number, held)

    def group(number: int, held: list[dict[str, np.ndarray]]) -> pd.DataFrame:
        width = max(h["x"].shape[1] for h in held)
        x = np.concatenate([np.pad(h["x"], ((0, 0), (0, width - h["x"].shape[1]))) for h in held])
        rest = {k: np.concatenate([h[k] for h in held]) for k in ("ids", "labels", "kth")}
        return pd.DataFrame({"grp": [number], "anchors": [pack(x=x, **rest)]})

    return stored(blocks.select("rows").mapInPandas(of, "grp long, anchors binary"), "hn-anchors")


def wanted_blocks(groups: DataFrame, blocks: DataFrame, windows: bool) -> DataFrame:
    """(grp, block, upper): the blocks that bounds let a group's anchors need,
    for their positives or, with ``windows``, for their negatives."""
    chunks = max(1, -(-blocks.count() // CHUNK))
    zones = blocks.withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks))).groupBy("chunk").agg(
        F.collect_list(F.struct("block", "lo", "hi", "label_lo", "label_hi")).alias("zones"))
    pairs = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))).join(zones, "chunk")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for grp, data, zone in zip(batch["grp"], batch["anchors"], batch["zones"]):
                a = unpack(data)
                lo, hi = (_floored_rows([z[k] for z in zone]) for k in ("lo", "hi"))
                first, last = (np.array([z[k] for z in zone], dtype=str) for k in ("label_lo", "label_hi"))
                least, most = bounds(a["x"], lo, hi)
                label = a["labels"][:, None]
                if windows:
                    w = a["window"]  # rows: anchor, least score, largest score, positive, its score
                    need = (most[w[:, 0]] >= w[:, 1:2]) & (least[w[:, 0]] <= w[:, 2:3]) & (w[:, 1:2] <= w[:, 2:3])
                    need &= ((first != label) | (last != label))[w[:, 0]]
                    most = most[w[:, 0]]
                else:
                    need = (most >= a["kth"][:, None]) & (first <= label) & (label <= last)
                at = np.flatnonzero(need.any(axis=0))
                yield pd.DataFrame({"grp": np.full(len(at), grp), "block": [zone[k]["block"] for k in at],
                                    "upper": [float(max(most[need[:, k], k])) for k in at]})

    return pairs.select("grp", "anchors", "zones").mapInPandas(of, "grp long, block long, upper double")


def _floored_rows(rows: list) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows))))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _read(groups: DataFrame, blocks: DataFrame, wanted: DataFrame, search) -> DataFrame:
    """(grp, at, id, score) that ``search(anchors, blocks)`` finds in each cell."""
    cells = max(1, -(-blocks.count() // CELL))
    pairs = stored(wanted.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells))), "hn-pairs")
    work = pairs.join(blocks.select("block", "rows"), "block").groupBy("grp", "cell")
    owners = pairs.select(F.col("grp").alias("grp"), F.col("cell").alias("cell")).distinct().join(groups, "grp").groupBy("grp", "cell")

    def of(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a = unpack(right["anchors"].iloc[0])
        best = search(a, [unpack(d) for d in left.sort_values(["upper", "block"], ascending=[False, True])["rows"]])
        rows = [(key[0], i, vec_id, -score) for i, b in enumerate(best) for score, vec_id in b.found]
        return pd.DataFrame(rows, columns=["grp", "at", "id", "score"])

    return work.cogroup(owners).applyInPandas(of, "grp long, at int, id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("grp", "at").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives_of(groups: DataFrame, blocks: DataFrame, k: int = 5) -> DataFrame:
    """(grp, at, id, score, rank): the first ``k`` rows of the label of each anchor."""

    def search(a: dict, read: list[dict]) -> list[Best]:
        best = [Best(k) for _ in a["ids"]]
        for b, floor in zip(best, a["kth"].tolist()):
            b.kth = floor
        for block in read:
            s, mine = scores(a["x"], block["x"]), _rows_by_label(block["labels"])
            for i, label in enumerate(a["labels"]):
                same = mine.get(str(label))
                if same is not None:
                    best[i].take(s[i, same], block["ids"][same], a["ids"][i])
        return best

    return stored(_first(_read(groups, blocks, wanted_blocks(groups, blocks, windows=False), search), k), "hn-positives")


def with_windows(groups: DataFrame, positives: DataFrame, low: int = 30, high: int = 90) -> DataFrame:
    """``groups`` whose anchors have the score window of each of their positives."""

    def of(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = right.sort_values(["at", "rank"])
        window = [(i, -(-low * s // 100), high * s // 100, j, s)
                  for i, j, s in zip(found["at"].tolist(), found["id"].tolist(), found["score"].tolist())]
        return pd.DataFrame({"grp": [key[0]], "anchors": [pack(**unpack(left["anchors"].iloc[0]), window=np.array(window, np.int64))]})

    both = groups.join(positives.select("grp").distinct(), "grp", "left_semi").groupBy("grp").cogroup(positives.groupBy("grp"))
    return stored(both.applyInPandas(of, "grp long, anchors binary"), "hn-windows")


def negatives_of(groups: DataFrame, blocks: DataFrame, k: int = 10) -> DataFrame:
    """(grp, at, id, score, rank): the first ``k`` rows in each window ``at``."""

    def search(a: dict, read: list[dict]) -> list[Best]:
        best = [Best(k) for _ in a["window"]]
        for b, floor in zip(best, a["window"][:, 1].tolist()):
            b.kth = floor
        for block in read:
            s, mine = scores(a["x"], block["x"]), _rows_by_label(block["labels"])
            other = {label: np.setdiff1d(np.arange(len(block["ids"])), rows, assume_unique=True) for label, rows in mine.items()}
            everyone = np.arange(len(block["ids"]))
            for b, (i, _, most, _, _) in zip(best, a["window"].tolist()):
                rows = other.get(str(a["labels"][i]), everyone)
                here = s[i, rows]
                inside = here <= most
                b.take(here[inside], block["ids"][rows[inside]], a["ids"][i])
        return best

    return _first(_read(groups, blocks, wanted_blocks(groups, blocks, windows=True), search), k)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int = 2048,
         group_rows: int = 512) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) for the rows where ``anchor`` holds, against all rows."""
    blocks = block_table(vectors, anchor, id_col, vector_col, label_col, block_rows)
    groups = anchor_groups(blocks, positives, group_rows)
    groups = with_windows(groups, positives_of(groups, blocks, positives), low, high)
    found = negatives_of(groups, blocks, negatives)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for grp, data in zip(batch["grp"], batch["anchors"]):
                a = unpack(data)
                w = a["window"]
                yield pd.DataFrame({"grp": np.full(len(w), grp), "at": np.arange(len(w), dtype=np.int32), "anchor_id": a["ids"][w[:, 0]],
                                    "positive_id": w[:, 3], "positive_score": w[:, 4]})

    windows = groups.mapInPandas(named, "grp long, at int, anchor_id long, positive_id long, positive_score long")
    return stored(found.join(windows, ["grp", "at"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")),
        "hn-found")
