"""SimHash near-duplicates: fingerprints, a binary-trie self-join, components.

Two texts are linked when their 64-bit fingerprints differ in at most
``max_bits`` bits; a component is everything reachable over links.

1. ``with_fingerprint``: one narrow pass over the texts.
2. ``links``: distinct fingerprints only, so copies cost nothing. The bits are
   cut into ``m`` blocks. Two fingerprints within ``max_bits`` bits agree in at
   least ``m - max_bits`` blocks, so there is one binary trie per choice of
   that many leading blocks, and two linked fingerprints share the leading node
   of at least one trie. Below that node pairs of trie nodes go down together
   and add up differing bits; a pair is dropped beyond the budget. Node pairs
   that hold too many fingerprints for one task (``NODE_KEYS``) go on in Spark,
   a few bits at a time; the others go on as numpy ranges in a task, all pairs
   of a task at once. A task returns a spanning forest of what it linked, never
   the pairs of a group.
3. ``components``: alternating large-star and small-star rounds over the
   links, each a grouped minimum and a join, written to the shared folder.

Defined results for odd input: a null text counts as empty; a text without a
word has fingerprint zero and is linked like any other; a null id never names
a component (a component of null ids only has a null name); repeated rows give
repeated result rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logscope.llm.common import python_workers, spread_join, stored

BITS = 64
SEED = 42  # of XXH64, as in Spark's xxhash64()
#: Most fingerprints below a pair of trie nodes that one task takes on.
NODE_KEYS = 4096
#: Bits by which a larger pair goes down in one Spark step.
STEP = 4
#: Pairs of fingerprints compared, or node pairs held, at once in a task.
CHUNK = 1 << 18
_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """A signed 64-bit SimHash of the word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    set_bits = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        part = words[at:at + _BLOCK + shingle - 1]
        joined = b" ".join(part)
        sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes).tolist()
        ends = (ends[min(shingle, len(part)) - 1:] - 1).tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], dtype=">u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n).view(">i8")[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", shingle: int = 4, name: str = "fp") -> DataFrame:
    python_workers(df.sparkSession)

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return df.withColumn(name, of(F.col(text_col)))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ------------------------------------------------------------ node pairs


def block_count(n: int, max_bits: int) -> int:
    """Blocks to cut the bits into, so that leading nodes stay small."""
    m = max_bits + 1
    while m < 2 * max_bits and n >> (BITS * (m - max_bits) // m) > NODE_KEYS // 4:
        m += 1
    return m


def _orders(m: int, max_bits: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each choice of leading blocks: all blocks as (low bit, width) in
    their new order, and the leading width."""
    cuts = [BITS * i // m for i in range(m + 1)]
    blocks = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(m)]
    out = []
    for lead in combinations(range(m), m - max_bits):
        order = [blocks[i] for i in lead] + [b for i, b in enumerate(blocks) if i not in lead]
        out.append((order, sum(blocks[i][1] for i in lead)))
    return out


def _permuted(order: list[tuple[int, int]]) -> Column:
    key, shift = F.lit(0).cast("long"), BITS
    for low, width in order:
        shift -= width
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        key = key.bitwiseOR(F.shiftleft(part, shift))
    return key


def _prefix(depth) -> Column:
    return F.expr(f"shiftrightunsigned(key, {BITS} - {depth})")


PAIR = ["trie", "depth", "a", "b"]


def _node_pairs(keys: DataFrame, lead: dict[int, int], max_bits: int) -> list[DataFrame]:
    """Tasks: rows (trie, depth, a, b, err, side, key, fp) per light node pair.
    Leading nodes pair with themselves; heavy pairs split into child pairs."""
    depth_of = F.element_at(F.create_map(*[F.lit(x) for kv in lead.items() for x in kv]), F.col("trie"))
    keys = keys.withColumn("depth", depth_of).withColumn("node", _prefix("depth"))
    sizes = keys.groupBy("trie", "depth", "node").agg(F.count("*").alias("n")).where("n > 1")
    sizes = stored(sizes, "simhash-nodes")
    tasks = [keys.join(sizes.where(F.col("n") <= NODE_KEYS).drop("n"), ["trie", "depth", "node"])
             .select("trie", "depth", F.col("node").alias("a"), F.col("node").alias("b"),
                     F.lit(0).alias("err"), F.lit(0).alias("side"), "key", "fp")]
    heavy = sizes.where(F.col("n") > NODE_KEYS).select(
        "trie", "depth", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("err"))
    while not heavy.isEmpty():
        down = F.least(F.col("depth") + STEP, F.lit(BITS))
        nodes = heavy.select("trie", "depth", F.explode(F.array("a", "b")).alias("up")).distinct()
        below = (keys.select("trie", "key", "fp").join(nodes.select("trie", "depth").distinct(), "trie")
                 .withColumn("up", _prefix("depth")).join(nodes, ["trie", "depth", "up"])
                 .withColumn("down", down).withColumn("node", _prefix("down")))
        below = stored(below.select("trie", "depth", "up", "node", "key", "fp"), "simhash-below")
        child = below.groupBy("trie", "depth", "up", "node").agg(F.count("*").alias("n"))
        side = [child.select("trie", "depth", F.col("up").alias(x), F.col("node").alias(f"{x}{x}"), F.col("n").alias(f"n{x}"))
                for x in ("a", "b")]
        pairs = (heavy.join(side[0], ["trie", "depth", "a"]).join(side[1], ["trie", "depth", "b"])
                 .where((F.col("a") != F.col("b")) | (F.col("aa") <= F.col("bb")))
                 .withColumn("err", F.col("err") + F.bit_count(F.col("aa").bitwiseXOR(F.col("bb")).bitwiseAND(F.lit((1 << STEP) - 1))).cast("int"))
                 .where((F.col("err") <= max_bits) & ((F.col("aa") != F.col("bb")) | (F.col("na") > 1))))
        pairs = stored(pairs.select("trie", F.col("depth").alias("was"), down.alias("depth"), F.col("aa").alias("a"),
                                    F.col("bb").alias("b"), "err", "na", "nb"), "simhash-pairs")
        light = pairs.where(F.col("na") + F.col("nb") <= 2 * NODE_KEYS)
        for s, x in enumerate(("a", "b")):
            mine = light if s == 0 else light.where(F.col("a") != F.col("b"))
            tasks.append(mine.withColumn("node", F.col(x)).drop("na", "nb").join(
                below.withColumnRenamed("depth", "was").drop("up"), ["trie", "was", "node"])
                .select(*PAIR, "err", F.lit(s).alias("side"), "key", "fp"))
        heavy = pairs.where(F.col("na") + F.col("nb") > 2 * NODE_KEYS).select("trie", "depth", "a", "b", "err")
    return tasks


# ------------------------------------------------------------ inside a task


def _merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union by smallest index, in place."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _compare(keys: np.ndarray, alo, ahi, blo, bhi, max_bits: int, parent: np.ndarray) -> None:
    """Link all (i, j) of small range pairs within the budget."""
    wide = (ahi - alo) * (bhi - blo)
    at = 0
    while at < len(wide):
        to = max(at + 1, int(np.searchsorted(np.cumsum(wide[at:]), CHUNK)) + at)
        n = wide[at:to]
        own = np.repeat(np.arange(at, to), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = (bhi - blo)[own]
        i, j = alo[own] + k // width, blo[own] + k % width
        near = np.bitwise_count(keys[i] ^ keys[j]) <= max_bits
        _merge(parent, i[near], j[near])
        at = to


def _descend(keys: np.ndarray, pairs: np.ndarray, max_bits: int, parent: np.ndarray, bit: int = 0) -> None:
    """``pairs``: rows (a low, a high, b low, b high, differing bits) of ranges
    of ``keys``, whose members share their bits above ``bit``."""
    while len(pairs):
        if len(pairs) > CHUNK:
            for part in np.array_split(pairs, -(-len(pairs) // (CHUNK // 4))):
                _descend(keys, part, max_bits, parent, bit)
            return
        alo, ahi, blo, bhi, err = pairs.T
        small = ((ahi - alo) * (bhi - blo) <= 32) | (bit >= BITS)
        _compare(keys, alo[small], ahi[small], blo[small], bhi[small], max_bits, parent)
        alo, ahi, blo, bhi, err = pairs[~small].T
        if not len(alo):
            return
        one = np.uint64(1 << (BITS - 1 - bit))
        amid = _split(keys, alo, ahi, one)
        bmid = _split(keys, blo, bhi, one)
        same = alo == blo
        children = [np.stack(x, axis=1) for x in (
            (alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err),
            (alo, amid, bmid, bhi, err + 1))]
        children.append(np.stack((amid, ahi, blo, bmid, err + 1), axis=1)[~same])
        pairs = np.concatenate(children)
        a, b = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        pairs = pairs[(a > 0) & (b > 0) & (pairs[:, 4] <= max_bits) & ((pairs[:, 0] != pairs[:, 2]) | (a > 1))]
        bit += 1


def _split(keys, lo, hi, one):
    """First index of each range whose key has the bit ``one``. Ranges of one
    batch may repeat key values, so the search runs inside each range."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        right = open_ & ((keys[np.minimum(mid, len(keys) - 1)] & one) == 0)
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)


def _linked(batch: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """Edges (fp, smaller-index fp) of a forest over whole tasks of a batch."""
    if not len(batch):
        return pd.DataFrame({"u": np.empty(0, np.int64), "v": np.empty(0, np.int64)})
    keys = batch["key"].to_numpy(np.int64).view(np.uint64)
    fps = batch["fp"].to_numpy(np.int64)
    cols = [batch[c].to_numpy() for c in PAIR]
    side = batch["side"].to_numpy()
    new_task = np.ones(len(batch), bool)
    new_task[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    start = np.flatnonzero(new_task)
    end = np.append(start[1:], len(batch))
    first_b = start + np.add.reduceat((side == 0).astype(np.int64), start)
    own = cols[2][start] == cols[3][start]
    blo, ahi = np.where(own, start, first_b), np.where(own, end, first_b)
    err = batch["err"].to_numpy(np.int64)[start]
    pairs = np.stack((start, ahi, blo, end, err), axis=1)
    parent = np.arange(len(batch))
    for depth in np.unique(cols[1][start]):
        _descend(keys, pairs[cols[1][start] == depth], max_bits, parent, int(depth))
    moved = np.flatnonzero(parent != np.arange(len(batch)))
    return pd.DataFrame({"u": fps[moved], "v": fps[parent[moved]]})


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges (u, v) over distinct ``fp`` that connect exactly what fingerprint
    pairs within ``max_bits`` bits connect."""
    python_workers(fps.sparkSession)
    orders = _orders(block_count(fps.count(), max_bits), max_bits)
    copies = F.array(*[F.struct(F.lit(t).alias("trie"), _permuted(o).alias("key")) for t, (o, _) in enumerate(orders)])
    keys = fps.select("fp", F.explode(copies).alias("x")).select("x.trie", "x.key", "fp")
    tasks = _node_pairs(keys, {t: lead for t, (_, lead) in enumerate(orders)}, max_bits)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = np.logical_and.reduce([(rest[c] == rest[c].iloc[-1]).to_numpy() for c in PAIR]) if len(rest) else np.zeros(0, bool)
            if not last.all():
                yield _linked(rest[~last].reset_index(drop=True), max_bits)
                rest = rest[last].reset_index(drop=True)
        if rest is not None:
            yield _linked(rest, max_bits)

    out = None
    for task in tasks:
        out = task if out is None else out.unionByName(task)
    ordered = out.repartition(*PAIR).sortWithinPartitions(*PAIR, "side", "key")
    return ordered.mapInPandas(join, "u long, v long").distinct()


# ------------------------------------------------------------ components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): the smallest node of
    its component. Alternating large-star and small-star until nothing moves. A hub's
    edges stay spread over tasks (``spread_join``)."""
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == now or not now["n"]:
            break
        state = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "large-least")
        large = spread_join(both.where("v > u"), least, "u", "n", 2 * now["n"]).select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large-star")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "small-least")
        small = spread_join(large, least, "u", "n", large.count()).where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = 4) -> DataFrame:
    """One row per document: id, ``fp`` and ``component_id``, the smallest id
    reachable over links."""
    rows = stored(with_fingerprint(docs.select(id_col, text_col), text_col, shingle).select(id_col, "fp"), "simhash")
    classes = stored(rows.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count("*").alias("n")), "simhash-classes")
    member = components(links(classes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    member = stored(member, "simhash-members")
    named = classes.join(member, "fp").groupBy("root").agg(F.min("least_id").alias("named"))
    named = member.join(named, "root").select("fp", "named")
    ids = stored(classes.join(named, "fp", "left").select(
        "fp", "n", F.coalesce("named", "least_id").alias("component_id")), "simhash-ids")
    return spread_join(rows, ids, "fp", "n", rows.count()).select(id_col, "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                max_bits: int = 4) -> DataFrame:
    """One row of ``docs`` per component: that of the smallest id (nulls last),
    then of the smallest row hash; equal rows are one."""
    names = docs.columns
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).alias("_id"),
                         F.col(text_col).alias("_text"),
                         F.xxhash64(*[F.col(f"`{c}`") for c in names]).alias("_hash"))
    rows = stored(with_fingerprint(hashed.select("_id", "_hash", "_text"), "_text", shingle).select("_id", "_hash", "fp"), "simhash")
    rank = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))
    classes = rows.groupBy("fp").agg(F.min(rank).alias("first"))
    member = components(links(rows.select("fp").distinct(), max_bits))
    firsts = classes.join(member.withColumnRenamed("node", "fp"), "fp", "left").groupBy(
        F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    stay = stored(firsts.select(F.col("first.id").alias("s_id"), F.col("first.hash").alias("s_hash")), "simhash-stay")
    kept = hashed.join(stay, (F.col("_hash") == F.col("s_hash")) & F.col("_id").eqNullSafe(F.col("s_id")), "left_semi")
    return kept.dropDuplicates(["_hash", "_id"]).select("_row.*")
