"""Sharding by best-fit-decreasing bin packing; the law is ``bytes``.

Rows with equal texts are one indivisible group, packed into the bin with the
tightest room that holds it, the largest groups first; bins are ordered by room in
a balanced tree. Only a group larger than a shard is split, by a hash of its row
numbers, into parts of about 1/``PARTS`` of a shard: no fixed capacity could hold it.

Best fit runs over size classes with multiplicities, at every scale: a class holds the
groups whose sizes agree within 1/``GRAIN`` of an octave (about 1 %), and equal items go
into a bin, or into many bins of equal room, in one step. So some 64 x 40 classes and
the steps that they take reach the driver, however many groups or bins there are. The
groups of a class are then numbered (range sort, counts per partition, prefix sums)
and the steps say which numbers go to which bin. A class counts with its mean size, or
with its largest where a capacity is given and must not be passed.

Texts are read once, for size, checksum and hash. What is shuffled and joined has no
text. Groups that hold at least 1/``HEAVY`` of all rows, of which there are at most
``HEAVY``, join by broadcast, so a group's copies stay spread over tasks. Slots number the
rows of a shard without a gap: counts per (shard, hash bucket of the row number) give
each bucket its start, and rows are numbered inside buckets of bounded size.

Defined results for odd input: a null text has no bytes and checksum 0 and is
equal to the empty text; null ids and repeated rows get slots of their own, and count
as rows of their own where a group is split; other columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscope.llm.common import stored

#: Parts of a shard's capacity that a split group falls into.
PARTS = 8
#: Size classes of an octave.
GRAIN = 64
#: Groups with at least this part of all rows are joined by broadcast.
HEAVY = 4096


class RoomTree:
    """Bins ordered by (room, bin) in an AA tree: insert, delete and the
    tightest fit take O(log n)."""

    def __init__(self):
        self.root = None  # node: [key, level, left, right]

    @staticmethod
    def _skew(t):
        if t and t[2] and t[2][1] == t[1]:
            left = t[2]
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[3] and t[3][3] and t[1] == t[3][3][1]:
            right = t[3]
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def insert(self, key):
        def go(t):
            if t is None:
                return [key, 1, None, None]
            side = 2 if key < t[0] else 3
            t[side] = go(t[side])
            return self._split(self._skew(t))
        self.root = go(self.root)

    def delete(self, key):
        def go(t, key):
            if t is None:
                return None
            if key < t[0]:
                t[2] = go(t[2], key)
            elif t[0] < key:
                t[3] = go(t[3], key)
            elif t[2] is None and t[3] is None:
                return None
            elif t[2] is None:
                s = t[3]
                while s[2]:
                    s = s[2]
                t[0] = s[0]
                t[3] = go(t[3], s[0])
            else:
                s = t[2]
                while s[3]:
                    s = s[3]
                t[0] = s[0]
                t[2] = go(t[2], s[0])
            low = min(t[2][1] if t[2] else 0, t[3][1] if t[3] else 0) + 1
            if low < t[1]:
                t[1] = low
                if t[3] and low < t[3][1]:
                    t[3][1] = low
            t = self._skew(t)
            t[3] = self._skew(t[3])
            if t[3]:
                t[3][3] = self._skew(t[3][3])
            t = self._split(t)
            t[3] = self._split(t[3])
            return t
        self.root = go(self.root, key)

    def tightest(self, size):
        """The least (room, bin) with room >= size, or None."""
        t, best = self.root, None
        while t:
            if t[0][0] >= size:
                best, t = t[0], t[2]
            else:
                t = t[3]
        return best

    def roomiest(self):
        t = self.root
        while t and t[3]:
            t = t[3]
        return t[0] if t else None


def pack(classes: Iterable[tuple[float, int]], capacity: float, max_bins: int | None = None) -> tuple[list[list[tuple[int, int, int]]], int]:
    """Best fit of classes (size, how many), which come by falling size. Per class the
    steps (number, bin, each): items from that number on fill bins from that bin on,
    ``each`` to a bin, up to the next step; and how many bins there are. A new bin opens when nothing
    fits; with ``max_bins`` open the roomiest bin takes an item more."""
    tree, out, bins = RoomTree(), [], 0  # of (room, first bin, number of bins with that room)
    for size, count in classes:
        steps, done = [], 0
        while done < count:
            left = count - done
            at = tree.tightest(size)
            if at is None and (max_bins is None or bins < max_bins):
                new = 1 if max_bins is not None or not size else -(-left // max(1, int(capacity // size)))
                at = (capacity, bins, new)
                bins += new
            else:
                at = at or tree.roomiest()
                tree.delete(at)
            room, first, n = at
            each = max(1, int(room // size)) if size else left
            full = min(n, left // each)
            if full:
                steps.append((done, first, each))
                tree.insert((room - each * size, first, full))
            done += full * each
            if full < n and done < count:
                steps.append((done, first + full, count - done))
                tree.insert((room - (count - done) * size, first + full, 1))
                done, full = count, full + 1
            if full < n:
                tree.insert((room, first + full, n - full))
        out.append(steps)
    return out, bins


def best_fit(items: Iterable[tuple[int, object]], capacity: int, max_bins: int | None = None) -> dict[object, int]:
    """item -> bin for (size, item), largest first, ties by item: classes of one item."""
    ordered = sorted(items, key=lambda x: (-x[0], x[1]))
    steps, _ = pack([(size, 1) for size, _ in ordered], capacity, max_bins)
    return {item: step[0][1] for (_, item), step in zip(ordered, steps)}


def _numbered(items: DataFrame) -> DataFrame:
    """``items`` with their number within their class, in the order of a range sort."""
    along = items.repartitionByRange("cls", "group", "part").sortWithinPartitions("cls", "group", "part")
    kept = stored(along.withColumn("at", F.monotonically_increasing_id()), "shard-items")
    kept = kept.withColumn("task", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    ahead = Window.partitionBy("cls").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("cls", "task").agg(F.count("*").alias("n_items"), F.min("at").alias("low")).select(
        "cls", "task", (F.coalesce(F.sum("n_items").over(ahead), F.lit(0)) - F.col("low")).alias("shift"))
    # a sorted task holds a range of classes: at most tasks + classes rows
    return kept.join(F.broadcast(starts), ["cls", "task"]).withColumn("number", F.col("at") + F.col("shift")).drop("at", "task", "shift")


def shards(docs: DataFrame, n_shards: int | None = 24, capacity: int | None = None, id_col: str = "doc_id",
           text_col: str = "text", bucket_rows: int = 20_000) -> DataFrame:
    """Per row: id, ``size``, ``text_crc32``, ``shard``, ``slot``. Give ``n_shards``
    for near-equal shards, or only ``capacity`` for as few as best fit needs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stored(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"),
        F.monotonically_increasing_id().alias("row")), "shard-rows")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    room = capacity or max(1, -(-total // n_shards))

    too_large = rows.groupBy("group").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > room).select(
        "group", F.ceil(F.col("bytes") / (room / PARTS)).cast("int").alias("parts"))
    if capacity is None:  # fewer than n_shards groups are larger than a shard
        too_large = F.broadcast(too_large)
    rows = rows.join(too_large, "group", "left").withColumn("part", F.when(
        F.col("parts").isNotNull(), F.pmod(F.xxhash64("row", F.lit("part")), F.col("parts"))).otherwise(F.lit(0)).cast("int")).drop("parts")
    items = _numbered(rows.groupBy("group", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).withColumn(
        "cls", F.floor(F.log2("bytes") * GRAIN).cast("int")))

    size = F.max("bytes") if capacity else F.avg("bytes")
    classes = items.groupBy("cls").agg(size.alias("size"), F.count("*").alias("n")).orderBy(F.col("cls").desc()).collect()  # some GRAIN * 40
    steps, bins = pack([(r["size"], r["n"]) for r in classes], room, None if n_shards is None else n_shards)
    table = [(r["cls"], sorted(s)) for r, s in zip(classes, steps)]
    runs = spark.createDataFrame(table, "cls int, steps array<struct<number: long, bin: int, each: long>>")
    step = F.element_at(F.filter("steps", lambda s: s["number"] <= F.col("number")), -1)
    placed = items.join(F.broadcast(runs), "cls").withColumn("s", step).select("group", "part", "n", (
        F.col("s.bin") + F.floor((F.col("number") - F.col("s.number")) / F.col("s.each"))).cast("int").alias("shard"))
    placed = stored(placed, "shard-placed")

    heavy = F.broadcast(placed.where(F.col("n") * HEAVY >= n).select("group", "part", "shard"))  # at most HEAVY rows
    light = placed.where(F.col("n") * HEAVY < n).select("group", "part", "shard")
    put = rows.join(heavy, ["group", "part"]).unionByName(
        rows.join(heavy.drop("shard"), ["group", "part"], "left_anti").join(light, ["group", "part"]))

    buckets = max(1, n // (bucket_rows * max(bins, 1)) + 1)
    put = stored(put.select("id", "size", "text_crc32", "shard", "row",
                            F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket")), "shard-put")
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = put.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size", "row")
    return put.join(starts, ["shard", "bucket"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard",
        (F.col("start") + F.row_number().over(inside) - 1).alias("slot"))
