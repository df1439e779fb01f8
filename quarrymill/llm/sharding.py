"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrymill.llm.common import materialize

LARGE_PER_SHARD = 1_024
CLASS_BITS = 9  # leading bits of a size that make its class: sizes of a class differ by less than 1/256, those under 512 not at all
PART_ROWS = 20_000


class Room:
    """A balanced search tree (a treap) of (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.root = None
        self.random = random.Random(7)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high

    def add(self, free: int, bin_: int) -> None:
        key = (free, bin_)
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, self.random.random(), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least room that still holds size."""
        node, best = self.root, None
        while node is not None:
            if node[0] >= (size, -1):
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is None:
            return None
        low, rest = self._split(self.root, best)
        _, high = self._split(rest, (best[0], best[1] + 1))
        self.root = self._join(low, high)
        return best


def best_fit_runs(runs: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """(run, bin, items) of best fit over runs (size, count) of equal items, sizes sorted down.

    The tightest bin that takes an item stays the tightest for its like until it holds no more, so a run fills bin after bin, and the result is
    that of item by item. An item over the capacity gets a bin of its own.
    """
    room, bins, out = Room(), 0, []
    for run, (size, count) in enumerate(runs):
        while count:
            if (found := room.take(size)) is None:
                found, bins = (capacity, bins), bins + 1
            n = max(1, min(count, found[0] // size))
            out.append((run, found[1], n))
            count -= n
            if found[0] > n * size:
                room.add(found[0] - n * size, found[1])
    return out


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item. sizes are sorted down; an item over the capacity gets a bin of its own."""
    return [bin_ for _, bin_, _ in best_fit_runs([(size, 1) for size in sizes], capacity)]


def pack(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(run, bin, items), bins under shards, for runs (size, count) sorted down: under the least capacity (found by bisection) for which best fit needs no more. An item over its fair share of what is left has a bin of its own, while there is another."""
    rest, items = sum(size * count for size, count in runs), sum(count for _, count in runs)
    alone: list[int] = []
    for run, (size, count) in enumerate(runs):
        while count and len(alone) < min(items, shards) - 1 and size * (shards - len(alone)) > rest:
            alone.append(run)
            rest -= size
            count -= 1
        if count:
            break
    if not items:
        return []
    shared, left = [(runs[run][0], count), *runs[run + 1 :]], shards - len(alone)
    low, high = max(shared[0][0], -(-rest // left)), shared[0][0] - (-2 * rest // left)
    best = best_fit_runs(shared, high)
    while high - low > max(0, high >> 13):
        middle = (low + high) // 2
        placed = best_fit_runs(shared, middle)
        if max(b for _, b, _ in placed) < left:
            best, high = placed, middle
        else:
            low = middle + 1
    return [*((r, b, 1) for b, r in enumerate(alone)), *((run + r, len(alone) + b, n) for r, b, n in best)]


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): law is `bytes`, so sizes per shard are near equal and grown_shard is null.

    Rows with equal texts form a group, which never splits and is an item of the packing. Groups with over 1/LARGE_PER_SHARD of a shard's bytes
    or rows (so a fixed number at any scale) stand for themselves. The others are runs of equal items: by the leading CLASS_BITS bits of their
    size, of which there are some thousands at most, each run's items counting by their mean size. So best fit sees every group, runs on the driver
    over a bounded list in sorted order, and gives each class a list of (items, shard); a group takes its shard by its number within its class,
    counted in small parts over the executors. A group larger than a shard gets a shard of its own and the others share the rest. Null texts form
    a group of size 1 a row, empty texts another. Repeated rows are rows of their own with slots of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = materialize(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("content"),
    ))
    groups = materialize(rows.groupBy("content").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    total, n_rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts_of = shards * LARGE_PER_SHARD
    is_large = (F.col("bytes") > max(1, total // parts_of)) | (F.col("n") > max(1, n_rows // parts_of))
    shift = F.greatest(F.length(F.bin("bytes")) - CLASS_BITS, F.lit(0))
    small = groups.where(~is_large).withColumn("shift", shift).select("content", "bytes", (F.col("shift") * (2 << CLASS_BITS) + F.expr("shiftright(bytes, shift)")).alias("class"))
    classes = small.groupBy("class").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()

    runs = [(r.bytes, 1, bytes(r.content)) for r in groups.where(is_large).collect()] + [(-(-r.bytes // r.n), r.n, r["class"]) for r in classes]
    runs.sort(key=lambda x: (-x[0], isinstance(x[2], int), x[2]))
    of_large, of_class = [], {}
    for run, shard, items in pack([(size, count) for size, count, _ in runs], shards):
        key = runs[run][2]
        if isinstance(key, bytes):
            of_large.append((bytearray(key), shard))
        else:
            ends, to = of_class.setdefault(key, ([], []))
            ends.append((ends[-1] if ends else 0) + items)
            to.append(shard)
    large_shards = F.broadcast(spark.createDataFrame(of_large, "content binary, shard int"))
    class_shards = spark.createDataFrame([(c, 1 + ends[-1] // PART_ROWS, ends, to) for c, (ends, to) in of_class.items()], "class long, parts long, ends array<long>, shards array<int>")

    dealt = small.join(F.broadcast(class_shards.select("class", "parts")), "class").select("content", "class", F.pmod(F.xxhash64("content"), F.col("parts")).alias("part"))
    numbered = _numbered(dealt, "class", F.col("content")).join(F.broadcast(class_shards), "class")
    small_shards = numbered.select("content", F.element_at("shards", F.size(F.filter("ends", lambda end: end <= F.col("at"))) + 1).alias("shard"))
    # Groups of many rows are all large, so no key of the second join is hot.
    put = rows.join(large_shards, "content").unionByName(rows.join(large_shards, "content", "left_anti").join(small_shards, "content"))
    put = put.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(1 + n_rows // PART_ROWS)).alias("part"))
    slots = _numbered(materialize(put), "shard", F.col("doc_id"), F.col("text_crc32"), F.col("size"))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("at").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _numbered(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    """rows with at: gapless from 0 within by, by part and then order. Rows are numbered within small parts, from where the parts before them end."""
    counts = rows.groupBy(by, "part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.withColumn("start", F.sum("n").over(Window.partitionBy(by).orderBy("part")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy(by, "part").orderBy(*order))
    return rows.withColumn("within", within).join(starts, [by, "part"]).withColumn("at", (F.col("start") + F.col("within") - 1).cast("long")).drop("start", "within")
