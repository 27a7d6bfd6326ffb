"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group and stay in one shard. The groups are too many for one task, so they are
packed in two steps:

* a group above ``total / (shards * PARTS)`` bytes is an item of its own; there are at most ``shards * PARTS``
  of them,
* all smaller groups are bundled by hash into ``shards * PARTS`` bundles, items that are never divided either.

At most ``2 * shards * PARTS`` items, a number that does not depend on the input, are sorted by decreasing size
and enter the open bin with the tightest remaining capacity, found in a balanced tree of (remaining, bin).
With a given ``capacity`` bins are opened as needed; with a given number of shards the smallest workable
capacity is approached, which makes sizes near equal (law ``bytes``). An item above an equal share of the bytes
takes a shard for itself, and the others share what remains.

Slots are numbered by counts per (shard, cell) and a row number inside a cell, so no task sorts a whole shard.

Defined results: a null text has no bytes; size is UTF-8 bytes plus ``ROW_BYTES``. Rows that repeat an id get
slots of their own. Equal sizes enter bins in the order of their item numbers; slots follow doc_id, null first, then CRC and size.
Texts are measured whole, however long. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import ROW, carried, stored, whole_text

ROW_BYTES = 16
#: Items per shard of either kind.
PARTS = 128
#: Cells of a shard for numbering its rows.
CELLS = 1024


class CapacityTree:
    """Balanced (AA) search tree of (remaining capacity, bin), for the tightest bin that still holds an item."""

    class Node:
        __slots__ = ("key", "level", "left", "right")

        def __init__(self, key):
            self.key, self.level, self.left, self.right = key, 1, None, None

    def __init__(self):
        self.root = None

    @staticmethod
    def _level(node) -> int:
        return node.level if node else 0

    def _skew(self, n):
        if n and n.left and n.left.level == n.level:
            top = n.left
            n.left, top.right = top.right, n
            return top
        return n

    def _split(self, n):
        if n and n.right and n.right.right and n.level == n.right.right.level:
            top = n.right
            n.right, top.left = top.left, n
            top.level += 1
            return top
        return n

    def add(self, key) -> None:
        def into(n):
            if n is None:
                return self.Node(key)
            if key < n.key:
                n.left = into(n.left)
            else:
                n.right = into(n.right)
            return self._split(self._skew(n))

        self.root = into(self.root)

    def remove(self, key) -> None:
        def out(n, key):
            if n is None:
                return None
            if key < n.key:
                n.left = out(n.left, key)
            elif key > n.key:
                n.right = out(n.right, key)
            elif n.left is None:
                return n.right
            else:
                heir = n.left
                while heir.right:
                    heir = heir.right
                n.key = heir.key
                n.left = out(n.left, heir.key)
            want = min(self._level(n.left), self._level(n.right)) + 1
            if want < n.level:
                n.level = want
                if n.right and want < n.right.level:
                    n.right.level = want
            n = self._skew(n)
            n.right = self._skew(n.right)
            if n.right:
                n.right.right = self._skew(n.right.right)
            n = self._split(n)
            n.right = self._split(n.right)
            return n

        self.root = out(self.root, key)

    def tightest(self, size: int):
        """The entry with the least remaining capacity of at least ``size``."""
        n, best = self.root, None
        while n:
            if n.key[0] >= size:
                best, n = n.key, n.left
            else:
                n = n.right
        return best


def best_fit_decreasing(sizes: list[int], capacity: int, bins: int | None = None) -> tuple[list[int | None], int]:
    """Bin of each item and the number of bins. With ``bins`` fixed, an item that fits nowhere gets None."""
    tree, placed, opened = CapacityTree(), [None] * len(sizes), 0
    if bins is not None:
        opened = bins
        for b in range(bins):
            tree.add((capacity, b))
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        entry = tree.tightest(size)
        if entry is None:
            if bins is not None:
                continue
            entry = (max(capacity, size), opened)
            opened += 1
        else:
            tree.remove(entry)
        placed[item] = entry[1]
        tree.add((entry[0] - size, entry[1]))
    return placed, opened


def even_bins(sizes: list[int], bins: int) -> list[int]:
    """Items in a fixed number of bins at the least capacity for which all find a place."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    where: list[int] = [0] * len(sizes)
    total, taken = sum(sizes), 0
    while order and taken < bins - 1 and sizes[order[0]] * (bins - taken) > total:
        where[order[0]] = taken
        total -= sizes[order[0]]
        taken += 1
        order = order[1:]
    rest, free = [sizes[i] for i in order], bins - taken
    capacity = max(math.ceil(total / free), max(rest, default=0))
    while True:
        placed, _ = best_fit_decreasing(rest, capacity, free)
        left = sum(s for s, b in zip(rest, placed, strict=True) if b is None)
        if not left:
            break
        capacity += max(1, math.ceil(left / free / 2), capacity // 20_000)
    for i, b in zip(order, placed, strict=True):
        where[i] = taken + b
    return where


def shard_rows(docs: DataFrame, shards: int | None = None, capacity: int | None = None, parts: int = PARTS) -> DataFrame:
    """Input rows as ``_row`` with doc_id, size, text_crc32, law, shard, slot and grown_shard.

    Give either the number of shards (sizes near equal) or the capacity of a shard (as few shards as best fit needs).
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    text = whole_text()
    rows = carried(
        docs,
        doc_id=F.col("doc_id"),
        size=(F.octet_length(text) + ROW_BYTES).cast("long"),
        text_crc32=F.crc32(text.cast("binary")),
        key=F.xxhash64(text),
    )
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    wanted = shards or max(1, math.ceil(total / capacity))
    least = max(1, total // (wanted * parts))
    bundle = F.pmod("key", F.lit(wanted * parts)).cast("int")
    large = [(r["key"], r["size"]) for r in groups.filter(F.col("size") > least).collect()]
    small = groups.filter(F.col("size") <= least).groupBy(bundle.alias("bundle")).agg(F.sum("size").alias("size")).collect()
    small = [(r["bundle"], r["size"]) for r in small]
    large.sort()
    small.sort()
    sizes = [s for _, s in large] + [s for _, s in small]
    bins = even_bins(sizes, shards) if shards else best_fit_decreasing(sizes, capacity)[0]
    spark = docs.sparkSession
    of_large = spark.createDataFrame([(k, b) for (k, _), b in zip(large, bins, strict=False)], "key long, large_shard int")
    of_small = spark.createDataFrame([(k, b) for (k, _), b in zip(small, bins[len(large) :], strict=True)], "bundle int, small_shard int")
    placed = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(of_large), "key", "left")
        .join(F.broadcast(of_small), "bundle", "left")
        .withColumn("shard", F.coalesce("large_shard", "small_shard"))
        .withColumn("cell", F.pmod(F.xxhash64("doc_id", "key"), F.lit(CELLS)).cast("int"))
    )
    return _numbered(placed).select(
        ROW, "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _numbered(placed: DataFrame) -> DataFrame:
    """``slot`` of each row, gapless in its shard. At most ``CELLS`` counts per shard meet in one window."""
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        placed.groupBy("shard", "cell")
        .agg(F.count("*").alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("place", F.row_number().over(inside) - 1)
        .join(cells, ["shard", "cell"])
        .withColumn("slot", (F.col("first") + F.col("place")).cast("long"))
    )
