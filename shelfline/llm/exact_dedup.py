"""Exact dedup by an extendible-hash index on shared files.

The index maps the 64-bit hash of a text to the chain of different texts with that hash. A directory of
``2 ** depth`` slots, addressed by the leading bits of the hash, points to buckets. A bucket that holds more
keys than its capacity is split by one more bit; if its slots don't tell the halves apart, the directory
doubles first. The directory is grown from a histogram of distinct keys, so a text repeated by a third of all
rows is one key. Beyond ``MAX_DEPTH`` bits a bucket is left overfull, nothing is lost: its owner streams the keys.

Each owner task has a range of consecutive buckets, that is a range of keys, with about ``OWNER_BYTES`` of text
(more where 65,536 slots are not enough), and writes the index file of that range. Scanning tasks combine equal
texts of an Arrow batch first, so a text met by a third of all rows comes to its owner once a batch. The owner meets
its entries in key order and compares bytes along the chain of a key; it holds one chain at a time. Input rows find
their entry by bucket, key and digest within the chain. Groups of more than 1/1,024 of all rows, fewer than 1,024 by
that bound, are looked up by a broadcast, so no task gathers their rows.

Defined results: a null text is the empty text. Of equal texts the row with the largest doc_id stays; a null
doc_id is smaller than any other. Rows that repeat both id and text stay or go together. Texts are compared whole,
however long; a batch of texts has to fit in a task. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import ROW, carried, stored, whole_text

#: Most bits of a directory: at most 65,536 slots are kept by the driver and sent to tasks.
MAX_DEPTH = 16
BUCKET_KEYS = 512
#: Text of the keys an owner task gets, as far as the directory can tell them apart.
OWNER_BYTES = 8 << 20
#: Rows of an Arrow batch that an owner turns into Python values at a time.
STEP = 64
#: Groups of more than one of this many parts of all rows are looked up by a broadcast; fewer than this many exist.
HOT_PARTS = 1024

CHAIN_SCHEMA = "bucket int, key long, chain int, text_sha256 string, group_size long, keep_id long"


class Directory:
    """Slots of an extendible hash table over a histogram of key prefixes of ``MAX_DEPTH`` bits."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.depth = 0
        self.slots = [0]
        self.local = [0]
        self._prefixes = sorted(histogram)
        self._below = [0, *accumulate(histogram[p] for p in self._prefixes)]
        first_slot = [0]
        waiting = [0]
        while waiting:
            bucket = waiting.pop()
            if self.local[bucket] == MAX_DEPTH or self._keys(bucket, first_slot[bucket]) <= capacity:
                continue
            if self.local[bucket] == self.depth:
                self._double()
                first_slot = [2 * s for s in first_slot]
            half = 1 << (self.depth - self.local[bucket] - 1)
            start = first_slot[bucket] + half
            new = len(self.local)
            self.slots[start : start + half] = [new] * half
            self.local[bucket] += 1
            self.local.append(self.local[bucket])
            first_slot.append(start)
            waiting += [bucket, new]

    def _double(self) -> None:
        self.slots = [b for b in self.slots for _ in (0, 1)]
        self.depth += 1

    def _keys(self, bucket: int, slot: int) -> int:
        """Keys in a bucket, from the range of prefixes that its slots cover."""
        width = MAX_DEPTH - self.depth
        span = 1 << (self.depth - self.local[bucket])
        at = lambda s: self._below[bisect_left(self._prefixes, s << width)]
        return at(slot + span) - at(slot)


def _slot(key: str, depth: int):
    """Leading bits of a key."""
    return F.shiftrightunsigned(F.col(key), 64 - depth).cast("int") if depth else F.lit(0)


class Placement(NamedTuple):
    """The directory, the owner of each of its buckets, and the number of rows it was made for."""

    directory: Directory
    owners: list[int]
    rows: int


def grow_directory(keys: DataFrame, capacity: int = BUCKET_KEYS, owner_bytes: int = OWNER_BYTES) -> Placement:
    """Directory and owners for distinct keys (key, n rows, bytes); at most 65,536 counts reach the driver."""
    parts = (
        keys.groupBy(_slot("key", MAX_DEPTH).alias("prefix"))
        .agg(F.count("*").alias("keys"), F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"))
        .collect()
    )
    directory = Directory({r["prefix"]: r["keys"] for r in parts}, capacity)
    size = [0] * len(directory.local)
    for r in parts:
        size[directory.slots[r["prefix"] >> (MAX_DEPTH - directory.depth)]] += r["bytes"]
    owners, owner, held = [0] * len(size), 0, 0
    for bucket in dict.fromkeys(directory.slots):  # buckets in the order of their keys
        if held and held + size[bucket] > owner_bytes:
            owner, held = owner + 1, 0
        owners[bucket] = owner
        held += size[bucket]
    return Placement(directory, owners, sum(r["rows"] for r in parts))


def with_bucket(df: DataFrame, placement: Placement) -> DataFrame:
    """``bucket`` and ``owner`` of each key; the broadcast directory has at most 65,536 slots."""
    directory, owners, _ = placement
    slots = df.sparkSession.createDataFrame(
        [(slot, bucket, owners[bucket]) for slot, bucket in enumerate(directory.slots)], "slot int, bucket int, owner int"
    )
    return df.withColumn("slot", _slot("key", directory.depth)).join(F.broadcast(slots), "slot").drop("slot")


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a batch as one entry; columns key, text, doc_id."""
    for batch in batches:
        groups = pa.Table.from_batches([batch]).group_by(["key", "text"], use_threads=False)
        made = groups.aggregate([([], "count_all"), ("doc_id", "max")])
        yield from made.select(["key", "text", "count_all", "doc_id_max"]).rename_columns(["key", "text", "size", "keep"]).to_batches()


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of the keys of an owner's buckets; rows come in key order, one chain is held at a time."""
    current, chain = None, []

    def closed(rows):
        for place, (text, size, keep) in enumerate(chain):
            bucket, key = current
            rows.append((bucket, key, place, hashlib.sha256(text).hexdigest(), size, keep))

    for batch in batches:
        rows: list[tuple] = []
        parts = (batch.slice(start, STEP) for start in range(0, batch.num_rows, STEP))
        for bucket, key, text, size, keep in (r for part in parts for r in zip(*(c.to_pylist() for c in part.columns), strict=True)):
            if (bucket, key) != current:
                closed(rows)
                current, chain = (bucket, key), []
            for entry in chain:
                if entry[0] == text:
                    entry[1] += size
                    entry[2] = max((k for k in (entry[2], keep) if k is not None), default=None)
                    break
            else:
                chain.append([text, size, keep])
        yield _batch(rows)
    rows = []
    if current is not None:
        closed(rows)
    yield _batch(rows)


_CHAIN_ARROW = pa.schema(
    [("bucket", pa.int32()), ("key", pa.int64()), ("chain", pa.int32()), ("text_sha256", pa.string()), ("group_size", pa.int64()), ("keep_id", pa.int64())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_CHAIN_ARROW)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _CHAIN_ARROW.types, strict=True)], schema=_CHAIN_ARROW)


def build_index(keyed: DataFrame, capacity: int = BUCKET_KEYS) -> tuple[DataFrame, Placement]:
    """The index over rows (doc_id, text, key), one row per different text, and its placement."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).cast("long").alias("bytes"))
    placement = grow_directory(sizes, capacity)
    entries = keyed.select("key", F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(
        _combine, "key long, text binary, size long, keep long"
    )
    owned = (
        with_bucket(entries, placement)
        .repartitionById(max(placement.owners) + 1, F.col("owner"))
        .select("bucket", "key", "text", "size", "keep")
        .sortWithinPartitions("bucket", "key")
    )
    return stored(owned.mapInArrow(_chain, CHAIN_SCHEMA), "hash-index"), placement


def mark_copies(docs: DataFrame, capacity: int = BUCKET_KEYS) -> DataFrame:
    """Input rows as ``_row`` with text_sha256, keep_id, group_size and kept."""
    rows = carried(docs, doc_id=F.col("doc_id"), text=whole_text(), key=F.xxhash64(whole_text()))
    index, placement = build_index(rows.select("doc_id", "text", "key"), capacity)
    entry = ["bucket", "key", "text_sha256"]
    large = F.col("group_size") > placement.rows // HOT_PARTS
    chains = index.filter("group_size > 1")
    hot = chains.filter(large).select(*entry, F.col("group_size").alias("_size"), F.col("keep_id").alias("_keep"))
    cold = chains.filter(~large).select("bucket", F.col("key").alias("_find"), "text_sha256", "group_size", "keep_id")
    found = (
        with_bucket(rows.withColumn("text_sha256", F.sha2(F.col("text"), 256)), placement)
        .join(F.broadcast(hot), entry, "left")
        # rows that are answered already are spread; their entry is not among the others
        .withColumn("_find", F.when(F.col("_size").isNull(), F.col("key")).otherwise(F.xxhash64("doc_id")))
        .join(cold, ["bucket", "_find", "text_sha256"], "left")
        .withColumn("size", F.coalesce("_size", "group_size", F.lit(1)).cast("long"))
    )
    single = F.col("size") == 1
    keep = F.when(single, F.col("doc_id")).when(F.col("_size").isNotNull(), F.col("_keep")).otherwise(F.col("keep_id"))
    return found.select(
        ROW,
        "doc_id",
        keep.alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, capacity: int = BUCKET_KEYS) -> DataFrame:
    """The rows that stay, with their columns."""
    return mark_copies(docs, capacity).filter("kept").select(f"{ROW}.*")
