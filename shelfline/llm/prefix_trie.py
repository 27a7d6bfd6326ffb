"""Prefix trie of conversations by range minima over sorted common prefixes.

A turn is named by 128 bits of the SHA-256 of its role and text, a conversation by the names of its turns one after
another. Conversations are sorted by that key over range partitions; copies are combined on the way into pieces of a
few hundred ids, so a conversation copied a million times reaches its partition as a few thousand rows. Inside a
partition the lengths of the prefixes that neighbours share go into a sparse table of range minima. Every candidate
prefix, one for each depth at which a row leaves its predecessor, then searches the left and right end of its
members on its own, by halving steps through the table; no stack and no order between candidates. Members, leaves
and bytes are differences of running sums between the two ends, the smallest id is a range minimum, and children are
the neighbours inside that share exactly the prefix.

A prefix of the first or last row of a partition may go on in the next one. Its part is written under the digest of
the prefix, together with what neighbouring partitions counted twice, and the parts are summed: at most two rows per
partition and depth. Digests of lists of ids are streamed from the sorted pieces, which is sequential for one list.

Defined results: a null role or text is empty. Turns are ordered by number, null first, equal numbers by role and
then by digest, so repeated rows are turns of their own. Rows without conv_id belong to no conversation and are left
out. A turnless conversation is a member of the root alone. Texts may have any length, they never leave the first
pass; one conversation is one row of 24 bytes a turn from there on. Other columns are not read. An empty table has
no conversation and therefore no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import stored

#: Bytes that name a turn.
NAME = 16
#: Turns and conversations of a range partition, about 10 MB of keys.
RANGE_TURNS = 200_000
#: Copies of a conversation that travel as one row.
PIECE_IDS = 512
NO_ENDS = hashlib.sha256(b"").hexdigest()

_PIECE = "key binary, sizes array<long>, first_conv long, n long, ids binary"
_NODE = (
    "kind string, depth long, edge binary, parent_edge binary, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, part int, sizes array<long>"
)
_SHARED = "depth long, edge binary, n_children long, n_leaves long, saved_tokens long"
_RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations_by_turn(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id`` and its ``turns`` in order, an array of (name, bytes)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, F.lit(":"), text), 256)
    turn = F.struct(
        F.col("turn").alias("turn"), role.alias("role"), name.alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    return (
        turns.filter(F.col("conv_id").isNotNull())
        .select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("turn")).alias("turns"))
        .select(
            "conv_id",
            F.transform("turns", lambda t: F.struct(F.left(t["digest"], F.lit(2 * NAME)).alias("name"), t["bytes"].alias("bytes"))).alias("turns"),
        )
    )


def rebuilt(convs: DataFrame, every: int, heads: int) -> DataFrame:
    """Conversation c opens with the first h turns of conversation c - c % every, then its own after h; h = crc32(c) % heads."""
    base = convs.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, heads).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    opening = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), F.col("_h"))
    own = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return (
        convs.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % every, "_h": h})
        .join(base, "_base", "left")
        .select("conv_id", F.concat(opening, own).alias("turns"))
    )


def prefix_nodes(convs: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of ``convs`` (conv_id, turns), one row per distinct prefix."""
    keyed = stored(
        convs.select(
            "conv_id",
            F.unhex(F.array_join(F.transform("turns", lambda t: t["name"]), "")).alias("key"),
            F.transform("turns", lambda t: t["bytes"]).alias("sizes"),
        ),
        "conversation-keys",
    )
    total = keyed.agg((F.sum(F.size("sizes")) + F.count("*")).alias("n")).first().n or 0
    parts = 1 + total // RANGE_TURNS
    pieces = (
        keyed.select("key", "conv_id", "sizes")
        .repartitionByRange(parts, "key", "conv_id")
        .sortWithinPartitions("key", "conv_id")
        .mapInArrow(_pieces, _PIECE)
    )
    found = stored(
        pieces.repartitionByRange(parts, "key").sortWithinPartitions("key", "first_conv").mapInArrow(_nodes, _NODE), "trie-nodes"
    )
    node = F.col("kind") == "node"
    ends = Window.orderBy("part")
    shared = (
        found.filter(~node)
        .select(F.col("parent_edge").alias("last"), F.lead("edge").over(ends).alias("next"), "sizes")
        .filter(F.col("next").isNotNull())
        .mapInArrow(_counted_twice, _SHARED)
    )
    merged = stored(
        found.filter(node & F.col("edge").isNotNull())
        .unionByName(shared, allowMissingColumns=True)
        .groupBy("edge")
        .agg(
            F.max("depth").alias("depth"),
            F.max("parent_edge").alias("parent_edge"),
            F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.max("ends_sha256").alias("ends_sha256"),
        ),
        "trie-edges",
    )
    inner = found.filter(node & F.col("edge").isNull())
    columns = [c for c in _RESULT if c != "parent_conv_id"]
    hanging = inner.filter(F.col("parent_edge").isNotNull()).select("parent_edge", *columns).unionByName(merged.select("parent_edge", *columns))
    parents = merged.select(F.col("edge").alias("parent_edge"), F.col("conv_id").alias("parent_conv_id"))
    whole = inner.filter(F.col("parent_edge").isNull()).select(*_RESULT)
    return whole.unionByName(hanging.join(parents, "parent_edge", "left").select(*_RESULT)).withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))
    )


def conversation_trie(turns: DataFrame, every: int, heads: int) -> DataFrame:
    """Trie of the conversations in ``turns`` (conv_id, turn, role, text), each rebuilt on the opening of another."""
    return prefix_nodes(rebuilt(conversations_by_turn(turns), every, heads))


# ---- inside tasks


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batch(rows: list[tuple], types, names) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id, sizes) as rows of up to ``PIECE_IDS`` ids of one key."""
    types = (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary())
    names = ["key", "sizes", "first_conv", "n", "ids"]
    out: list[tuple] = []
    key, sizes, ids = None, [], []

    def piece() -> tuple:
        return key, sizes, ids[0], len(ids), ",".join(map(str, ids)).encode()

    for k, conv, s in _rows(batches):
        if ids and (k != key or len(ids) == PIECE_IDS):
            out.append(piece())
            ids = []
            if len(out) == 4096:
                yield _batch(out, types, names)
                out = []
        key, sizes = k, s
        ids.append(conv)
    if ids:
        out.append(piece())
    yield _batch(out, types, names)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the partition's sorted conversations, and one border row with its first and last key."""
    keys, sizes, first, copies, digests = [], [], [], [], []
    for key, s, conv, n, ids in _rows(batches):
        if keys and keys[-1] == key:
            copies[-1] += n
            digests[-1].update(b"," + ids)
        else:
            if digests:
                digests[-1] = digests[-1].hexdigest()
            keys.append(key)
            sizes.append(s)
            first.append(conv)
            copies.append(n)
            digests.append(hashlib.sha256(ids))
    if not keys:
        return
    digests[-1] = digests[-1].hexdigest()
    schema = pa.schema(
        [("kind", pa.string()), ("depth", pa.int64()), ("edge", pa.binary()), ("parent_edge", pa.binary())]
        + [(c, pa.int64()) for c in ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
        + [("ends_sha256", pa.string()), ("part", pa.int32()), ("sizes", pa.list_(pa.int64()))]
    )
    table = trie_of_sorted(keys, sizes, np.array(first), np.array(copies), digests)
    n = len(table["depth"])
    nothing = {f.name: pa.nulls(n, f.type) for f in schema}
    yield pa.record_batch(list((nothing | table | {"kind": pa.array(["node"] * n)}).values()), schema=schema)
    border = {f.name: pa.nulls(1, f.type) for f in schema} | {
        "kind": pa.array(["border"]),
        "edge": pa.array([keys[0]], pa.binary()),
        "parent_edge": pa.array([keys[-1]], pa.binary()),
        "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
        "sizes": pa.array([sizes[-1]], pa.list_(pa.int64())),
    }
    yield pa.record_batch(list(border.values()), schema=schema)


class RangeMinimum:
    """Sparse table: row k holds the minima of all runs of 2^k values."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 * (step := 1 << (len(self.rows) - 1)) <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Minima of the values from left to right, both included."""
        level = np.frexp(right - left + 1)[1] - 1
        out = np.empty(len(left), self.rows[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.rows[k][left[at]], self.rows[k][right[at] - (1 << k) + 1])
        return out

    def last_at_least(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Largest end such that all values from start + 1 to it are at least the bound."""
        at = start.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row, onward = self.rows[k], at + (1 << k)
            fits = onward < len(self.rows[0])
            fits[fits] = row[at[fits] + 1] >= bound[fits]
            at[fits] = onward[fits]
        return at

    def first_at_least(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Smallest begin such that all values from it + 1 to start are at least the bound."""
        at = start.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row, back = self.rows[k], at - (1 << k)
            fits = back >= 0
            fits[fits] = row[back[fits] + 1] >= bound[fits]
            at[fits] = back[fits]
        return at


def shared_lengths(names: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Turns that each row shares with the row before it; -1 for the first."""
    common = np.minimum(length[1:], length[:-1])
    row = np.repeat(np.arange(1, len(length)), common)
    depth = np.arange(len(row)) - np.repeat(np.cumsum(common) - common, common)
    differ = (names[start[row - 1] + depth] != names[start[row] + depth]).any(axis=1)
    out = np.concatenate([[-1], common])
    np.minimum.at(out, row[differ], depth[differ])
    return out


def trie_of_sorted(keys: list[bytes], sizes: list[list[int]], first: np.ndarray, copies: np.ndarray, digests: list[str]) -> dict:
    """Columns of the nodes of sorted, distinct keys; ``edge`` and ``parent_edge`` mark those that touch the first or last row."""
    n = len(keys)
    length = np.array([len(k) // NAME for k in keys])
    start = np.cumsum(length) - length
    names = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    shared = shared_lengths(names, start, length)
    near = RangeMinimum(shared)
    ids = RangeMinimum(first)

    # Running sums over rows: conversations, leaves, bytes of all members, bytes of nodes that begin in the row.
    sums = np.concatenate([[0], np.cumsum([b for s in sizes for b in s])]).astype(np.int64)
    bytes_to = lambda row, depth: sums[start[row] + np.maximum(depth, 0)] - sums[start[row]]
    every = np.arange(n)
    whole = bytes_to(every, length)
    running = lambda x: np.concatenate([[0], np.cumsum(x)])
    members, member_bytes = running(copies), running(copies * whole)
    new_bytes = running(whole - bytes_to(every, shared))
    leaves = running(np.concatenate([shared[1:], [-1]]) < length)

    # A candidate per row and depth at which it leaves its predecessor.
    fresh = length - shared
    row = np.repeat(every, fresh)
    at = np.arange(len(row))
    begin = np.cumsum(fresh) - fresh
    depth = at - begin[row] + shared[row] + 1
    left, right = near.first_at_least(row, depth), near.last_at_least(row, depth)
    n_convs = members[right + 1] - members[left]
    above = bytes_to(row, depth - 1)
    in_members = member_bytes[right + 1] - member_bytes[left] - n_convs * above
    in_nodes = new_bytes[right + 1] - new_bytes[left + 1] + whole[row] - above
    order = np.sort(shared * (n + 1) + every)
    between = np.searchsorted(order, depth * (n + 1) + right, "right") - np.searchsorted(order, depth * (n + 1) + left, "right")
    ends_here = length[row] == depth
    conv = ids.of(left, right)

    # The parent is the same row's shorter candidate, or the prefix shared with the row before.
    branch_left, branch_right = near.first_at_least(every, shared), near.last_at_least(every, shared)
    opens = at == begin[row]
    parent_left = np.where(opens, branch_left[row], np.roll(left, 1))
    parent_right = np.where(opens, branch_right[row], np.roll(right, 1))
    has_parent = depth > 0
    parent_conv = ids.of(parent_left, parent_right)
    edge = (left == 0) | (right == n - 1)
    parent_edge = has_parent & ((parent_left == 0) | (parent_right == n - 1))

    def digest(chosen: np.ndarray, less: int) -> pa.Array:
        out: list[bytes | None] = [None] * len(row)
        for k in np.flatnonzero(chosen):
            out[k] = hashlib.sha256(keys[row[k]][: NAME * (depth[k] - less)]).digest()
        return pa.array(out, pa.binary())

    return {
        "depth": pa.array(depth, pa.int64()),
        "edge": digest(edge, 0),
        "parent_edge": digest(parent_edge, 1),
        "conv_id": pa.array(conv, pa.int64()),
        "parent_conv_id": pa.array(parent_conv, pa.int64(), mask=parent_edge | ~has_parent),
        "n_convs": pa.array(n_convs, pa.int64()),
        "n_children": pa.array(between + ~ends_here, pa.int64()),
        "n_leaves": pa.array(leaves[right + 1] - leaves[left], pa.int64()),
        "saved_tokens": pa.array(in_members - in_nodes, pa.int64()),
        "ends_sha256": pa.array([digests[r] if e else None for r, e in zip(row, ends_here, strict=True)], pa.string()),
    }


def _counted_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For neighbouring partitions (last key, next first key): what their common prefixes have too much or too little."""
    types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    for batch in batches:
        out: list[tuple] = []
        for last, following, sizes in _rows(iter([batch])):
            common = 0
            while common < min(len(last), len(following)) // NAME and last[: NAME * (common + 1)] == following[: NAME * (common + 1)]:
                common += 1
            total = sum(sizes[:common])
            above = 0
            for d in range(common + 1):
                out.append((d, hashlib.sha256(last[: NAME * d]).digest(), -(d < common), -(common == len(last) // NAME), total - above))
                above += sizes[d - 1] if d else 0
        yield _batch(out, types, ["depth", "edge", "n_children", "n_leaves", "saved_tokens"])
