"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints come from one pass over the texts; different fingerprints, not documents, are compared. Two
fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` disjoint blocks of bits (with 64 bits
and a radius of 2: three blocks), so they meet in a group keyed by a block's value. A group above ``GROUP_ROWS``
is keyed anew by the blocks of the remaining bits, again without losing a pair.

Inside a group an index is built: fingerprints sorted by Gray rank, so neighbours share bits; ``FANOUT``
consecutive ones form a node that keeps the bits on which all its members agree (mask and pattern), and nodes form
upper nodes in the same way; a node stores only what its parent doesn't. A search goes down with the difference
accumulated so far and leaves a whole group of fingerprints as soon as that exceeds the radius. Linked
fingerprints are united inside the task and leave as a star, at most one edge per member, never as all pairs.
Stars of all groups are joined to components by label propagation with pointer jumping over written tables.

``drop_near_copies`` looks for a similarity of shingle sets. Wide fingerprints of the sets, within a large radius and
keyed by random bit subsets, only propose pairs (with the chance ``wide_recall``): a link is a pair whose sets have that Jaccard
similarity exactly. A pair is proposed in the first band it shares. A group with over ``PAIRS_A_ROW`` pairs a member
first proposes neighbours in Gray order and pairs of its most central member within half the radius, mostly sure links. After those are compared, the groups
that still hold several components are dealt out with one shingle set per member: a task compares its pairs of
different components, unites them as soon as a pair is similar and leaves at most one edge per component.

Fingerprint of a text: A-Z lower-cased, words between ASCII white space, shingles of ``words`` words joined by a
space and counted as often as they occur (fewer words: the whole sequence), XXH64 with seed 42; a bit is 1 if it
is set in over half of the hashes. Further 64-bit parts of wide fingerprints mix that hash.

Defined results: a null text, or one without a word, has fingerprint zero and is linked like any other. A null
doc_id takes part, but only ids become component ids (a component without any id has none). Rows that repeat id
and text get the same row. All shingles of a text count, however long it is. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import stored, whole_text

SEED = 42
FANOUT = 16
#: Groups above this many fingerprints are divided.
GROUP_ROWS = 20_000
#: Shingle sets of a group that a task holds; groups above are compared in pairs of blocks.
GROUP_BYTES = 64_000_000
#: Groups up to this many rows are compared by shifts over a whole batch, without a tree.
SMALL_GROUP = 24
PAIRS_AT_ONCE = 2_000_000
#: Groups with more pairs than that a member propose some of them first, the rest after those are compared.
PAIRS_A_ROW = 8
#: Neighbours in Gray order such a group proposes first.
NEIGHBOURS = 4

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_COLUMN = (np.arange(8) * 256)[None, :]


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)


def _mixed(h: np.ndarray, part: int) -> np.ndarray:
    """Hashes of a further 64-bit part (SplitMix64 finaliser)."""
    if not part:
        return h
    z = h + np.uint64((part * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: bytes, words: int = 3, bits: int = 64) -> bytes:
    """Big-endian fingerprint of ``bits`` bits."""
    return _print_of(shingle_hashes(text, words), bits)


def _print_of(h: np.ndarray, bits: int) -> bytes:
    out = b""
    for part in range(bits // 64):
        if not len(h):
            out += bytes(8)
            continue
        rows = _mixed(h, part).astype(">u8").view(np.uint8).reshape(-1, 8)
        counts = np.bincount((rows + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
        out += np.packbits((2 * counts > len(h)).ravel()).tobytes()
    return out


def _fingerprints(words: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, words, bits) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(prints, pa.binary())], names=["doc_id", "row_key", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64) -> DataFrame:
    """(doc_id, row_key, fp) per row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("row_key"), whole_text().cast("binary"))
    return rows.mapInArrow(_fingerprints(words, bits), "doc_id long, row_key long, fp binary")


def _words_of(prints: list[bytes]) -> np.ndarray:
    """Fingerprints as rows of 64-bit words, most significant first."""
    return np.frombuffer(b"".join(prints), ">u8").reshape(len(prints), -1).astype(np.uint64)


def gray_rank(rows: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the Gray sequence: bit i is the parity of the bits from the top to i."""
    out, carry = rows.copy(), np.zeros(len(rows), np.uint64)
    for w in range(rows.shape[1]):
        x = out[:, w]
        for shift in (1, 2, 4, 8, 16, 32):
            x = x ^ (x >> np.uint64(shift))
        out[:, w] = x ^ (np.uint64(0) - carry)
        carry = out[:, w] & np.uint64(1)
    return out


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class GrayIndex:
    """Hierarchical index over fingerprints in Gray order; ``levels`` run from the leaves' parents up to the root nodes."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        ones, zeros = rows, ~rows
        while len(ones) > 1:
            at = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, at, axis=0), np.bitwise_and.reduceat(zeros, at, axis=0)
            self.levels.append((ones | zeros, ones))
        for low, high in zip(self.levels, self.levels[1:], strict=False):
            # what the parent has already compared isn't compared again
            mask, pattern = low
            above = np.repeat(high[0], FANOUT, axis=0)[: len(mask)]
            mask &= ~above
            pattern &= mask

    def pairs(self, radius: int, asked: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, of members within the radius, in bounded batches.

        With ``asked``: pairs of an asked member i and any other member j.
        """
        if not self.levels:
            return
        step = max(1, PAIRS_AT_ONCE // (8 * FANOUT * max(1, len(self.levels[-1][0]))))
        members, ordered = (np.arange(len(self.rows)), True) if asked is None else (asked, False)
        for begin in range(0, len(members), step):
            queries = members[begin : begin + step]
            nodes = np.arange(len(self.levels[-1][0]))
            yield from self._descend(np.repeat(queries, len(nodes)), np.tile(nodes, len(queries)), len(self.levels) - 1, None, radius, ordered)

    def _descend(self, q, node, level, spent, radius, ordered):
        if len(q) > PAIRS_AT_ONCE:
            half = len(q) // 2
            for part in (slice(None, half), slice(half, None)):
                yield from self._descend(q[part], node[part], level, None if spent is None else spent[part], radius, ordered)
            return
        mask, pattern = self.levels[level]
        cost = np.bitwise_count((self.rows[q] & mask[node]) ^ pattern[node]).sum(axis=1, dtype=np.int64)
        spent = cost if spent is None else spent + cost
        near = spent <= radius
        # a node whose members all come before the query has had its turn
        if ordered:
            near &= (node + 1) * FANOUT ** (level + 1) > q
        q, node, spent = q[near], node[near], spent[near]
        child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        q, spent = np.repeat(q, FANOUT), np.repeat(spent, FANOUT)
        if level:
            there = child < len(self.levels[level - 1][0])
            yield from self._descend(q[there], child[there], level - 1, spent[there], radius, ordered)
            return
        there = (child < len(self.rows)) & ((child > q) if ordered else (child != q))
        q, child = q[there], child[there]
        near = _distance(self.rows[q], self.rows[child]) <= radius
        yield q[near], child[near]


class Union:
    """Components of numbered rows; labels are kept flat."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        apart = a != b
        if not apart.any():
            return
        edges = np.unique(np.stack([np.minimum(a, b)[apart], np.maximum(a, b)[apart]]), axis=1)
        parent: dict[int, int] = {}

        def root(x):
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for x, y in edges.T.tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        to = np.arange(len(self.label))
        for x in parent:
            to[x] = root(x)
        self.label = to[self.label]


def _linked(groups: np.ndarray, rows: np.ndarray, radius: int) -> np.ndarray:
    """Component label of each row; ``groups`` are sorted numbers of groups."""
    union = Union(len(rows))
    size = np.bincount(groups) if len(groups) else np.empty(0, int)
    for shift in range(1, SMALL_GROUP):
        if shift >= len(rows):
            break
        i = np.flatnonzero((groups[shift:] == groups[:-shift]) & (size[groups[shift:]] <= SMALL_GROUP))
        if not len(i):
            break
        near = _distance(rows[i], rows[i + shift]) <= radius
        union.join(i[near], i[near] + shift)
    first = np.concatenate([[0], np.cumsum(size)]).astype(int)
    for g in np.flatnonzero(size > SMALL_GROUP):
        a, b = first[g], first[g + 1]
        for i, j in GrayIndex(rows[a:b]).pairs(radius):
            union.join(i + a, j + a)
    return union.label


def _stars(radius: int):
    """Edges (fingerprint, root) of each group of a sorted partition; whole groups are held, at most a batch besides."""

    def edges(keys, prints):
        names = ["a", "b"]
        if not prints:
            return pa.record_batch([pa.array([], pa.binary())] * 2, names=names)
        groups = _group_numbers(keys)
        rows = _words_of(prints)
        rank = gray_rank(rows)
        order = np.lexsort((*rank.T[::-1], groups))
        label = _linked(groups[order], rows[order], radius)
        moved = np.flatnonzero(label != np.arange(len(label)))
        take = lambda at: pa.array([prints[k] for k in order[at]], pa.binary())
        return pa.record_batch([take(moved), take(label[moved])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = [], []
        for batch in batches:
            keys += batch.column(0).to_pylist()
            prints += batch.column(1).to_pylist()
            cut = len(keys)
            while cut and keys[cut - 1] == keys[-1]:
                cut -= 1
            if cut >= 20_000:
                yield edges(keys[:cut], prints[:cut])
                keys, prints = keys[cut:], prints[cut:]
        yield edges(keys, prints)

    return run


def _group_numbers(keys: list[int]) -> np.ndarray:
    """Numbers of runs of equal keys in a sorted list."""
    at = np.array(keys, np.int64)
    return np.concatenate([[0], np.cumsum(at[1:] != at[:-1])])


def _blocks(bits: tuple[int, ...], parts: int) -> list[tuple[int, ...]]:
    """Bit places divided into ``parts`` blocks of near-equal size."""
    return [bits[len(bits) * k // parts : len(bits) * (k + 1) // parts] for k in range(parts)]


def _mask(bits: tuple[int, ...], width: int) -> bytes:
    return sum(1 << (width - 1 - b) for b in bits).to_bytes(width // 8, "big")


def _keys(masks: list[bytes]):
    """A row per mask: key = number of the mask and the fingerprint's bits under it. What follows the bits is carried."""
    words, size = _words_of(masks), len(masks[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                prints = batch.column(0).slice(at, 4096)
                rows = _words_of([x[:size] for x in prints.to_pylist()])
                keys = []
                for m, mask in enumerate(words):
                    masked = (rows & mask).astype(">u8")
                    digest = [xxhash.xxh64_intdigest(x.tobytes(), m) for x in masked]
                    keys.append(np.array(digest, np.uint64).view(np.int64))
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(np.arange(len(words), dtype=np.int32), len(rows))),
                        pa.array(np.concatenate(keys)),
                        pa.concat_arrays([prints] * len(words)),
                    ],
                    names=["mask", "key", "fp"],
                )

    return run


def _grouped_edges(rows: DataFrame, radius: int) -> DataFrame:
    """Star edges of groups (key, fp)."""
    return rows.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp").mapInArrow(_stars(radius), "a binary, b binary")


def block_edges(nodes: DataFrame, radius: int, width: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links of all pairs within the radius, as stars per group. Exact: groups too large are keyed by further bits."""
    masks = _blocks(tuple(range(width)), radius + 1)
    rest, found = nodes.select("fp"), None
    while True:
        keyed = rest.mapInArrow(_keys([_mask(m, width) for m in masks]), "mask int, key long, fp binary")
        keyed = stored(keyed, "simhash-keys")
        large = keyed.groupBy("mask", "key").count().filter(F.col("count") > group_rows).drop("count")
        final = all(len(m) >= width - radius - 1 for m in masks)
        small = keyed if final else keyed.join(large, ["mask", "key"], "left_anti")
        edges = _grouped_edges(small, radius)
        found = edges if found is None else found.unionByName(edges)
        if final or large.isEmpty():
            return found
        left = stored(keyed.join(large, ["mask", "key"], "left_semi"), "simhash-large")
        used = {r["mask"] for r in left.select("mask").distinct().collect()}  # at most as many as masks
        masks = [
            tuple(sorted((*m, *part)))
            for k, m in enumerate(masks)
            if k in used
            for part in _blocks(tuple(b for b in range(width) if b not in m), radius + 1)
        ]
        rest = left.select("fp").distinct()


def wide_bands(width: int, bands: int, band_bits: int, seed: int = SEED) -> list[tuple[int, ...]]:
    """Random subsets of bits, fixed by the seed."""
    rng = np.random.default_rng(seed)
    return [tuple(sorted(rng.choice(width, band_bits, replace=False).tolist())) for _ in range(bands)]


def wide_recall(similarity: float, width: int, radius: int, bands: int, band_bits: int) -> float:
    """Chance that texts of a shingle-set similarity (Jaccard) are within the radius and share a band.

    Bits differ independently with angle / pi; places that differ leave a band alone if it has none of them.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi

    def met(d: int) -> float:
        return 1 - (1 - math.comb(width - d, band_bits) / math.comb(width, band_bits)) ** bands

    return sum(math.comb(width, d) * p**d * (1 - p) ** (width - d) * met(d) for d in range(radius + 1))


def radius_for(similarity: float, width: int) -> int:
    """Differing bits expected at a shingle-set similarity, plus three standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(width * p + 3 * math.sqrt(width * p * (1 - p)))


def _first_met(rows: np.ndarray, i: np.ndarray, j: np.ndarray, band: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether pairs met in group of band ``band`` share no earlier band."""
    apart = rows[i] ^ rows[j]
    first = np.ones(len(i), bool)
    for m in range(int(band.max(initial=0))):
        first &= (band <= m) | (apart & masks[m]).any(axis=1)
    return first


def _bounded(rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours in Gray order and pairs of the most central member, within the radius (a part of the search radius: sure pairs)."""
    n = len(rows)
    i = [np.arange(n - shift) for shift in range(1, NEIGHBOURS + 1)]
    j = [x + shift for shift, x in enumerate(i, 1)]
    bits = np.unpackbits(rows.astype(">u8").view(np.uint8), axis=1)
    most = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > n).view(">u8").astype(np.uint64)
    centre = int(_distance(rows, most[None, :]).argmin())
    others = np.delete(np.arange(n), centre)
    i, j = np.concatenate([*i, np.full(n - 1, centre)]), np.concatenate([*j, others])
    near = _distance(rows[i], rows[j]) <= radius
    return i[near], j[near]


def _proposed(groups: np.ndarray, rows: np.ndarray, radius: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs within the radius by sorted group; True for a group that left some out."""
    size = np.bincount(groups) if len(groups) else np.empty(0, int)
    for shift in range(1, SMALL_GROUP):
        if shift >= len(rows):
            break
        i = np.flatnonzero((groups[shift:] == groups[:-shift]) & (size[groups[shift:]] <= SMALL_GROUP))
        if not len(i):
            break
        near = _distance(rows[i], rows[i + shift]) <= radius
        yield i[near], i[near] + shift, False
    first = np.concatenate([[0], np.cumsum(size)]).astype(int)
    for g in np.flatnonzero(size > SMALL_GROUP):
        a, b = first[g], first[g + 1]
        found, count, part = [], 0, False
        for i, j in GrayIndex(rows[a:b]).pairs(radius):
            found.append((i, j))
            count += len(i)
            if part := count > most * size[g]:
                found = [_bounded(rows[a:b], radius // 2)]
                break
        for i, j in found:
            yield i + a, j + a, part
        if part:
            yield np.arange(a, b), np.arange(a, b), part


def _candidates(radius: int, masks: list[bytes]):
    """Pairs (a, b) of a partition sorted by key, or (a, null, mask, key) for members of groups that left pairs out."""
    words, most = _words_of(masks), PAIRS_A_ROW
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("mask", pa.int32()), ("key", pa.int64())])

    def candidates(band, keys, nodes):
        if not nodes:
            return
        groups = _group_numbers(keys)
        rows = _words_of([x[: len(masks[0])] for x in nodes])
        order = np.lexsort((*gray_rank(rows).T[::-1], groups))
        groups, rows, band, key = groups[order], rows[order], np.array(band, np.int32)[order], np.array(keys, np.int64)[order]
        named = np.array(nodes, object)[order]
        for i, j, _ in _proposed(groups, rows, radius, most):
            left = i == j
            at = i[left]
            met = _first_met(rows, i, j, band[i], words) & ~left
            i, j = i[met], j[met]
            for begin in range(0, len(i), 50_000):
                a, b = named[i[begin : begin + 50_000]], named[j[begin : begin + 50_000]]
                none = pa.nulls(len(a))
                a, b = np.minimum(a, b), np.maximum(a, b)
                yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary()), none.cast(pa.int32()), none.cast(pa.int64())], schema=schema)
            if len(at):
                yield pa.record_batch([pa.array(named[at], pa.binary()), pa.nulls(len(at), pa.binary()), pa.array(band[at]), pa.array(key[at])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]
        for batch in batches:
            for k, column in enumerate(batch.columns):
                held[k] += column.to_pylist()
            keys = held[1]
            cut = len(keys)
            while cut and keys[cut - 1] == keys[-1]:
                cut -= 1
            if cut >= 20_000:
                yield from candidates(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        yield from candidates(*held)

    return run


def _alike(x: np.ndarray, y: np.ndarray, least: Fraction) -> bool:
    """Whether two sets have at least the similarity; sets of too different sizes are not compared."""
    if min(len(x), len(y)) * least.denominator < least.numerator * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common * least.denominator >= least.numerator * (len(x) + len(y) - common)


def _similar(similarity: float):
    """Pairs whose sets have the similarity."""
    least = Fraction(str(similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                alike.append(_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least))
            yield batch.select([0, 1]).filter(pa.array(alike, pa.bool_()))

    return run


def _links_between(radius: int, masks: list[bytes], similarity: float):
    """Edges between labels of each group, from rows (key, mask, node, label, shingles) sorted by group.

    Pairs of different labels are compared inside the task and labels that turn out linked are united at once, so a
    group leaves fewer edges than it has labels, however many of its pairs are near.
    """
    words, least = _words_of(masks), Fraction(str(similarity))
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def links(band: int, nodes: list[bytes], labels: list[int], sets: list[bytes]) -> pa.RecordBatch:
        out: list[tuple[bytes, bytes]] = []
        rows = _words_of([x[: len(masks[0])] for x in nodes])
        order = np.lexsort(gray_rank(rows).T[::-1])
        rows, named = rows[order], [nodes[k] for k in order]
        held = [np.frombuffer(sets[k], np.uint64) for k in order]
        counts = np.unique(np.array(labels)[order], return_inverse=True, return_counts=True)
        label, parent = counts[1], list(range(len(counts[0])))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        few = label != counts[2].argmax()
        size = np.array([len(x) for x in held], np.int64)
        for i, j in GrayIndex(rows).pairs(radius, np.flatnonzero(few)):
            new = (label[i] != label[j]) & (~few[j] | (i < j))
            new &= np.minimum(size[i], size[j]) * least.denominator >= least.numerator * np.maximum(size[i], size[j])
            i, j = i[new], j[new]
            met = _first_met(rows, i, j, np.full(len(i), band), words)
            for x, y in zip(i[met].tolist(), j[met].tolist(), strict=True):
                p, q = root(int(label[x])), root(int(label[y]))
                if p != q and _alike(held[x], held[y], least):
                    parent[p] = q
                    out.append((min(named[x], named[y]), max(named[x], named[y])))
        return pa.record_batch([pa.array([e[k] for e in out], pa.binary()) for k in range(2)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, band, held = None, 0, ([], [], [])
        for batch in batches:
            for key, mask, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != group:
                    if len(set(held[1])) > 1:
                        yield links(band, *held)
                    group, band, held = key, mask, ([], [], [])
                for part, value in zip(held, row, strict=True):
                    part.append(value)
        if len(set(held[1])) > 1:
            yield links(band, *held)

    return run


def _shingle_sets(words: int):
    """(node, set) of (node, text); a text with the row key of another is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.unique(shingle_hashes(text.as_py(), words)).tobytes()
                if node.endswith(xxhash.xxh64_digest(h, SEED)):
                    nodes.append(node)
                    sets.append(h)
            yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _set_nodes(words: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = []
            for text in batch.column(2):
                h = np.unique(shingle_hashes(text.as_py(), words))
                nodes.append(_print_of(h, bits) + xxhash.xxh64_digest(h.tobytes(), SEED))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(nodes, pa.binary())], names=["doc_id", "row_key", "node"])

    return run


def _keyed_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("row_key"), whole_text().cast("binary").alias("text"))


def shingle_sets(used: DataFrame, docs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of some nodes, one set each, stored."""
    held = rows.join(used, "node", "left_semi").groupBy("node").agg(F.min("row_key").alias("row_key"))
    texts = _keyed_rows(docs).join(held, "row_key").select("node", "text")
    sets = texts.mapInArrow(_shingle_sets(words), "node binary, shingles binary").groupBy("node").agg(F.min("shingles").alias("shingles"))
    return stored(sets, "shingle-sets")


def similar_pairs(pairs: DataFrame, docs: DataFrame, rows: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have the similarity."""
    sets = shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, rows, words)
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
    return both.mapInArrow(_similar(similarity), "a binary, b binary")


def links_between(members: DataFrame, sets: DataFrame, radius: int, masks: list[bytes], similarity: float) -> DataFrame:
    """Edges that connect the labels of each group (mask, key, node, label) wherever two members have the similarity.

    Only groups with two labels or more go on. A group whose sets take over ``GROUP_BYTES`` is compared in pairs of
    blocks, so a task holds the sets of one block pair.
    """
    open_ = members.groupBy("mask", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    sized = members.join(open_.select("mask", "key"), ["mask", "key"], "left_semi").join(sets, "node")
    sized = stored(sized.select("mask", "key", "node", "label", "shingles"), "simhash-open")
    parts = F.ceil(F.sum(F.length("shingles") + 100) / GROUP_BYTES).cast("int")
    total = sized.groupBy("mask", "key").agg(parts.alias("parts")).filter("parts > 1")
    own = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).otherwise(0)
    other = F.when(F.col("parts").isNotNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))
    split = sized.join(total, ["mask", "key"], "left").withColumn("own", own).withColumn("other", F.explode(other))
    block = F.xxhash64("mask", "key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = split.select(block.alias("block"), "mask", "node", "label", "shingles").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(_links_between(radius, masks, similarity), "a binary, b binary")


def band_edges(nodes: DataFrame, radius: int, width: int, bands: int, band_bits: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Candidates (a, b, mask, key) of nodes that share a band: pairs, and open members as in ``_candidates``.

    A group too large is compared in pairs of its blocks.
    """
    masks = [_mask(b, width) for b in wide_bands(width, bands, band_bits)]
    keyed = nodes.select("node").mapInArrow(_keys(masks), "mask int, key long, node binary")
    large = keyed.groupBy("key").count().filter(F.col("count") > group_rows)
    parts = F.ceil(F.col("count") / group_rows).cast("int")
    sized = keyed.join(stored(large.select("key", parts.alias("parts")), "simhash-large"), "key", "left")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.when(F.col("parts").isNotNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))
    split = sized.withColumn("own", own).withColumn("other", F.explode(other))
    block = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rows = split.select("mask", F.when(F.col("parts").isNull(), F.col("key")).otherwise(block).alias("key"), "node")
    return _grouped_candidates(rows, radius, masks)


def _grouped_candidates(rows: DataFrame, radius: int, masks: list[bytes]) -> DataFrame:
    """Candidates of groups (mask, key, node)."""
    held = rows.repartition("key").sortWithinPartitions("key")
    return held.mapInArrow(_candidates(radius, masks), "a binary, b binary, mask int, key long")


def similar_edges(
    nodes: DataFrame, docs: DataFrame, rows: DataFrame, similarity: float, words: int, width: int, bands: int, band_bits: int
) -> DataFrame:
    """Edges (a, b) between nodes whose shingle sets have the similarity, enough of them to connect all that are proposed."""
    radius = radius_for(similarity, width)
    found = stored(band_edges(nodes, radius, width, bands, band_bits), "simhash-candidates")
    pairs = found.filter("b IS NOT NULL").select("a", "b").distinct()
    edges = stored(similar_pairs(pairs, docs, rows, similarity, words), "similar")
    unsettled = found.filter("b IS NULL").select("mask", "key", F.col("a").alias("node")).distinct()
    if unsettled.isEmpty():
        return edges
    labels = components(edges).select(F.col("fp").alias("node"), F.xxhash64("label").alias("label"))
    labelled = unsettled.join(labels, "node", "left").select("mask", "key", "node", F.coalesce("label", F.xxhash64("node")).alias("label"))
    masks = [_mask(b, width) for b in wide_bands(width, bands, band_bits)]
    sets = shingle_sets(unsettled.select("node").distinct(), docs, rows, words)
    return edges.unionByName(stored(links_between(labelled, sets, radius, masks, similarity), "simhash-others").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(fp, label) of every fingerprint with an edge: the smallest fingerprint of its component."""
    pairs = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "fp"), "labels")
    while True:
        hop = pairs.join(labels.withColumnRenamed("fp", "b"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("label").alias("near"))
        hopped = labels.join(hop, "fp").select("fp", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("fp").alias("label"), F.col("label").alias("beyond"))
        moved = stored(hopped.join(jump, "label").select("fp", F.least("label", "beyond").alias("label"), "old"), "labels")
        labels = moved.select("fp", "label")
        if moved.filter("label != old").isEmpty():
            return labels


def near_components(docs: DataFrame, words: int = 3, bits: int = 64, radius: int = 2, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, row_key, fp, component_id) per row; every pair within the radius is linked."""
    rows = stored(fingerprints(docs, words, bits), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    return _numbered(rows, nodes, block_edges(nodes, radius, bits, group_rows), "fp")


def _numbered(rows: DataFrame, nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """``rows`` with the least doc_id of their component; ``nodes`` are (node, least_id)."""
    labels = components(edges).withColumnRenamed("fp", node)
    labelled = nodes.join(labels, node, "left").withColumn("label", F.coalesce("label", node))
    roots = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    ids = labelled.join(roots, "label").select(node, "component_id")
    return rows.join(ids, node).select("doc_id", "row_key", node, "component_id")


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, words: int = 5, bits: int = 256, bands: int = 72, band_bits: int = 14) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest doc_id stays.

    Links are pairs whose sets of shingles have at least the Jaccard similarity; texts without a word have equal sets.
    """
    rows = stored(_keyed_rows(docs).mapInArrow(_set_nodes(words, bits), "doc_id long, row_key long, node binary"), "fingerprints")
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    found = _numbered(rows, nodes, similar_edges(nodes, docs, rows, similarity, words, bits, bands, band_bits), "node")
    lost = found.filter("doc_id > component_id OR (doc_id IS NULL AND component_id IS NOT NULL)").select("doc_id", "row_key").distinct()
    keyed = docs.select(F.struct("*").alias("_row"), F.xxhash64(whole_text()).alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"))
    same = keyed["doc_id"].eqNullSafe(lost["doc_id"]) & (keyed["row_key"] == lost["row_key"])
    return keyed.join(lost, same, "left_anti").select("_row.*")
