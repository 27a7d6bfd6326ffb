"""Suffix-array dedup: long repeats marked through run-length compressed Burrows-Wheeler transforms.

A byte is removed if a ``length``-byte string over it also starts elsewhere in any document. Work goes to where
equal strings must meet, then an index decides:

1. *Routing.* The anchor of a string is the least hash of its ``ANCHOR_BYTES``-byte substrings, so equal strings have
   equal anchors. Consecutive strings with one anchor form a segment (at most ``SEGMENT_STARTS`` starts). Segments
   are counted per (anchor, content digest), combined before the shuffle. An anchor met once, in one place of one
   segment, has no repeat; copies of a segment are repeats as a whole and are indexed once.
2. *Index.* Only anchors with several different segments, or met twice in one, need their bytes. Their segments, once each, are gathered
   into blocks of about ``BLOCK_BYTES``; a block builds the suffix array of its text (a separator per segment, so no match
   crosses one), its Burrows-Wheeler transform in runs, and keeps samples at run heads and run tails only: text place
   and length of the match with the neighbouring suffix. Matching statistics are streamed from the samples: at
   every other place the match with the next suffix up (or down) is one byte shorter than at the place before.
   A string is marked where either match has ``length`` bytes. The number of samples grows with the runs, which are
   few where the text repeats itself.
3. *Hot anchors.* A passage shared by very many documents gives one anchor many different segments. Beyond
   ``HOT_BYTES`` of them the anchor is keyed anew by the whole string (128-bit hash per start, counted before the
   shuffle), so no task gets an unbounded group and none is dropped.

Marked starts go back to all documents with the segment and are united to spans per document.

Defined results: a null or short text has no repeats. Rows that repeat id and text are repeats of each other. Spans
are judged on the input. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import stored, whole_text

ANCHOR_BYTES = 24
SEGMENT_STARTS = 4096
BLOCK_BYTES = 600_000
HOT_BYTES = 8_000_000
#: Texts are scanned in pieces of about this size.
SCAN_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = "doc long, row_key long, anchor long, digest binary, start long, starts int, twice boolean"


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Mixed hash of each ``size``-byte substring, by doubling: the hash of 2k bytes joins two hashes of k bytes."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    out, have = None, 0
    while True:
        if size & width:
            if out is None:
                out, have = h, width
            else:
                n = len(data) - have - width + 1
                out = out[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + h[have : have + n]
                have += width
        if have == size:
            break
        n = len(h) - width
        h = h[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width : width + n]
        width *= 2
    out = out ^ (out >> np.uint64(29))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def sliding_min(values: np.ndarray, window: int) -> np.ndarray:
    """Least value of each window, from windows of powers of two."""
    width = 1
    while width * 2 <= window:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = window - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchor_places(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first and of the last least hash of each window, compared by the leading 40 bits."""
    low = np.uint64((1 << 24) - 1)
    at = np.arange(len(hashes), dtype=np.uint64)
    high = hashes & ~low
    first = sliding_min(high | at, window) & low
    last = low - (sliding_min(high | (low - at), window) & low)
    return first.astype(np.int64), last.astype(np.int64)


def segments_of(texts: list[bytes], length: int, segment_starts: int = SEGMENT_STARTS) -> tuple[np.ndarray, ...]:
    """Segments of texts laid end to end, below 16 MB: (text number, anchor, start, number of starts, anchor met twice)."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    hashes = gram_hashes(data, ANCHOR_BYTES)
    first_place, last_place = anchor_places(hashes, length - ANCHOR_BYTES + 1)
    anchor = hashes[first_place].view(np.int64)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    place = np.arange(len(anchor)) - begin[owner]
    inside = place + length <= sizes[owner]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(anchor)))
    first, runs = first[inside[first]], runs[inside[first]]
    cuts = -(-runs // segment_starts)
    piece = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    first, runs = np.repeat(first, cuts) + piece * segment_starts, np.repeat(runs, cuts)
    runs = np.minimum(segment_starts, runs - piece * segment_starts)
    twice = first_place[first] != last_place[first + runs - 1]
    return owner[first], anchor[first], place[first], runs, twice


def _scan_groups(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in groups of about ``SCAN_BYTES``: their numbers, offsets and bytes. Longer texts come in overlapping pieces."""
    numbers, offsets, parts, held = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), SCAN_BYTES):
            part = text[at : at + SCAN_BYTES + length - 1]
            numbers.append(i)
            offsets.append(at)
            parts.append(part)
            held += len(part)
            if held >= SCAN_BYTES:
                yield numbers, offsets, parts
                numbers, offsets, parts, held = [], [], [], 0
    if parts:
        yield numbers, offsets, parts


def _segments(length: int, segment_starts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "row_key", "anchor", "digest", "start", "starts", "twice"]
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            docs, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for numbers, offsets, parts in _scan_groups(batch.column(2).to_pylist(), length):
                owner, anchor, start, n, twice = segments_of(parts, length, segment_starts)
                spans = zip(owner.tolist(), start.tolist(), (start + n + length - 1).tolist(), strict=True)
                digests = [digest(parts[k][a:b]) for k, a, b in spans]
                row = np.array(numbers)[owner]
                start = start + np.array(offsets)[owner]
                columns = [docs[row], keys[row], anchor, pa.array(digests, pa.binary()), start, n.astype(np.int32), twice.astype(bool)]
                yield pa.record_batch([pa.array(c) for c in columns], names=names)

    return run


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; values of ``text`` are not negative.

    A rank is the first place of a group of equal prefixes. Only suffixes whose rank is still shared are sorted again.
    """
    n = len(text)
    base, width, key = int(text.max()) + 2, 1, text + 1
    while base ** (width + 1) < 1 << 62:
        following = np.zeros(n, np.int64)
        following[: max(0, n - width)] = text[width:] + 1
        key, width = key * base + following, width + 1
    order = np.argsort(key)
    ordered = key[order]
    opens = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    while True:
        places = np.flatnonzero(~(opens & np.append(opens[1:], True)))
        if not len(places):
            return order
        tied = order[places]
        inside = tied + width < n
        following = np.zeros(len(tied), np.int64)
        following[inside] = rank[tied[inside] + width] + 1
        key = rank[tied] * (n + 1) + following
        by_key = np.argsort(key)
        tied, key = tied[by_key], key[by_key]
        order[places] = tied
        opens[places] = parts = np.concatenate([[True], key[1:] != key[:-1]])
        rank[tied] = places[np.maximum.accumulate(np.where(parts, np.arange(len(places)), 0))]
        width *= 2


class RunLengthIndex:
    """Burrows-Wheeler transform in runs, with samples at run heads and run tails."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        order = suffix_array(text)
        last = text[order - 1]
        head = np.ones(n, bool)
        head[1:] = last[1:] != last[:-1]
        tail = np.ones(n, bool)
        tail[:-1] = head[1:]
        self.size = n
        self.run_symbols = last[head]
        self.run_lengths = np.diff(np.append(np.flatnonzero(head), n))
        #: samples (place, match with the neighbouring suffix), by place
        self.heads = self._samples(text, order, np.flatnonzero(head), -1)
        self.tails = self._samples(text, order, np.flatnonzero(tail), 1)

    @staticmethod
    def _samples(text, order, rows, side) -> tuple[np.ndarray, np.ndarray]:
        has = (rows + side >= 0) & (rows + side < len(order))
        match = np.zeros(len(rows), np.int64)
        match[has] = common_prefix(text, order[rows[has]], order[rows[has] + side])
        places = order[rows]
        by_place = np.argsort(places)
        return places[by_place], match[by_place]

    def _streamed(self, samples) -> np.ndarray:
        places, match = samples
        at = np.arange(self.size)
        k = np.searchsorted(places, at, "right") - 1
        return np.where(k >= 0, match[k] - (at - places[k]), 0)

    def matching_statistics(self) -> np.ndarray:
        """Longest match of each place with any other place of the text."""
        return np.maximum(self._streamed(self.heads), self._streamed(self.tails))


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a and b: 64 values at a time, until each pair differs."""
    step = 64
    padded = np.concatenate([text, np.full(step, -1, text.dtype)])
    padded[len(text) :] = -1 - np.arange(step)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    offsets = np.arange(step)
    while len(live):
        for at in range(0, len(live), 20_000):
            part = live[at : at + 20_000]
            x = np.minimum((a[part] + out[part])[:, None] + offsets, len(padded) - 1)
            y = np.minimum((b[part] + out[part])[:, None] + offsets, len(padded) - 1)
            differs = padded[x] != padded[y]
            stop = differs.any(axis=1)
            out[part] += np.where(stop, differs.argmax(axis=1), step)
            live[at : at + 20_000] = np.where(stop, -1, part)
        live = live[live >= 0]
    return out


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment the starts of ``length``-byte strings that occur elsewhere in the segments."""
    sizes = np.array([len(s) + 1 for s in segments])
    data = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64) + len(segments)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data[first + sizes - 1] = np.arange(len(segments))
    matches = RunLengthIndex(data).matching_statistics()
    return [np.flatnonzero(matches[f : f + max(0, s - length)] >= length) for f, s in zip(first, sizes, strict=True)]


def _spans(starts: np.ndarray) -> bytes:
    """Runs of starts as (first, last + 1) pairs."""
    if not len(starts):
        return b""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + 1], axis=1).astype("<i4").tobytes()


def _indexed(length: int, block_bytes: int):
    """Marked starts (anchor, digest, spans) of the different segments of a sorted partition, block by block."""

    def marked(block):
        found = repeated_starts([b for _, _, b in block], length)
        rows = [(a, d, _spans(s)) for (a, d, _), s in zip(block, found, strict=True) if len(s)]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.record_batch(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["anchor", "digest", "spans"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, current = [], 0, None
        for batch in batches:
            for anchor, digest, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != current and held >= block_bytes:
                    yield marked(block)
                    block, held = [], 0
                current = anchor
                block.append((anchor, digest, piece))
                held += len(piece)
        if block:
            yield marked(block)

    return run


def _pieces(length: int):
    """Bytes of segments asked for: rows (text, wanted) give (anchor, digest, piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in wanted:
                    rows.append((w["anchor"], w["digest"], text[w["start"] : w["start"] + w["starts"] + length - 1]))
                    if len(rows) == 2000:
                        yield _piece_batch(rows)
                        rows = []
            yield _piece_batch(rows)

    return run


def _piece_batch(rows):
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.record_batch(
        [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["anchor", "digest", "piece"]
    )


def _starts(length: int):
    """One row per start of the segments of hot anchors: (anchor, digest, place, hash of the string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "digest", "place", "string"]
        for batch in batches:
            for anchor, digest, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(piece) - length + 1
                strings = [xxhash.xxh3_128_digest(piece[i : i + length]) for i in range(n)]
                yield pa.record_batch(
                    [pa.array([anchor] * n, pa.int64()), pa.array([digest] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(strings, pa.binary())],
                    names=names,
                )

    return run


def _joined_starts(table: pa.Table) -> pa.Table:
    first = table.slice(0, 1)
    return pa.table({"anchor": first["anchor"], "digest": first["digest"], "spans": pa.array([_spans(np.sort(table["place"].to_numpy()))], pa.binary())})


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"),
        F.xxhash64(whole_text()).alias("row_key"),
        whole_text().cast("binary").alias("text"),
    )


def marked_segments(
    docs: DataFrame, length: int = 400, block_bytes: int = BLOCK_BYTES, hot_bytes: int = HOT_BYTES, segment_starts: int = SEGMENT_STARTS
) -> DataFrame:
    """(doc, row_key, start, starts, spans): segments with repeats; spans null: all of the segment's starts."""
    keyed = _keyed(docs)
    found = stored(keyed.select("doc", "row_key", "text").mapInArrow(_segments(length, segment_starts), _SEGMENT), "segments")
    each = found.groupBy("anchor", "digest").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc", "row_key", "start", "starts")).alias("one"), F.max("twice").alias("twice")
    )
    anchors = each.groupBy("anchor").agg(
        F.sum("copies").alias("met"), F.count("*").alias("different"), F.sum(F.col("one.starts") + length).alias("bytes"), F.max("twice").alias("twice")
    )
    live = stored(each.drop("twice").join(anchors.filter("met > 1 OR twice"), "anchor"), "segment-groups")
    single = live.filter("different > 1 OR twice").select(
        "anchor", "digest", "bytes", F.col("one.doc").alias("doc"), F.col("one.row_key").alias("row_key"), F.col("one.start").alias("start"), F.col("one.starts").alias("starts")
    )
    wanted = single.groupBy("doc", "row_key").agg(F.collect_list(F.struct("anchor", "digest", "start", "starts")).alias("wanted"))
    pieces = keyed.select("doc", "row_key", "text").join(wanted, ["doc", "row_key"]).select("text", "wanted").mapInArrow(_pieces(length), "anchor long, digest binary, piece binary")
    pieces = stored(pieces, "segment-pieces")
    hot = stored(live.filter((F.col("different") > 1) & (F.col("bytes") > hot_bytes)).select("anchor").distinct(), "hot-anchors")
    cool = pieces.join(hot, "anchor", "left_anti").select("anchor", "digest", "piece")
    indexed = cool.repartition("anchor").sortWithinPartitions("anchor", "digest").mapInArrow(
        _indexed(length, block_bytes), "anchor long, digest binary, spans binary"
    )
    places = pieces.join(hot, "anchor", "left_semi").select("anchor", "digest", "piece").mapInArrow(
        _starts(length), "anchor long, digest binary, place int, string binary"
    )
    again = places.groupBy("anchor", "string").count().filter("count > 1").drop("count")
    by_string = places.join(again, ["anchor", "string"], "left_semi").groupBy("anchor", "digest").applyInArrow(
        _joined_starts, "anchor long, digest binary, spans binary"
    )
    whole = live.filter("copies > 1").select("anchor", "digest", F.lit(None).cast("binary").alias("spans"))
    partly = indexed.unionByName(by_string)
    marks = stored(whole.unionByName(partly), "segment-marks")
    return found.join(marks, ["anchor", "digest"]).select("doc", "row_key", "start", "starts", "spans")


def _digest(length: int):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                removed = removed_spans(marks or [], length)
                kept, at = [], 0
                for a, b in removed:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                rows.append((doc_id, len(text), sum(b - a for a, b in removed), len(removed), hashlib.sha256(b"".join(kept)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(),) * 4 + (pa.string(),)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))

    return run


def removed_spans(marks: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal removed runs of a document from the marks of its segments."""
    spans = []
    for m in marks:
        if m["spans"] is None:
            spans.append((m["start"], m["start"] + m["starts"] + length - 1))
        else:
            spans += [(m["start"] + a, m["start"] + b + length - 1) for a, b in np.frombuffer(m["spans"], "<i4").reshape(-1, 2).tolist()]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeat_digest(
    docs: DataFrame, length: int = 400, block_bytes: int = BLOCK_BYTES, hot_bytes: int = HOT_BYTES, segment_starts: int = SEGMENT_STARTS
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 per row."""
    marks = (
        marked_segments(docs, length, block_bytes, hot_bytes, segment_starts)
        .groupBy("doc", "row_key")
        .agg(F.collect_list(F.struct("start", "starts", "spans")).alias("marks"))
    )
    return (
        _keyed(docs)
        .join(marks, ["doc", "row_key"], "left")
        .select("doc_id", "text", "marks")
        .mapInArrow(_digest(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )
