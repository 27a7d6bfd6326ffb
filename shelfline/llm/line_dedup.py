"""Line dedup by range-partitioned line hashes; the result is a compressed bitmap of kept lines per document.

Each document gives one occurrence per different line key: (128-bit hash, doc_id, places). Occurrences are range
partitioned by (hash, doc_id descending), so a line found in a third of all documents spreads over as many
partitions as it needs, and sorted by document and place inside a partition. A task streams them: the first
occurrence of a hash is the one that stays, later ones are dropped once ``min_docs`` documents have been met, and
only that many occurrences are ever held. A run of one hash that touches the border of a partition may go on in
the next, so it leaves a summary and its occurrences are settled by a join with the sum of all summaries, at most
two per partition.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased. Texts are not shuffled
to find the lines; applying the bitmaps takes one join by document.

Defined results: a null or empty text is one empty line. The key has ``min_chars`` code points at least. A row
that repeats a doc_id is another document; if it is the largest holding a line, all rows of that id keep it. A null
doc_id is smaller than any other. A very long text is split whole, inside the task that reads it. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import WHITE_SPACE, stored, whole_text

SPACE = WHITE_SPACE.encode()
#: Occurrences per range partition, about 100 MB.
RANGE_ROWS = 2_000_000

_FOUND = "hash binary, doc long, row_key long, lines binary, n_lines int"
_EVENT = "kind string, hash binary, doc long, row_key long, lines binary, n long"
#: Ids sort after this value, which stands for a missing one.
NO_ID = -(2**63)


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    if len(key) < min_chars:
        return False
    return len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars


def _occurrences(min_chars: int):
    """Occurrences (hash, doc, row key, places of its lines), and one row without hash per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids, keys, texts = (batch.column(i).to_pylist() for i in range(3))
            for doc, row_key, text in zip(ids, keys, texts, strict=True):
                places: dict[bytes, list[int]] = {}
                lines = text.split(b"\n")
                for i, line in enumerate(lines):
                    if len(line) >= min_chars and _long_enough(key := line_key(line), min_chars):
                        places.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
                for h, at in places.items():
                    out.append((h, doc, row_key, np.array(at, "<i4").tobytes(), len(lines)))
            yield _batch(out, (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32()), ("hash", "doc", "row_key", "lines", "n_lines"))

    return run


def _batch(rows: list[tuple], types, names) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))


class _Run:
    """Occurrences of one hash in a partition, in order of decreasing id."""

    def __init__(self, h: bytes, largest: int):
        self.hash, self.largest, self.n, self.waiting = h, largest, 0, []


def _stream(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        names = ("kind", "hash", "doc", "row_key", "lines", "n")
        current, first, spilled = None, True, False
        for batch in batches:
            out: list[tuple] = []
            for h, doc, row_key, lines in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if current is None or h != current.hash:
                    if current is not None:
                        if first:
                            _leave_open(current, out)
                        first, spilled = False, False
                    current = _Run(h, doc)
                current.n += 1
                if first:
                    out.append(("open", h, doc, row_key, lines, 1))
                elif spilled:
                    if doc != current.largest:
                        out.append(("drop", h, doc, row_key, lines, 1))
                else:
                    current.waiting.append((h, doc, row_key, lines))
                    if current.n >= min_docs:
                        # Enough documents, whatever the next partition adds: all but the first go.
                        out.extend(("drop", *w, 1) for w in current.waiting if w[1] != current.largest)
                        current.waiting, spilled = [], True
            yield _batch(out, types, names)
        out = []
        if current is not None:
            out.extend(("open", *w, 1) for w in current.waiting)
            _leave_open(current, out)
        yield _batch(out, types, names)

    return run


def _leave_open(current: _Run, out: list[tuple]) -> None:
    out.append(("sum", current.hash, current.largest, None, None, current.n))


def _settled(events: DataFrame, min_docs: int) -> DataFrame:
    """Lines to drop (doc, row_key, lines). Summaries are two per partition at most."""
    sums = (
        events.filter("kind = 'sum'")
        .groupBy("hash")
        .agg(F.sum("n").alias("total"), F.max("doc").alias("largest"))
        .filter(F.col("total") >= min_docs)
        .select("hash", "largest")
    )
    opened = events.filter("kind = 'open'").join(F.broadcast(sums), "hash").filter("doc < largest")
    return events.filter("kind = 'drop'").select("doc", "row_key", "lines").unionByName(opened.select("doc", "row_key", "lines"))


def _bitmap(dropped: list[bytes], n_lines: int) -> tuple[bytes, int]:
    keep = np.ones(n_lines, np.uint8)
    for lines in dropped:
        keep[np.frombuffer(lines, "<i4")] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1), n_lines - int(keep.sum())


def bitmap_lines(bitmap: bytes, n_lines: int) -> np.ndarray:
    """Kept lines as booleans."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, row_key, n_lines, dropped in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append((doc, row_key, n_lines, *_bitmap(dropped, n_lines)))
        yield _batch(rows, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()), ("doc", "row_key", "n_lines", "keep_bitmap", "n_dropped"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(whole_text()).alias("row_key"),
        whole_text().cast("binary").alias("text"),
        F.col("doc_id").cast("long").alias("doc_id"),
    )


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, row_key, n_lines, keep_bitmap, n_dropped) of the documents that lose lines."""
    found = stored(
        _keyed(docs).select("doc", "row_key", "text").mapInArrow(_occurrences(min_chars), _FOUND), "line-occurrences"
    )
    parts = 1 + found.count() // RANGE_ROWS
    parts = max(parts, docs.sparkSession.sparkContext.defaultParallelism)
    ordered = found.repartitionByRange(parts, "hash", F.desc("doc")).sortWithinPartitions("hash", F.desc("doc"), "row_key", "lines")
    events = stored(ordered.select("hash", "doc", "row_key", "lines").mapInArrow(_stream(min_docs), _EVENT), "line-events")
    # rows that repeat id and text have the same lines, so a set of them is enough
    drops = _settled(events, min_docs).groupBy("doc", "row_key").agg(F.collect_set("lines").alias("dropped"))
    lengths = found.groupBy("doc", "row_key").agg(F.max("n_lines").alias("n_lines"))
    return drops.join(lengths, ["doc", "row_key"]).select("doc", "row_key", "n_lines", "dropped").mapInArrow(
        _bitmaps, "doc long, row_key long, n_lines int, keep_bitmap binary, n_dropped long"
    )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, bitmap in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "keep_bitmap")), strict=True):
            n_lines, dropped = text.count(b"\n") + 1, 0
            if bitmap is not None:
                keep = bitmap_lines(bitmap, n_lines)
                text = b"\n".join([x for x, k in zip(text.split(b"\n"), keep, strict=True) if k])
                dropped = n_lines - int(keep.sum())
            rows.append((doc_id, n_lines, dropped, hashlib.sha256(text).hexdigest()))
        yield _batch(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string()), ("doc_id", "n_lines", "n_dropped", "kept_sha256"))


def line_digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 per document, from the bitmaps."""
    bitmaps = dropped_lines(docs, min_chars, min_docs).select("doc", "row_key", "keep_bitmap")
    return (
        _keyed(docs)
        .join(bitmaps, ["doc", "row_key"], "left")
        .select("doc_id", "text", "keep_bitmap")
        .mapInArrow(_apply, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    )
