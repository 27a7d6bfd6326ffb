"""Token counts, with overlap resynchronisation for huge documents.

A document of more than ``HUGE_BYTES`` bytes is cut into chunks that overlap, which become rows of their own and
are encoded by any task. Each chunk reports the pre-token boundaries (byte position and tokens before it) in the
parts it shares with its neighbours. Two neighbours are spliced at a boundary that both have:

* the left chunk starts at a proven boundary, and pre-tokens are found from left to right from the text at hand,
  so its boundaries are those of the whole text except in the last ``MARGIN`` bytes before its cut, where a longer
  text could change a match;
* from a boundary shared with the left chunk the right chunk sees the same text from the same state, so all its
  later boundaries and tokens are right too, whatever it made of its first bytes.

Where no boundary is shared, the document is tried again with an overlap four times as wide, at last as one chunk.

Other documents are encoded whole. As a single space between two visible characters always starts a pre-token,
a text is a sequence of units that the library encodes independently; counts of units are remembered, at most
``MEMO_UNITS`` per Python worker, and every unit is encoded by the library once. A comma or full stop between a plain
letter or digit and a space is always a pre-token of its own, so units are remembered without it.

Defined results: a null text is empty and has no tokens. Rows that repeat an id give a row each. An empty table
gives no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import stored, whole_text

HUGE_BYTES = 65_536
CHUNK_BYTES = 32_768
OVERLAP_BYTES = 1_024
#: Bytes before a cut in which a longer text could change a match: longer than any special token or fixed pattern.
MARGIN = 32
MEMO_UNITS = 400_000
MEMO_CHARS = 48
ENCODE_UNITS = 50_000

_UNIT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
_STOP = re.compile(r"(?<=[A-Za-z0-9ß-öø-ÿ])[,.](?= [!-~\w])")
_CHUNK = "doc long, row_key long, n_bytes long, chunk long, start long, text string, last boolean"
_EDGES = "doc long, row_key long, n_bytes long, chunk long, tokens long, head binary, tail binary"
_COUNT = "doc long, row_key long, n_bytes long, n_tokens long"

_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per Python worker; its threads are Spark's tasks."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _LOADED[path] = made
    return _LOADED[path]


class UnitCounter:
    """Token counts of texts through remembered counts of their units."""

    def __init__(self, path: str):
        self.encoder, self.memo = tokenizer(path), {}
        if self._encode([",", "."]) != [1, 1]:
            raise ValueError("the tokenizer has no token for a comma or a full stop")

    def _encode(self, units: list[str]) -> list[int]:
        out = []
        for at in range(0, len(units), ENCODE_UNITS):
            out += map(len, self.encoder.encode_batch_fast(units[at : at + ENCODE_UNITS], add_special_tokens=False))
        return out

    def counts(self, texts: list[str]) -> list[int]:
        plain = [_STOP.subn("", t) for t in texts]
        parts = [_UNIT.split(t) for t, _ in plain]
        heads = [n + stops for n, (_, stops) in zip(self._encode([p[0] for p in parts]), plain, strict=True)]
        units = lambda: chain.from_iterable(p[1:] for p in parts)
        missing = list(set(filterfalse(self.memo.__contains__, units())))
        if len(self.memo) + len(missing) > MEMO_UNITS:
            self.memo = {u: self.memo[u] for u in set(units()) if u in self.memo}
        self.memo.update(zip(missing, self._encode([" " + u for u in missing]), strict=True))
        get = self.memo.__getitem__
        out = [head + sum(map(get, p[1:])) for head, p in zip(heads, parts, strict=True)]
        for u in missing:
            if len(u) > MEMO_CHARS:
                del self.memo[u]
        return out


_COUNTERS: dict[str, UnitCounter] = {}


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.setdefault(path, UnitCounter(path))
        for batch in batches:
            texts, counts = batch.column(2).to_pylist(), []
            for at in range(0, len(texts), 500):
                counts += counter.counts(texts[at : at + 500])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def _cut_points(text: bytes, step: int) -> list[int]:
    """Chunk starts at character borders."""
    out = [0]
    while out[-1] + step < len(text):
        at = out[-1] + step
        while text[at] & 0xC0 == 0x80:
            at -= 1
        out.append(at)
    return out


def _chunks(step: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc", "row_key", "n_bytes", "chunk", "start", "text", "last")
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        for batch in batches:
            for doc, row_key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text.encode()
                starts, rows = _cut_points(text, step), []
                for k, s in enumerate(starts):
                    end = s + step + overlap
                    while end < len(text) and text[end] & 0xC0 == 0x80:
                        end += 1
                    rows.append((doc, row_key, len(text), k, s, text[s:end].decode(), k + 1 == len(starts)))
                    if end >= len(text):
                        rows[-1] = (*rows[-1][:-1], True)
                        break
                columns = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))

    return run


def token_bytes(encoder) -> np.ndarray:
    """Bytes of each id: byte-level tokens have one character per byte, added tokens are plain text."""
    sizes = np.zeros(encoder.get_vocab_size(with_added_tokens=True), np.int64)
    for token, i in encoder.get_vocab(with_added_tokens=True).items():
        sizes[i] = len(token)
    for i, added in encoder.get_added_tokens_decoder().items():
        sizes[i] = len(added.content.encode())
    return sizes


def boundaries(encoder, sizes: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Pre-token boundaries of a text: byte positions, tokens before each, and all tokens."""
    found = encoder.encode(text, add_special_tokens=False)
    ids = np.array(found.ids, np.int64)
    words = [-1 if w is None else w for w in found.word_ids]
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    if len(ids) and ends[-1] != len(text.encode()):
        raise ValueError("tokens don't cover the text byte by byte")
    words = np.array(words, np.int64)
    first = np.ones(len(ids), bool)
    first[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
    return starts[first], np.flatnonzero(first), len(ids)


def _edges(path: str, step: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        sizes = token_bytes(encoder)
        names = ("doc", "row_key", "n_bytes", "chunk", "tokens", "head", "tail")
        types = (pa.int64(),) * 5 + (pa.binary(),) * 2
        for batch in batches:
            rows = []
            for doc, row_key, n_bytes, chunk, start, text, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, before, total = boundaries(encoder, sizes, text)
                end = len(text.encode())
                head = at <= overlap + 4
                tail = (at >= step - 4) & (at <= end - MARGIN) & (not last)
                pack = lambda m: np.stack([at[m] + start, before[m]]).astype("<i8").tobytes()  # noqa: B023, E731
                rows.append((doc, row_key, n_bytes, chunk, total, pack(head) if chunk else b"", pack(tail)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))

    return run


def splice(chunks: list[tuple[int, bytes, bytes]]) -> int | None:
    """Tokens of a document from its chunks (tokens, head, tail) in order; None if two don't align."""
    counted, begin = 0, 0
    for k, (tokens, _, tail) in enumerate(chunks):
        if k + 1 == len(chunks):
            return counted + tokens - begin
        at, before = np.frombuffer(tail, "<i8").reshape(2, -1)
        next_at, next_before = np.frombuffer(chunks[k + 1][1], "<i8").reshape(2, -1)
        _, i, j = np.intersect1d(at, next_at, assume_unique=True, return_indices=True)
        if not len(i):
            return None
        counted += int(before[i[-1]]) - begin
        begin = int(next_before[j[-1]])
    return 0


def _spliced(table: pa.Table) -> pa.Table:
    table = table.sort_by("chunk")
    chunks = list(zip(*(table.column(n).to_pylist() for n in ("tokens", "head", "tail")), strict=True))
    first = table.slice(0, 1)
    return pa.table(
        {"doc": first["doc"], "row_key": first["row_key"], "n_bytes": first["n_bytes"], "n_tokens": pa.array([splice(chunks)], pa.int64())}
    )


def _huge_counts(huge: DataFrame, path: str, chunk_bytes: int, overlap: int, name: str) -> DataFrame:
    step = max(chunk_bytes, overlap)
    parts = max(huge.sparkSession.sparkContext.defaultParallelism, int(huge.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = huge.mapInArrow(_chunks(step, overlap), _CHUNK).repartition(parts, "doc", "row_key", "chunk")
    edges = rows.mapInArrow(_edges(path, step, overlap), _EDGES)
    return stored(edges.groupBy("doc", "row_key").applyInArrow(_spliced, _COUNT), name)


def huge_token_counts(huge: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """(doc, row_key, n_bytes, n_tokens) per different row of (doc, row_key, text)."""
    huge = huge.dropDuplicates(["doc", "row_key"])
    done, left = None, huge
    while True:
        found = _huge_counts(left, path, chunk_bytes, overlap, "token-counts")
        good = found.filter("n_tokens IS NOT NULL")
        done = good if done is None else done.unionByName(good)
        failed = found.filter("n_tokens IS NULL").select("doc", "row_key")
        if failed.isEmpty():
            return done
        left = huge.join(failed, ["doc", "row_key"], "left_semi")
        overlap *= 4


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = 1024,
    huge_bytes: int = HUGE_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    overlap: int = OVERLAP_BYTES,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit per row of ``docs``, for the byte-level tokenizer in ``path``."""
    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    plain = rows.filter(F.col("n_bytes") <= huge_bytes).mapInArrow(_whole(path), "doc_id long, n_bytes long, n_tokens long")
    huge = rows.filter(F.col("n_bytes") > huge_bytes).select(
        "doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("row_key"), "n_bytes", "text"
    )
    counted = huge_token_counts(huge.select("doc", "row_key", "text"), path, chunk_bytes, overlap)
    large = huge.select("doc_id", "doc", "row_key").join(counted, ["doc", "row_key"]).select("doc_id", "n_bytes", "n_tokens")
    return plain.unionByName(large).withColumn("over_limit", F.col("n_tokens") > limit)
