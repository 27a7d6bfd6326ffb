"""Lexical retrieval packing: each window is filled with the BM25 neighbours of a seed document.

One pass encodes all documents (ids end with ``END_ID``) and writes them as a table. Document frequencies of all
terms, the number of documents and their mean length are counted over the whole table; terms are token ids, so
at most one number per entry of the vocabulary reaches the driver and the tasks. The inverted index is sharded:
documents are range partitioned by a lexical key (least hashes of their ids, equal for similar documents with
the chance of their overlap) and doc_id, so a key that a third of all documents share is spread over shards.
A task streams its partition in blocks of ``BLOCK_ITEMS`` documents and indexes each block: postings per term with
BM25 weights.

Packing: windows of ``WINDOW`` ids inside a longer document are sequences of their own; what remains is an item. The
first unused item seeds a sequence; the index returns the unused items by BM25 score for the seed's rarest
terms, and those fill the window while they fit. When none fits, the best is cut, the rest of it stays unused.
Items that don't fill a window move on to the next block, so each task pads one sequence only.

Defined results: a null or empty text is the single id ``END_ID``. Rows that repeat an id are packed as documents of
their own. Sequence ids are unique, not gapless. An empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import stored, whole_text

WINDOW = 4096
END_ID = 2
BLOCK_ITEMS = 1024
#: Ids a packing task gets, about.
TASK_IDS = 8_000_000
QUERY_TERMS = 48
K1, B = 1.2, 0.75
MEMO_UNITS = 600_000
MEMO_CHARS = 48
ENCODE_UNITS = 50_000
ENCODE_ROWS = 1_000

_STOP = r"([A-Za-z0-9ß-öø-ÿ])([,.])([ \n])"
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: Rules under which a plain word reaches the merges whole: composed already, lower-cased, one byte a character.
_WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_ENCODED = "doc_id long, lexical long, n_ids long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_LOADED: dict[str, UnitEncoder] = {}
#: Bytes that are no visible Latin-1 characters have one from U+0100 on, in their order.
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b < 33 or 126 < b < 161 or b == 173)}


class UnitEncoder:
    """Ids of texts through remembered ids of their units.

    The tokenizer drops white space and never looks across it, so the parts between ASCII white space are
    encoded independently, each by the library once while it is remembered. A comma or full stop between a plain letter
    or digit and a blank or line feed is always a part of its own, so words are remembered without it. Arrow splits the
    texts and numbers the different parts of a batch, so Python looks each of them up once and not once per word.

    Words of plain letters go straight to the merges of the library's model if the file has the rules ``_WORD_RULES``:
    these do no more to such a word than lower-casing and spelling its bytes. All other units, and all units of files
    with other rules, take the library's whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.model = self.encoder.model
        self.direct = plain_words_are_whole(path)
        self.memo: dict[str, bytes] = {}
        rng = np.random.default_rng(7)
        entries = self.encoder.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if entries <= 1 << 16 else np.dtype("<u4")
        self.spread = rng.permutation(entries).astype(np.uint32), rng.permutation(entries).astype(np.uint32)

    def _by_library(self, units: list[str]) -> Iterator[bytes]:
        for at in range(0, len(units), ENCODE_UNITS):
            for e in self.encoder.encode_batch_fast(units[at : at + ENCODE_UNITS], add_special_tokens=False):
                yield np.array(e.ids, self.kind).tobytes()

    def _by_model(self, words: list[str]) -> Iterator[bytes]:
        for at in range(0, len(words), ENCODE_UNITS):
            ids, ends = [], [0]
            for word in words[at : at + ENCODE_UNITS]:
                ids += [t.id for t in self.model.tokenize(byte_spelling(word))]
                ends.append(len(ids) * self.kind.itemsize)
            joined = np.array(ids, self.kind).tobytes()
            yield from map(joined.__getitem__, map(slice, ends, ends[1:]))

    def _fresh(self, units: list[str]) -> Iterator[bytes]:
        """Ids of each unit."""
        if not self.direct or not units:
            return self._by_library(units)
        plain = pc.match_substring_regex(pa.array(units, pa.string()), _PLAIN).to_pylist()
        by_model = self._by_model([u for u, p in zip(units, plain, strict=True) if p])
        by_library = self._by_library([u for u, p in zip(units, plain, strict=True) if not p])
        return (next(by_model if p else by_library) for p in plain)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, ``END_ID`` after each, and the place where each text begins."""
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _STOP, r"\1 \2\3"))
        numbered = words.flatten().dictionary_encode()
        units = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        missing = list(filterfalse(self.memo.__contains__, units))
        if len(self.memo) + len(missing) > MEMO_UNITS:
            self.memo = {u: self.memo[u] for u in units if u in self.memo}
        self.memo.update(zip(missing, self._fresh(missing), strict=True))
        known = list(map(self.memo.__getitem__, units))
        for u in missing:
            if len(u) > MEMO_CHARS:
                del self.memo[u]
        flat = np.frombuffer(b"".join(known), self.kind)
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.kind.itemsize
        word = numbered.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[word])])
        shift = (np.cumsum(size) - size)[word] - ends[:-1]
        ids = flat[np.repeat(shift, size[word]) + np.arange(ends[-1])]
        stops = ends[np.cumsum(pc.list_value_length(words).to_numpy())]
        begins = np.concatenate([[0], stops[:-1]]) + np.arange(len(stops))
        return np.insert(ids, stops, END_ID), begins

    def lexical(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Least hashes of each text's ids under two fixed permutations."""
        first, second = (np.minimum.reduceat(s[ids], begins).astype(np.int64) for s in self.spread)
        return first << 32 | second


def plain_words_are_whole(path: str) -> bool:
    """Whether the file has the rules ``_WORD_RULES`` and no added token that could stand inside a plain word."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    added = all(re.search(r"[!-@\[-`{-~]", t["content"]) for t in rules["added_tokens"])
    return added and rules["model"]["type"] == "BPE" and all(rules[k] == v for k, v in _WORD_RULES.items())


def byte_spelling(word: str) -> str:
    """A plain word in lower case, each UTF-8 byte as the character that byte-level merges have for it."""
    word = word.lower()
    return word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)


def unit_encoder(path: str) -> UnitEncoder:
    """The encoder of a file, loaded once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = UnitEncoder(path)
    return _LOADED[path]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODE_ROWS):
                part = batch.slice(at, ENCODE_ROWS)
                ids, begins = encoder.encode(part.column(1))
                cuts = np.append(begins, len(ids))
                places = pa.py_buffer((cuts * ids.itemsize).astype(np.int32))
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array(encoder.lexical(ids, begins)),
                        pa.array(np.diff(cuts)),
                        pa.Array.from_buffers(pa.binary(), len(begins), [None, places, pa.py_buffer(ids)]),
                    ],
                    names=["doc_id", "lexical", "n_ids", "ids"],
                )

    return run


def _term_counts(path: str):
    """Documents per term of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(path)
        counts = np.zeros(len(encoder.spread[0]), np.int64)
        flags = np.zeros(len(counts), bool)
        for batch in batches:
            for ids in batch.column(0):
                flags[np.frombuffer(ids.as_buffer(), encoder.kind)] = True
                met = np.flatnonzero(flags)
                counts[met] += 1
                flags[met] = False
        terms = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(terms), pa.array(counts[terms])], names=["term", "docs"])

    return run


class BlockIndex:
    """Inverted BM25 index over the items of a block."""

    def __init__(self, items: list[np.ndarray], idf: np.ndarray, mean_length: float):
        sizes = np.array([len(x) for x in items])
        joined = np.repeat(np.arange(len(items), dtype=np.int64), sizes) * len(idf) + np.concatenate(items)
        postings, tf = np.unique(joined, return_counts=True)
        doc, term = postings // len(idf), postings % len(idf)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean_length))
        self.n, self.idf = len(items), idf
        self.terms_of = np.split(term, np.searchsorted(doc, np.arange(1, len(items))))
        by_term = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[by_term], weight[by_term]
        self.first = np.searchsorted(term[by_term], np.arange(len(idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all items for the rarest terms of the seed."""
        terms = self.terms_of[seed]
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argpartition(-self.idf[terms], QUERY_TERMS)[:QUERY_TERMS]]
        a, b = self.first[terms], self.first[terms + 1]
        size = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.doc[at], self.weight[at], self.n)


class Packer:
    """Sequences of one task; pieces are collected as rows."""

    def __init__(self, idf: np.ndarray, mean_length: float, first_sequence: int):
        self.idf, self.mean_length, self.sequence = idf, mean_length, first_sequence
        self.items: list[tuple[int | None, int, np.ndarray, int]] = []
        self.rows: list[tuple] = []

    def _piece(self, doc_id, start, ids, doc_tokens, offset) -> None:
        crc = zlib.crc32(ids.astype("<u4").tobytes())
        self.rows.append((doc_id, start, len(ids), crc, doc_tokens, self.sequence, offset))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // WINDOW * WINDOW
        for start in range(0, whole, WINDOW):
            self._piece(doc_id, start, ids[start : start + WINDOW], len(ids), 0)
            self.sequence += 1
        if whole < len(ids):
            self.items.append((doc_id, whole, ids[whole:].copy(), len(ids)))
        if len(self.items) >= BLOCK_ITEMS:
            self.pack()

    def pack(self) -> None:
        """Full windows from the items at hand; what doesn't fill one stays."""
        size = np.array([len(x[2]) for x in self.items])
        used = np.zeros(len(size), np.int64)
        left, seed = int(size.sum()), 0
        if left < WINDOW:
            return
        index = BlockIndex([x[2] for x in self.items], self.idf, self.mean_length)

        def take(k: int, n: int, offset: int) -> int:
            doc_id, start, ids, doc_tokens = self.items[k]
            a = int(used[k])
            self._piece(doc_id, start + a, ids[a : a + n], doc_tokens, offset)
            used[k] += n
            return n

        while left >= WINDOW:
            while used[seed] == size[seed]:
                seed += 1
            filled = take(seed, int(size[seed] - used[seed]), 0)
            order = np.argsort(-index.scores(seed), kind="stable")
            order = order[used[order] < size[order]]
            while filled < WINDOW:
                rest = size[order] - used[order]
                fits = rest <= WINDOW - filled
                best = int(fits.argmax())
                if fits[best]:
                    filled += take(int(order[best]), int(rest[best]), filled)
                    order = np.delete(order, best)
                else:
                    filled += take(int(order[0]), WINDOW - filled, filled)
            left -= WINDOW
            self.sequence += 1
        self.items = [(d, s + int(u), ids[u:].copy(), n) for (d, s, ids, n), u in zip(self.items, used, strict=True) if u < len(ids)]

    def finish(self) -> None:
        self.pack()
        offset = 0
        for doc_id, start, ids, doc_tokens in self.items:
            self._piece(doc_id, start, ids, doc_tokens, offset)
            offset += len(ids)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * 7
        self.rows = []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)


def _packed(idf: np.ndarray, mean_length: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(idf, mean_length, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, np.frombuffer(ids.as_buffer(), kind))
            yield packer.batch()
        packer.finish()
        yield packer.batch()

    return run


def pack_documents(docs: DataFrame, path: str, task_ids: int = TASK_IDS) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    encoded = stored(rows.mapInArrow(_encoded(path), _ENCODED), "token-ids")
    n_docs, n_ids = encoded.agg(F.count("*"), F.sum("n_ids")).first()
    encoder = UnitEncoder(path)
    # one count per vocabulary entry at most
    counted = encoded.select("ids").mapInArrow(_term_counts(path), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
    frequency = np.zeros(len(encoder.spread[0]))
    for term, n in counted.collect():
        frequency[term] = n
    idf = np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5))
    parts = max(1, math.ceil((n_ids or 0) / task_ids))
    sharded = encoded.repartitionByRange(parts, "lexical", "doc_id").sortWithinPartitions("lexical", "doc_id", "ids")
    return sharded.select("doc_id", "ids").mapInArrow(_packed(idf, (n_ids or 0) / max(1, n_docs), encoder.kind.str), _PIECES)
