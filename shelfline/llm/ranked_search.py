"""Ranked lexical search: the best documents of every item by an integer BM25, found through norm buckets.

A score is the inner product of an item's term weights w and a document's impacts. Both sides are scaled by the
square root of w, so that common terms lengthen no vector. Documents are range partitioned and sorted by the length
of their impact vector, longest first, equal lengths by id, and cut into buckets of ``BUCKET`` vectors. For an item
whose k-th best score so far is t:

* Cauchy-Schwarz: a bucket whose longest vector times the length of the item stays below t is left out as a whole;
* coordinate bounds: inside a bucket the item's heaviest terms are looked up in the bucket's sorted coordinates; what
  they contribute plus the product of the two remaining lengths bounds each score, and vectors below t are left out;
* the others are scored exactly in 64-bit integers.

Every task keeps the k best per item and starts from the k-th best score among the longest vectors of the whole
table, so only k rows per item leave a task. Bounds are rounded up by more than floating point can err, so no
document with a score of t or more is lost.

Items are asked in blocks of ``BLOCK_BYTES`` of text, each block against all documents: what is sent to the tasks (the
terms of a block and their weights) is bounded by that size. Equal item texts are asked once. Document counts, lengths
and term counts cover all documents.

Defined results: a null text has no terms; such items and items that share no term with a document get no rows.
Every document row counts, repeated ids too, and ties go to the smaller doc_id, null last; every item row is answered.
Texts are read whole. Columns other than doc_id, item_id and text are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import stored

#: Bytes of item texts asked at once, and vectors of a bucket.
BLOCK_BYTES = 4_000_000
BUCKET = 4096
#: Longest vectors that give the first thresholds.
HEAD = 8192

_RESULT = "item_id long, rank int, doc_id long, score long"
_VECTOR = "doc_id long, n long, terms array<int>, counts array<long>"
_IMPACT = "doc_id long, norm double, terms array<int>, impacts array<long>"
_FOUND = "query int, doc_id long, score long"

#: Bytes of terms as they are (A-Z lower-cased), all others as spaces; bytes from 0x80 belong to terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best rows of ``docs`` (doc_id, text) for every row of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text"))
    texts = asked.select("text").distinct()
    total = texts.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = 1 + total // BLOCK_BYTES
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text"))
    out = None
    for block in range(blocks):
        chosen = texts.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        queries = sorted(bytes(r.text) for r in chosen.collect())
        found = _rank_block(read, queries, k)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        return items.sparkSession.createDataFrame([], _RESULT)
    return asked.select("item_id", F.sha2("text", 256).alias("key")).join(out, "key").select("item_id", "rank", "doc_id", "score")


def _rank_block(docs: DataFrame, queries: list[bytes], k: int) -> DataFrame | None:
    """Best documents of a block of texts, by the digest of the text (``key``)."""
    spark = docs.sparkSession
    wanted = [sorted(set(terms_of(q))) for q in queries]
    number = {t: i for i, t in enumerate(sorted({t for q in wanted for t in q}))}
    if not number:
        return None
    vectors = stored(docs.mapInArrow(_count_terms(spark.sparkContext.broadcast(number)), _VECTOR), "term-counts")
    size = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    if not size.docs:
        return None
    weights = np.full(len(number), _weight(size.docs, 0), np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[r.term] = _weight(size.docs, r["count"])
    impacts = stored(
        vectors.filter(F.size("terms") > 0)
        .mapInArrow(_impacts(weights, size.docs, size.terms), _IMPACT)
        .repartitionByRange(F.desc("norm"), "doc_id")
        .sortWithinPartitions(F.desc("norm"), "doc_id"),
        "impact-vectors",
    )
    plan = spark.sparkContext.broadcast((weights, [np.array([number[t] for t in q], np.int64) for q in wanted]))
    cut = impacts.agg(F.percentile_approx("norm", F.lit(max(0.0, 1 - HEAD / size.docs)), F.lit(10_000)).alias("cut")).first().cut
    if cut is None:
        return None
    head = impacts.filter(F.col("norm") >= cut).mapInArrow(_search(plan, k, {}), _FOUND)
    kth = F.element_at(F.sort_array(F.collect_list("score"), asc=False), k)
    first = head.groupBy("query").agg(F.count("*").alias("n"), F.when(F.count("*") >= k, kth).alias("kth"))
    known = {r.query: r.kth for r in first.filter(F.col("n") >= k).collect()}
    found = impacts.sortWithinPartitions(F.desc("norm"), "doc_id").mapInArrow(_search(plan, k, known), _FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    keys = spark.createDataFrame([(i, bytearray(q)) for i, q in enumerate(queries)], "query int, text binary")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .join(keys.select("query", F.sha2("text", 256).alias("key")), "query")
        .select("key", "rank", "doc_id", "score")
    )


def _weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


# ---- inside tasks


def _count_terms(number):
    """Per document: all its terms, and how often it holds each term of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            n, ends, terms, counts = [], [0], [], []
            for text in batch.column(1):
                found = terms_of(text.as_py())
                n.append(len(found))
                held = sorted((known[t], c) for t, c in Counter(found).items() if t in known)
                terms.extend(t for t, _ in held)
                counts.extend(c for _, c in held)
                ends.append(len(terms))
            lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))  # noqa: E731, B023
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), lists(terms, pa.int32()), lists(counts, pa.int64())],
                names=["doc_id", "n", "terms", "counts"],
            )

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the bounds of its rows."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


def _row_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return sums[ends[1:]] - sums[ends[:-1]]


def _impacts(weights: np.ndarray, docs: int, terms_total: int):
    """Impact of each held term, and the length of the weighted vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, ends = _flat(batch.column(2))
            counts, _ = _flat(batch.column(3))
            n = batch.column(1).to_numpy()
            m = 10 + (90 * n * docs) // terms_total
            impact = (1_000_000_000 * counts) // (1000 * counts + 8 * np.repeat(m, np.diff(ends)))
            norm = np.sqrt(np.add.reduceat(weights[terms] * impact.astype(float) ** 2, ends[:-1])) if len(terms) else np.zeros(0)
            offsets = pa.array(ends, pa.int32())
            out = pa.record_batch(
                [
                    batch.column(0),
                    pa.array(norm, pa.float64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(impact, pa.int64())),
                ],
                names=["doc_id", "norm", "terms", "impacts"],
            )
            yield out.filter(pa.array(norm > 0))

    return run


class _Best:
    """The k best documents of an item so far and the score that a better one has to reach."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, least
        self.docs, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.missing = np.zeros(0, bool)

    def add(self, scores: np.ndarray, docs: np.ndarray, missing: np.ndarray) -> None:
        good = (scores > 0) & (scores >= self.least)
        if not good.any():
            return
        scores, docs, missing = (
            np.concatenate(pair) for pair in ((self.scores, scores[good]), (self.docs, docs[good]), (self.missing, missing[good]))
        )
        kept = np.lexsort((docs, missing, -scores))[: self.k]
        self.scores, self.docs, self.missing = scores[kept], docs[kept], missing[kept]
        if len(kept) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


class _Bucket:
    """Vectors of similar length with their coordinates sorted by term."""

    def __init__(self, batch: pa.RecordBatch, roots: np.ndarray):
        self.docs = batch.column(0).fill_null(0).to_numpy()
        self.missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        self.norms = batch.column(1).to_numpy()
        self.terms, self.ends = _flat(batch.column(2))
        self.impacts, _ = _flat(batch.column(3))
        order = np.argsort(self.terms, kind="stable")
        self.by_term = self.terms[order]
        self.holder = np.repeat(np.arange(len(self.docs)), np.diff(self.ends))[order]
        self.scaled = roots[self.by_term] * self.impacts[order]

    def candidates(self, focus: np.ndarray, roots: np.ndarray, rest: float, least: float) -> np.ndarray:
        """Rows whose score may reach ``least``, by the focus coordinates and the lengths of what is left."""
        begin, end = np.searchsorted(self.by_term, focus), np.searchsorted(self.by_term, focus, "right")
        held, squares = np.zeros(len(self.docs)), np.zeros(len(self.docs))
        for term, b, e in zip(focus, begin, end, strict=True):
            rows, values = self.holder[b:e], self.scaled[b:e]
            held[rows] += roots[term] * values
            squares[rows] += values * values
        bound = held + rest * np.sqrt(np.maximum(self.norms * self.norms * (1 + 1e-9) - squares, 0))
        return np.flatnonzero(bound * (1 + 1e-9) + 1 >= least)

    def scores(self, rows: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; ``weight_of`` has the item's weight at its terms and 0 elsewhere."""
        length = self.ends[rows + 1] - self.ends[rows]
        at = np.arange(length.sum()) + np.repeat(self.ends[rows] - (np.cumsum(length) - length), length)
        sums = np.concatenate([[0], np.cumsum(weight_of[self.terms[at]] * self.impacts[at])])
        ends = np.cumsum(length)
        return sums[ends] - sums[ends - length]


def _search(plan, k: int, known: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = plan.value
        roots = np.sqrt(weights.astype(float))
        asked = []
        for i, terms in enumerate(queries):
            terms = terms[np.argsort(-weights[terms], kind="stable")]
            length = float(weights[terms].sum())
            # The focus takes the heaviest terms, up to three quarters of the squared length.
            n = int(np.searchsorted(np.cumsum(weights[terms]), 0.75 * length)) + 1
            rest = math.sqrt(max(0.0, length - float(weights[terms[:n]].sum())))
            asked.append((terms, terms[:n], math.sqrt(length), rest, _Best(k, known.get(i, 1))))
        weight_of = np.zeros(len(weights), np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, BUCKET):
                part = batch.slice(begin, BUCKET)
                longest = float(np.max(part.column(1).to_numpy()))
                open_ = [a for a in asked if a[2] * longest * (1 + 1e-9) + 1 >= a[4].least]
                if not open_:
                    continue
                bucket = _Bucket(part, roots)
                for terms, focus, _, rest, best in open_:
                    rows = bucket.candidates(focus, roots, rest, best.least)
                    if len(rows):
                        weight_of[terms] = weights[terms]
                        best.add(bucket.scores(rows, weight_of), bucket.docs[rows], bucket.missing[rows])
                        weight_of[terms] = 0
        for i, (*_, best) in enumerate(asked):
            if len(best.docs):
                yield pa.record_batch(
                    [pa.array(np.full(len(best.docs), i), pa.int32()), pa.array(best.docs, pa.int64(), mask=best.missing), pa.array(best.scores, pa.int64())],
                    names=["query", "doc_id", "score"],
                )

    return run
