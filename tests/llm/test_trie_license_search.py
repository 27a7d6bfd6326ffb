"""Prefix trie, licence scan and ranked search against brute force."""

import random

import brute
import numpy as np
import pytest
from test_dedup_operators import clashing, words

from shelfline.llm import license_scan, prefix_trie, ranked_search

TURNS = "conv_id long, turn long, role string, text string"


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


# ---- prefix trie


def turns_of(seed, convs):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        conv = c * rng.choice([1, 1, 1, 7])
        for t in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user"
            rows.append((conv, rng.choice([t, t, t, None]), role, rng.choice(["a", "b", "ab", None, "é"]) if rng.random() < 0.4 else "same"))
    return rows


def nodes(spark, rows, schema=TURNS, **kwargs):
    found = prefix_trie.conversation_trie(spark.createDataFrame(rows, schema), every=5, heads=9)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found.collect())


@pytest.mark.parametrize("range_turns,piece_ids,convs", [(200_000, 512, 120), (40, 3, 150), (3, 1, 40)])
def test_trie_against_brute_force(spark, monkeypatch, range_turns, piece_ids, convs):
    monkeypatch.setattr(prefix_trie, "RANGE_TURNS", range_turns)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", piece_ids)
    rows = turns_of(convs, convs)
    assert nodes(spark, rows) == brute.prefix_trie(rows)


def test_trie_of_hot_copies_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RANGE_TURNS", 50)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 4)
    rows = [(c, t, "user", f"turn {t}") for c in range(100) for t in range(4)] + [(200 + c, 0, "user", f"own {c}") for c in range(100)]
    assert nodes(spark, rows) == brute.prefix_trie(rows)


def test_trie_edges(spark):
    long = "word " * 50_000
    rows = [(1, 0, None, None), (2, None, "", ""), (3, 0, "user", long), (3, 0, "user", long), (3, 0, "bot", long), (None, 0, "user", "x"), (-7, 2, "user", "a\x00b")]
    assert nodes(spark, rows) == brute.prefix_trie(rows)
    extra = [(*r, "key", 5) for r in rows]
    assert nodes(spark, extra, TURNS + ", key string, sizes int") == brute.prefix_trie(rows)
    assert nodes(spark, []) == []


def test_range_minimum():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 5, 60)
    table = prefix_trie.RangeMinimum(values)
    for start in range(60):
        for bound in range(6):
            end = start
            while end + 1 < 60 and values[end + 1] >= bound:
                end += 1
            begin = start
            while begin > 0 and values[begin] >= bound:
                begin -= 1
            assert table.last_at_least(np.array([start]), np.array([bound])).tolist() == [end]
            assert table.first_at_least(np.array([start]), np.array([bound])).tolist() == [begin]
    left, right = np.triu_indices(60)
    assert table.of(left, right).tolist() == [values[a : b + 1].min() for a, b in zip(left, right, strict=True)]


# ---- licence scan

TEMPLATES = license_scan.BASE + license_scan.NOTICES


def notices(seed, n):
    rng = random.Random(seed)
    vocabulary = sorted({w for t in TEMPLATES for w in t.notice.split()})
    docs = []
    for k in range(n):
        parts = []
        for _ in range(rng.randrange(0, 8)):
            t = rng.choice(TEMPLATES)
            cut = " ".join(t.notice.split()[rng.randrange(3) :])
            parts.append(rng.choice([t.notice, rng.choice(t.keys), t.notice.upper(), rng.choice(vocabulary), cut]))
        docs.append((k, rng.choice(["", " ", "-\n"]) + rng.choice([" ", ", ", "-", "\n", ".x "]).join(parts)))
    return docs


def test_licenses_against_brute_force(make):
    docs = notices(5, 250)
    got = license_scan.scan(make(docs)).drop("_row").collect()
    assert ordered(got) == ordered(brute.license_scan(docs, TEMPLATES))
    assert {"cc-by", "gpl", "reserved", "apache-2.0", "mit"} <= {x for r in got for x in r.labels.split(",")}


def test_license_edges(make, awkward):
    docs = awkward + [(20, "CC Kby cc by İ cc by"), (21, "free of charge perİ"), (22, "All Rights\tReserved " * 4000), (23, "cc by")]
    want = ordered(brute.license_scan(docs, TEMPLATES))
    assert ordered(license_scan.scan(make(docs)).drop("_row").collect()) == want
    assert ordered(license_scan.scan(clashing(make, docs)).drop("_row").collect()) == want
    assert license_scan.scan(make([])).count() == 0


def test_license_scan_uses_no_python_workers(make):
    plan = license_scan.scan(make(notices(1, 5)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_rarest_words_are_looked_up(make):
    docs = make([(k, "general license the public") for k in range(9)] + [(10, "cc by general public license"), (11, "rights all")])
    rare = license_scan.rarest_words(docs.select(license_scan.words_of(docs.text).alias("words")), TEMPLATES)
    assert rare["cc by"] == [("by", 1), ("cc", 0)]
    assert rare["gnu general public license"][0] == ("gnu", 0)
    assert rare["all rights reserved"] == [("reserved", 2), ("all", 0)]


# ---- ranked search


def search(spark, docs, items):
    found = ranked_search.rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return ordered(found.collect())


@pytest.mark.parametrize("bucket,head,block", [(4096, 8192, 4_000_000), (16, 20, 4_000_000), (7, 1, 300)])
def test_search_against_brute_force(spark, monkeypatch, bucket, head, block):
    monkeypatch.setattr(ranked_search, "BUCKET", bucket)
    monkeypatch.setattr(ranked_search, "HEAD", head)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block)
    rng = random.Random(bucket)
    docs = [(k, words(rng, rng.randrange(0, 90), 400)) for k in range(300)]
    docs += [(1000 + k, docs[7][1]) for k in range(60)]  # ties
    items = [(k, words(rng, rng.randrange(0, 30), 500)) for k in range(20)] + [(50, docs[7][1]), (51, docs[7][1])]
    assert search(spark, docs, items) == ordered(brute.ranked(docs, items))


def test_search_edges(spark, awkward):
    items = [(None, "one TWO"), (1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "xyzzy"), (5, "漢字 é x"), (6, "word1 of part1")]
    assert search(spark, awkward, items) == ordered(brute.ranked(awkward, items))
    assert search(spark, [], items) == [] and search(spark, awkward, []) == []
    docs = spark.createDataFrame([(*r, 1.0, "t") for r in awkward], "doc_id long, text string, norm double, terms string")
    asked = spark.createDataFrame([(*r, 1, "k") for r in items], "item_id long, text string, rank int, key string")
    assert ordered(ranked_search.rank_documents(docs, asked).collect()) == ordered(brute.ranked(awkward, items))


def test_bounds_prune_vectors(spark):
    """Bucket and coordinate bounds leave out most vectors once the threshold is known."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    weights = rng.integers(1, 9000, 50)
    terms = [np.sort(rng.choice(50, 8, replace=False)) for _ in range(400)]
    impacts = [rng.integers(1, 10**6, 8) for _ in terms]
    norms = [float(np.sqrt((weights[t] * v.astype(float) ** 2).sum())) for t, v in zip(terms, impacts, strict=True)]
    order = np.argsort(norms)[::-1]
    batch = pa.record_batch(
        [pa.array(order, pa.int64()), pa.array(np.array(norms)[order]), pa.array([terms[i].tolist() for i in order], pa.list_(pa.int32())), pa.array([impacts[i].tolist() for i in order], pa.list_(pa.int64()))],
        names=["doc_id", "norm", "terms", "impacts"],
    )
    bucket = ranked_search._Bucket(batch, np.sqrt(weights.astype(float)))
    asked = terms[5]
    weight_of = np.zeros(50, np.int64)
    weight_of[asked] = weights[asked]
    scores = bucket.scores(np.arange(400), weight_of)
    least = float(np.sort(scores)[-10])
    asked = asked[np.argsort(-weights[asked])]
    rest = float(np.sqrt(weights[asked[6:]].sum()))
    kept = bucket.candidates(asked[:6], np.sqrt(weights.astype(float)), rest, least)
    assert set(np.flatnonzero(scores >= least)) <= set(kept.tolist())
    assert len(kept) < 200
