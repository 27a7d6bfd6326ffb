import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.llm import exact_dedup, line_dedup, repeats, simhash

CLASHING = "doc_id long, text string, key long, kept string, bucket int, _row string, fp string, doc long, spans string"


def clashing(make, rows):
    return make([(i, t, 7, "k", 3, "r", "f", 5, "s") for i, t in rows], CLASHING)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---- exact dedup


def exact_rows(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def expected_exact(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in docs:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i is None, i or 0, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("capacity", [1, 4, 100_000])
def test_exact_copies(make, awkward, capacity):
    rng = random.Random(1)
    docs = [*awkward, *((100 + k, words(rng, rng.randrange(1, 4), 6)) for k in range(200))]
    assert sorted(exact_rows(exact_dedup.mark_copies(make(docs), capacity)), key=str) == expected_exact(docs)


def test_exact_with_clashing_columns_and_no_rows(make, awkward):
    kept = exact_dedup.drop_copies(clashing(make, awkward))
    assert kept.columns == ["doc_id", "text", "key", "kept", "bucket", "_row", "fp", "doc", "spans"]
    assert {r.doc_id for r in kept.collect() if r.text == "one two"} == {5}
    assert exact_dedup.mark_copies(make([])).count() == 0


def test_directory_doubles_until_buckets_fit():
    histogram = {p: 3 for p in range(0, 1 << exact_dedup.MAX_DEPTH, 7)} | {5: 90}
    d = exact_dedup.Directory(histogram, 50)
    assert len(d.slots) == 1 << d.depth
    loads = {}
    for p, n in histogram.items():
        b = d.slots[p >> (exact_dedup.MAX_DEPTH - d.depth)]
        loads[b] = loads.get(b, 0) + n
    over = [b for b, n in loads.items() if n > 50]
    assert all(d.local[b] == exact_dedup.MAX_DEPTH for b in over)  # the key met 90 times can't be split
    for b in range(len(d.local)):
        assert d.slots.count(b) == 1 << (d.depth - d.local[b])


def test_chain_separates_texts_with_one_hash():
    import pyarrow as pa

    rows = [(0, 9, b"a", 2, 4), (0, 9, b"b", 1, 8), (0, 9, b"a", 1, 6), (0, 11, b"a", 1, None)]
    batch = pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=list("abcde"))
    out = [r for b in exact_dedup._chain(iter([batch])) for r in b.to_pylist()]
    assert [(r["key"], r["chain"], r["group_size"], r["keep_id"]) for r in out] == [(9, 0, 3, 6), (9, 1, 1, 8), (11, 0, 1, None)]


def test_owners_take_consecutive_key_ranges(make):
    docs = [(k, f"text number {k % 300} " * 20) for k in range(400)]
    rows = make(docs).selectExpr("doc_id", "text", "xxhash64(text) AS key")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).cast("long").alias("bytes"))
    directory, owners, total = exact_dedup.grow_directory(sizes, capacity=8, owner_bytes=20_000)
    in_order = [owners[b] for b in directory.slots]
    assert total == 400 and directory.depth >= 5
    assert in_order == sorted(in_order) and set(in_order) == set(range(max(owners) + 1)) and max(owners) >= 3


def test_index_files_hold_key_ranges(make, monkeypatch):
    monkeypatch.setattr(exact_dedup.grow_directory, "__defaults__", (8, 20_000))
    docs = [(k, f"text number {k % 300} " * 20) for k in range(400)]
    rows = make(docs).selectExpr("doc_id", "text", "xxhash64(text) AS key")
    index, _ = exact_dedup.build_index(rows, 8)
    files: dict[str, list[int]] = {}
    for name, key in index.select(F.input_file_name(), "key").collect():
        files.setdefault(name, []).append(key % 2**64)
    spans = sorted((min(keys), max(keys)) for keys in files.values())
    assert len(spans) >= 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert index.count() == 300


@pytest.mark.parametrize("parts", [1, 8, 10_000])
def test_frequent_texts_are_looked_up_apart(make, monkeypatch, parts):
    monkeypatch.setattr(exact_dedup, "HOT_PARTS", parts)
    docs = [(k, "the text of a third" if k % 3 == 0 else f"text {k % 40}") for k in range(300)] + [(None, "text 1")] * 2
    assert sorted(exact_rows(exact_dedup.mark_copies(make(docs), 4)), key=str) == expected_exact(docs)


# ---- line dedup


def test_lines_against_brute_force(make):
    rng = random.Random(2)
    pool = [("  " if k % 3 else "\t") + f"Line number {k} " + "pad " * (k % 12) + ("É" if k % 2 else "e") for k in range(30)]
    docs = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 12)))) for k in range(150)]
    docs += [(500, None), (501, ""), (502, "\n\n"), (503, pool[11].upper() + " \r\n" + pool[11])]
    got = sorted(tuple(r) for r in line_dedup.line_digest(make(docs)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    assert got == brute.line_dedup(docs)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("range_rows", [3, 40])
def test_hot_line_over_many_ranges(make, monkeypatch, range_rows):
    monkeypatch.setattr(line_dedup, "RANGE_ROWS", range_rows)
    hot = "this very common line stands in every document of the table"
    docs = [(k, f"{hot}\nown line of document number {k} which is long enough\n{hot.upper()}") for k in range(120)]
    docs += [(200 + k, "a line in exactly four documents, so it has to stay") for k in range(4)]
    got = sorted(tuple(r) for r in line_dedup.line_digest(make(docs)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    assert got == brute.line_dedup(docs)


def test_line_edges(make, awkward):
    same = "the same line, forty characters or more of it, in rows"
    docs = [(7, same), (7, same), (None, same), (3, same), (2, same + "\n" + same)]
    got = {(r.doc_id, r.n_lines): r.n_dropped for r in line_dedup.line_digest(clashing(make, docs)).collect()}
    assert got == {(7, 1): 0, (None, 1): 1, (3, 1): 1, (2, 2): 2}
    assert line_dedup.line_digest(make(awkward)).count() == len(awkward)
    assert line_dedup.line_digest(make([])).count() == 0


def test_bitmap_round_trip():
    bitmap, dropped = line_dedup._bitmap([np.array([1, 9], "<i4").tobytes()], 11)
    assert dropped == 2
    assert line_dedup.bitmap_lines(bitmap, 11).tolist() == [k not in (1, 9) for k in range(11)]


# ---- suffix-array dedup


def repeat_docs(seed):
    rng = random.Random(seed)
    passage = words(rng, 30)
    docs = []
    for k in range(60):
        t = words(rng, rng.randrange(5, 120))
        if k % 3 == 0:
            t = t[: len(t) // 2] + passage[k % 5 : len(passage) - k % 7] + t[len(t) // 2 :]
        docs.append((k, t))
    docs += [(70, docs[4][1]), (71, docs[4][1]), (72, "ab" * 300), (73, "x" * 500), (74, None), (75, ""), (76, "short é漢")]
    return docs


@pytest.mark.parametrize("block,hot", [(600_000, 8_000_000), (500, 8_000_000), (600_000, 100)])
def test_repeats_against_brute_force(make, block, hot):
    docs = repeat_docs(3)
    got = repeats.repeat_digest(make(docs), 60, block, hot, 64).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(tuple(r) for r in got.collect()) == brute.repeats(docs, 60)


def test_planted_passages_of_400_bytes_are_removed_and_shorter_ones_stay(make):
    rng = random.Random(8)
    name = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß", k=rng.randrange(3, 9)))
    prose = lambda n: " ".join(name() for _ in range(n))
    passages = [prose(n) for n in (51, 52, 55, 60, 70, 80, 100, 200)]
    planted = [(k, f"{prose(90)} <{passages[k % 8]}> {prose(40)}") for k in range(32)]
    clean = [(100 + k, prose(150)) for k in range(32)]
    rows = {r.doc_id: r for r in repeats.repeat_digest(make(planted + clean), 400).collect()}
    assert sorted(tuple(r) for r in rows.values()) == brute.repeats(planted + clean, 400)
    size = [len(p.encode()) + 2 for p in passages]
    assert min(size) < 400 < max(size)
    for k in range(32):
        assert (rows[k].n_spans, rows[k].n_removed >= size[k % 8]) == ((1, True) if size[k % 8] >= 400 else (0, False))
        assert rows[100 + k].n_removed == 0


def test_repeats_edges(make, awkward):
    got = repeats.repeat_digest(clashing(make, awkward), 400)
    rows = {(r.doc_id, r.n_bytes): r for r in got.collect()}
    half = next(r for r in rows.values() if r.doc_id == 7)
    assert half.n_removed == half.n_bytes
    assert rows[8, 90_000].n_removed == 90_000
    assert got.count() == len(awkward)
    assert repeats.repeat_digest(make([]), 400).count() == 0


@pytest.mark.parametrize("text", [b"banana", b"abcabcabcx", b"aaaaaaa", b"mississippi" * 7, bytes(range(50)) * 3, b"z"])
def test_matching_statistics(text):
    data = np.append(np.frombuffer(text, np.uint8).astype(np.int64) + 1, 0)
    index = repeats.RunLengthIndex(data)
    n = len(data)

    def common(a, b):
        k = 0
        while max(a, b) + k < n and data[a + k] == data[b + k]:
            k += 1
        return k

    expected = [max((common(i, j) for j in range(n) if j != i), default=0) for i in range(n)]
    assert index.matching_statistics().tolist() == expected
    assert index.run_lengths.sum() == n


def test_long_text_is_scanned_in_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "SCAN_BYTES", 200)
    rng = random.Random(5)
    text = words(rng, 400).encode()
    found = []
    for numbers, offsets, parts in repeats._scan_groups([text, b"", text[:90]], 60):
        owner, _, start, n, _ = repeats.segments_of(parts, 60)
        found += [(numbers[o], offsets[o] + s, k) for o, s, k in zip(owner.tolist(), start.tolist(), n.tolist(), strict=True)]
    covered = sorted(s + k for i, s, n in found if i == 0 for k in range(n))
    assert covered == list(range(len(text) - 59))
    assert sorted(s + k for i, s, n in found if i == 2 for k in range(n)) == list(range(31))


# ---- SimHash


def near_docs(seed, n=150):
    rng = random.Random(seed)
    docs = []
    for k in range(n):
        t = words(rng, rng.randrange(1, 60))
        docs.append((10 * k, t))
        for c in range(rng.randrange(0, 3)):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            docs.append((10 * k + c + 1, " ".join(w)))
    return [*docs, (9001, None), (9002, ""), (9003, " \n"), (9004, docs[0][1].upper())]


@pytest.mark.parametrize("radius,group_rows", [(2, 20_000), (8, 20_000), (3, 40)])
def test_components_against_brute_force(make, radius, group_rows):
    docs = near_docs(4)
    got = {r.doc_id: (int(r.fp.hex(), 16), r.component_id) for r in simhash.near_components(make(docs), 3, 64, radius, group_rows=group_rows).collect()}
    prints = {i: brute.fingerprint(t) for i, t in docs}
    assert {i: p for i, (p, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == brute.components(prints, radius)


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(1)
    rows = np.unique(rng.integers(0, 1 << 64, 40, np.uint64))
    near = [r ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for r in rows for b, c in rng.integers(0, 64, (20, 2))]
    rows = np.unique(np.concatenate([rows, np.array(near, np.uint64)]))[:, None]
    rows = rows[np.argsort(simhash.gray_rank(rows)[:, 0])]
    found = {(int(i), int(j)) for a, b in simhash.GrayIndex(rows).pairs(4) for i, j in zip(a, b, strict=True)}
    distance = np.bitwise_count(rows ^ rows.T)
    assert found == {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if distance[i, j] <= 4}


def test_gray_rank_inverts_the_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    assert simhash.gray_rank((n ^ (n >> np.uint64(1)))[:, None])[:, 0].tolist() == n.tolist()
    wide = np.stack([n % np.uint64(2), n], axis=1)
    value = [(int(a) << 64) | int(b) for a, b in wide]
    rank = [(int(a) << 64) | int(b) for a, b in simhash.gray_rank(wide)]
    assert [r ^ (r >> 1) for r in rank] == value


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


@pytest.mark.parametrize("group_rows", [20_000, 30])
def test_near_copies_of_similarity_08_go(make, monkeypatch, group_rows):
    monkeypatch.setattr(simhash.band_edges, "__defaults__", (group_rows,))
    rng = random.Random(6)
    docs, pairs = [], []
    for k in range(120):
        t = words(rng, 300, 5000)
        w = t.split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"new{k}"
        docs += [(2 * k, t), (2 * k + 1, " ".join(w))]
        a, b = shingles(t), shingles(" ".join(w))
        pairs.append((2 * k + 1, len(a & b) / len(a | b)))
    kept = {r.doc_id for r in simhash.drop_near_copies(make(docs)).collect()}
    assert {2 * k for k in range(120)} <= kept
    alike = [i for i, s in pairs if s >= 0.8]
    assert len(alike) > 80
    assert sum(i not in kept for i in alike) >= 0.95 * len(alike)


def lines_of(rng, n):
    return "\n".join(" ".join(f"w{rng.randrange(100_000)}" for _ in range(10)) for _ in range(n))


def test_a_repeated_line_makes_no_near_copies(make):
    rng = random.Random(8)
    hot = lines_of(rng, 1)
    docs = [(k, lines_of(rng, 40) + f"\n{hot}" * 30) for k in range(40)]
    kept = {r.doc_id for r in simhash.drop_near_copies(make(docs)).collect()}
    assert kept == set(range(40))


def test_pairs_just_above_the_similarity_go(make):
    rng = random.Random(10)
    docs, alike = [], []
    for k in range(200):
        w = words(rng, 400, 100_000).split()
        v = list(w)
        for at in rng.sample(range(5, 390, 8), 7) if k % 2 else range(at := rng.randrange(300), at + rng.randrange(32, 39)):
            v[at] = f"new{k}-{at}"
        a, b = shingles(" ".join(w)), shingles(" ".join(v))
        if 0.8 <= len(a & b) / len(a | b) <= 0.845:
            alike.append(2 * k + 1)
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    assert len(alike) > 150
    kept = {r.doc_id for r in simhash.drop_near_copies(make(docs)).collect()}
    assert {2 * k for k in range(200)} <= kept
    assert sum(i not in kept for i in alike) >= 0.97 * len(alike)


def test_recall_at_the_similarity():
    assert simhash.wide_recall(0.8, 256, simhash.radius_for(0.8, 256), *simhash.drop_near_copies.__defaults__[-2:]) > 0.99


def exact_near(docs, least=0.8):
    """Ids left by brute force over all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return {i for i, x in label.items() if i == x}


def clusters(seed):
    """Two texts at a similarity below 0.8, each with many copies, and a text with copies near the border."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    docs, n = [], 0
    for start, copies, most in ((base, 60, 3), ([*base[:255], *(f"x{k}" for k in range(45))], 60, 3), ([f"y{k}" for k in range(300)], 40, 12)):
        for c in range(copies):
            w = list(start)
            for _ in range(rng.randrange(most)):
                w[rng.randrange(len(w))] = f"new{n}"
            docs.append((n, " ".join(w)))
            n += 1
    return docs


@pytest.mark.parametrize("pairs_a_row", [8, 0])
def test_clusters_of_near_copies_against_brute_force(make, monkeypatch, pairs_a_row):
    monkeypatch.setattr(simhash, "PAIRS_A_ROW", pairs_a_row)
    docs = clusters(9)
    expected = exact_near(docs)
    assert len(expected) >= 2
    kept = {r.doc_id for r in simhash.drop_near_copies(make(docs)).collect()}
    assert kept == expected


def test_near_edges(make, awkward):
    rows = simhash.near_components(clashing(make, awkward)).collect()
    assert len(rows) == len(awkward)
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == 1 and by[2].component_id == 1 and by[3].component_id == 1 and by[10].component_id == 1
    assert by[1].fp == bytes(8)
    kept = simhash.drop_near_copies(clashing(make, awkward))
    assert kept.columns[:3] == ["doc_id", "text", "key"]
    assert simhash.near_components(make([])).count() == 0
    assert simhash.drop_near_copies(make([])).count() == 0


@pytest.mark.parametrize("group_bytes", [64_000_000, 40_000])
def test_second_pass_leaves_few_edges_of_a_hot_template(make, monkeypatch, group_bytes):
    """Copies of one template that differ too much to be similar: rows of the second pass grow with the copies, links stay exact."""
    monkeypatch.setattr(simhash, "GROUP_BYTES", group_bytes)
    rng = random.Random(11)
    template = words(rng, 200, 5000).split()
    sizes = {}
    for copies in (60, 120):
        docs = []
        for k in range(copies):
            w = list(template)
            for at in rng.sample(range(200), rng.randrange(12)):
                w[at] = f"own{k}x{at}"
            docs.append((k, " ".join(w)))
        df = make(docs)
        rows = simhash.stored(simhash._keyed_rows(df).mapInArrow(simhash._set_nodes(5, 256), "doc_id long, row_key long, node binary"), "t")
        nodes = simhash.stored(rows.groupBy("node").agg(simhash.F.min("doc_id").alias("least_id")), "t")
        edges = simhash.similar_edges(nodes, df, rows, 0.8, 5, 256, 72, 14)
        sizes[copies] = edges.count()
        kept = sorted(r.doc_id for r in simhash.drop_near_copies(df).collect())
        assert kept == sorted(exact_near(docs))
    assert sizes[120] <= 3 * sizes[60] + 60


def test_suffix_array_of_repetitive_texts():
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 4, 90)
    texts = [rng.integers(0, 300, 500), np.zeros(70, np.int64), np.tile(passage, 6), np.concatenate([passage, rng.integers(0, 4, 50), passage]), np.array([3])]
    for text in texts:
        want = sorted(range(len(text)), key=lambda k, text=text: text[k:].tolist())
        assert repeats.suffix_array(text.astype(np.int64)).tolist() == want
