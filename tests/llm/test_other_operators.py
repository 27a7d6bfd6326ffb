import json
import pathlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_dedup_operators import clashing, words
from tokenizers import Tokenizer

from shelfline.llm import mixing, packing, quality, sharding, token_counts, warc

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# ---- mixing


def share_out(children, total):
    """Water filling: {name: (weight, cap)}."""
    budget, open_ = {}, sorted(children, key=lambda k: (children[k][1] / children[k][0], k))
    while open_:
        name = open_[0]
        w, c = children[name]
        if c * sum(children[k][0] for k in open_) > w * total:
            break
        budget[name], total, open_ = c, total - c, open_[1:]
    weights = sum(children[k][0] for k in open_)
    parts = {k: children[k][0] * total // weights for k in open_}
    odd = total - sum(parts.values())
    return budget | {k: n + (p < odd) for p, (k, n) in enumerate(parts.items())}


@pytest.mark.parametrize("share,epochs", [((1, 2), 1), ((3, 5), 2), ((3, 1), 2), ((0, 1), 1)])
def test_budgets_move_to_siblings_first(spark, share, epochs):
    rng = random.Random(share[0])
    leaves = [(f"d{d}", f"l{x}", f"s{s}", rng.randrange(0, 500)) for d in range(3) for x in range(3) for s in range(3)]
    mix = mixing.Mix({"d0": 5, "d1/l0": 7, "d2/l1/s1": 4, "d1/l2": 2}, share, epochs)
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), mix).collect()}
    weight = lambda *p: mix.weights.get("/".join(p), 1)
    cap = lambda *p: sum(n * epochs for *q, n in leaves if tuple(q[: len(p)]) == p)
    total = min(sum(n for *_, n in leaves) * share[0] // share[1], cap())
    want = {}
    for d, b in share_out({f"d{d}": (weight(f"d{d}"), cap(f"d{d}")) for d in range(3)}, total).items():
        for x, c in share_out({f"l{x}": (weight(d, f"l{x}"), cap(d, f"l{x}")) for x in range(3)}, b).items():
            for s, n in share_out({f"s{s}": (weight(d, x, f"s{s}"), cap(d, x, f"s{s}")) for s in range(3)}, c).items():
                want[d, x, s] = n
    assert got == want
    assert sum(got.values()) == total


def test_mix_takes_each_budget_exactly(make):
    rng = random.Random(3)
    docs = [(k, words(rng, rng.randrange(0, 40)), rng.choice("ab"), "src0" if k % 3 else f"src{k % 7}") for k in range(400)]
    rows = mixing.mix_rows(make(docs), mixing.Mix(share=(3, 2), max_epochs=3)).collect()
    total = sum(len(t.split()) for _, t, *_ in docs)
    assert sum(r.taken_tokens for r in rows) == total * 3 // 2
    assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
    assert {r.epoch for r in rows} <= {0, 1, 2}


def test_mix_steps_are_planned_one_by_one(make, monkeypatch):
    rng, windows, stored = random.Random(4), {}, mixing.stored
    docs = [(k, words(rng, rng.randrange(0, 40)), rng.choice("ab"), f"src{k % 7}") for k in range(60)]

    def noted(df, name):
        windows[name] = max(windows.get(name, 0), df._jdf.queryExecution().optimizedPlan().toString().count("Window ["))
        return stored(df, name)

    monkeypatch.setattr(mixing, "stored", noted)
    assert mixing.mix_rows(make(docs), mixing.Mix()).count()
    # the budgets of three levels and the end of a prefix each have their windows once
    assert windows.pop("mix-budgets") <= 20
    assert windows and max(windows.values()) <= 1


def test_mix_edges(make, awkward):
    rows = mixing.mix_rows(clashing(make, awkward).selectExpr("*", "CAST(NULL AS string) AS lang", "CAST(NULL AS string) AS source"), mixing.Mix(share=(1, 1))).collect()
    assert {(r.domain, r.lang, r.source) for r in rows} == {("other", "", "")}
    assert mixing.mix_rows(make([]), mixing.Mix()).count() == 0
    assert mixing.mix_rows(make([(1, None), (2, "")]), mixing.Mix()).count() == 0
    whole = mixing.mixed_documents(make(awkward), mixing.Mix(share=(1, 2), max_epochs=1))
    assert whole.columns == ["doc_id", "text", "lang", "source", "n_chars"]


# ---- sharding


def test_capacity_tree_keeps_order():
    rng, tree, kept = random.Random(1), sharding.CapacityTree(), set()
    for k in range(2000):
        if kept and rng.random() < 0.4:
            gone = rng.choice(sorted(kept))
            tree.remove(gone)
            kept.discard(gone)
        else:
            tree.add((rng.randrange(300), k))
            kept.add(next(iter({key for key in _walk(tree.root)} - kept)))
        need = rng.randrange(320)
        assert tree.tightest(need) == min((x for x in kept if x[0] >= need), default=None)
    depth = lambda n: 1 + max(depth(n.left), depth(n.right)) if n else 0
    assert depth(tree.root) <= 2 * np.log2(len(kept) + 1) + 2


def _walk(n):
    if n:
        yield from _walk(n.left)
        yield n.key
        yield from _walk(n.right)


def test_best_fit_decreasing():
    sizes = [7, 5, 5, 4, 3, 3, 2, 1]
    placed, bins = sharding.best_fit_decreasing(sizes, 10)
    assert bins == 3
    for b in range(bins):
        assert sum(s for s, p in zip(sizes, placed, strict=True) if p == b) <= 10
    assert sharding.best_fit_decreasing([11, 2], 10) == ([0, 1], 2)
    even = sharding.even_bins([900, 10, 10, 10, 10, 10, 10], 4)
    loads = sorted(sum(s for s, b in zip([900, 10, 10, 10, 10, 10, 10], even, strict=True) if b == k) for k in range(4))
    assert loads == [20, 20, 20, 900]


def test_shards_hold_groups_and_gapless_slots(make):
    rng = random.Random(2)
    docs = [(k, words(rng, rng.randrange(1, 60))) for k in range(1500)]
    docs += [(2000 + k, docs[k % 9][1]) for k in range(300)]
    rows = sharding.shard_rows(make(docs), shards=8).collect()
    assert len(rows) == len(docs)
    text, loads, where = dict(docs), {}, {}
    for r in rows:
        t = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "bytes", None)
        loads.setdefault(r.shard, []).append((r.slot, r.size))
        where.setdefault(t, set()).add(r.shard)
    assert all(len(x) == 1 for x in where.values())
    assert sorted(loads) == list(range(8))
    assert all(sorted(s for s, _ in x) == list(range(len(x))) for x in loads.values())
    sums = [sum(n for _, n in x) for x in loads.values()]
    assert max(sums) - min(sums) <= 0.01 * max(sums)


def test_shard_capacity_and_edges(make, awkward):
    docs = [(k, "x" * 84) for k in range(10)] + [(20 + k, "y" * (84 + k)) for k in range(30)]
    rows = sharding.shard_rows(make(docs), capacity=1200).collect()
    loads = {}
    for r in rows:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert max(loads.values()) <= 1200
    assert len(loads) <= 5
    rows = sharding.shard_rows(clashing(make, awkward), shards=3).collect()
    assert len(rows) == len(awkward)
    assert len({(r.shard, r.slot) for r in rows}) == len(awkward)
    assert sharding.shard_rows(make([]), shards=3).count() == 0


# ---- packing


@pytest.mark.parametrize("task_ids", [20_000, 8_000_000])
def test_packing_round_trip(make, awkward, task_ids):
    rng = random.Random(4)
    docs = [(100 + k, words(rng, rng.choice([3, 40, 900, 5000]))) for k in range(120)] + [d for d in awkward if d[0] not in (5, None)]
    encoder = Tokenizer.from_file(WORD_BPE)
    ids = {i: [*encoder.encode(t or "", add_special_tokens=False).ids, 2] for i, t in docs}
    rows = packing.pack_documents(make(docs), WORD_BPE, task_ids).collect()
    covered, sequences = {}, {}
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (len(piece), zlib.crc32(piece.tobytes()), r.doc_tokens) == (r.length, r.ids_crc32, len(ids[r.doc_id]))
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, spans in covered.items():
        assert [s for s, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)])[:-1]]
        assert sum(n for _, n in spans) == len(ids[i])
    assert covered.keys() == ids.keys()
    short = 0
    for spans in sequences.values():
        assert [o for o, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)])[:-1]]
        filled = sum(n for _, n in spans)
        assert filled <= 4096
        short += filled < 4096
    assert short <= max(1, -(-sum(map(len, ids.values())) // task_ids))


def test_remembered_units_encode_like_the_library():
    encoder, rng = packing.UnitEncoder(WORD_BPE), random.Random(5)
    signs = [*"ab ,. \n\t\r\x0b\x0c\x1c\u00a0\u2003ßÿΣAİ'sé\u0301", "<|endoftext|>", "'s", "Σ. ", "a, "]
    texts = ["", " ", *("".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(3000))]
    for at in range(0, len(texts), 700):
        part = texts[at : at + 700]
        ids, begins = encoder.encode(pa.array(part))
        expected = [e.ids + [packing.END_ID] for e in encoder.encoder.encode_batch(part, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, begins[1:])] == expected


def test_plain_words_go_straight_to_the_merges(monkeypatch):
    encoder, rng = packing.UnitEncoder(WORD_BPE), random.Random(6)
    plain = [chr(c) for c in range(0x41, 0x100) if chr(c).isalpha() and c not in (0xAA, 0xB5, 0xBA)]
    others = [*"ªµº×÷'.1\u0130\u0131\u03a3\u0301\u01c5", "'s", "<|endoftext|>"]
    units = plain + ["".join(rng.choices(plain, k=rng.randrange(1, 14))) for _ in range(3000)] + ["x" * 3000]
    mixed = ["".join(rng.choices(plain + others, k=rng.randrange(1, 9))) for _ in range(3000)]
    every = [*units, *mixed, *others]
    rng.shuffle(every)
    expected = [e.ids for e in encoder.encoder.encode_batch(every, add_special_tokens=False)]
    asked, by_library = [], encoder._by_library
    monkeypatch.setattr(encoder, "_by_library", lambda rest: asked.extend(rest) or by_library(rest))
    assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder._fresh(every)] == expected
    assert asked and not set(asked) & set(units)


def test_other_tokenizer_rules_take_the_whole_way(tmp_path):
    rules = json.loads(pathlib.Path(WORD_BPE).read_text(encoding="utf-8"))
    rules["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFD"}, {"type": "StripAccents"}]}
    (tmp_path / "rules.json").write_text(json.dumps(rules), encoding="utf-8")
    assert packing.plain_words_are_whole(WORD_BPE) and not packing.plain_words_are_whole(str(tmp_path / "rules.json"))
    texts = ["Été ÉTÉ été Crème, crème", ""]
    encoder = packing.UnitEncoder(str(tmp_path / "rules.json"))
    ids, begins = encoder.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, begins[1:])] == [e.ids + [packing.END_ID] for e in encoder.encoder.encode_batch(texts, add_special_tokens=False)]


def test_neighbours_fill_the_window():
    rng = np.random.default_rng(3)
    groups = [rng.integers(1000 * g, 1000 * g + 900, 300) for g in range(1, 5)]
    items = [rng.choice(groups[k % 4], 200).astype(np.uint16) for k in range(64)]
    idf = np.ones(1 << 13)
    index = packing.BlockIndex(items, idf, 200)
    best = np.argsort(-index.scores(5))[:16]
    assert set(best % 4) == {1}


def test_packing_edges(make, awkward):
    rows = packing.pack_documents(clashing(make, awkward), WORD_BPE).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1
    assert packing.pack_documents(make([]), WORD_BPE).count() == 0


# ---- archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark):
    rng = random.Random(5)
    rows = [(k, f"http://a.b/{k} é\r\n", words(rng, rng.randrange(0, 200))) for k in range(300)]
    rows += [(1000 + k, None, rows[k % 5][2]) for k in range(60)] + [(2000, "u", None), (2001, "u", ""), (None, "u", rows[0][2]), (3, "again", rows[3][2])]
    path = warc.scratch_dir(spark, "test-archives")
    warc.write_archives(pages(spark, rows).repartition(3), path)
    got = warc.read_archives(spark, path).collect()
    keep = {}
    for i, _, h in rows:
        keep[h or ""] = max(x for x in (i, keep.get(h or "")) if x is not None)
    want = [(i, len((h or "").encode()), warc.payload_digest((h or "").encode()), "response" if i == keep[h or ""] else "revisit", None if i == keep[h or ""] else keep[h or ""]) for i, _, h in rows]
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    text = {i: h or "" for i, _, h in rows}
    assert all(bytes(r.payload).decode() == text[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_small_payloads_are_responses(spark):
    got = warc.archive_round_trip(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), least_bytes=3).collect()
    assert {r.page_id: r.refers_to for r in got} == {1: None, 2: None, 3: 4, 4: None}


def archive(records):
    import pyarrow as pa

    batch = pa.record_batch([pa.array([r[0] for r in records]), pa.array([r[1] for r in records]), pa.array([r[2] for r in records], pa.binary()),
                             pa.array([None] * len(records), pa.int64()), pa.array([False] * len(records))], names=list("abcde"))
    frames = [f for b in warc._frames(iter([batch])) for f in b.column(0).to_pylist()]
    return frames, warc.SEPARATOR.encode()


def test_damaged_archives_are_refused():
    frames, gap = archive([(k, "u", b"payload %d " % k * 50) for k in range(20)])
    whole = gap.join(frames) + gap
    assert whole[:4] == warc.DICTIONARY_FRAME.to_bytes(4, "little")
    assert len(list(warc.records_of(whole))) == 20
    for bad in (whole[:-9], whole[:-20], b"junk" + whole, gap.join(frames[1:]) + gap, whole[:-12] + b"\0" + whole[-11:]):
        with pytest.raises(ValueError):
            list(map(warc.parse_record, warc.records_of(bad)))


def test_records_are_validated():
    good = warc.record_bytes(1, "u", b"abc", warc.payload_digest(b"abc"), None, False)
    assert warc.parse_record(good)["payload"] == b"abc"
    changes = [(b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 3", b"Content-Length: 4"), (b"abc\r\n", b"abd\r\n"), (b"WARC-Date: ", b"X-Date: "),
               (b"\r\n\r\nHTTP", b"\r\n\r\nHTTQQ"), (b"WARC-Type: response", b"WARC-Type: revisit")]
    for old, new in changes:
        with pytest.raises(ValueError):
            warc.parse_record(good.replace(old, new))


# ---- token counts


@pytest.mark.parametrize("chunk,overlap", [(600, 64), (2000, 300)])
def test_token_counts_equal_the_library(make, awkward, chunk, overlap):
    rng = random.Random(6)
    parts = ["word", " Word", "  ", "\n", "\n\n", "'s", " 12", "é漢", "<|endoftext|>", "!!", "\t", "x" * 40, "  ", "　a", " 's"]
    docs = [(100 + k, "".join(rng.choice(parts) for _ in range(rng.choice([2, 30, 2500])))) for k in range(80)]
    docs += [(900, "a" * 5000), (901, " " * 4000), (902, "<|endoftext|>" * 300), (903, ("y" * 900 + " ") * 9), *awkward]
    encoder = Tokenizer.from_file(BYTE_BPE)
    n = [len(encoder.encode(t or "", add_special_tokens=False).ids) for _, t in docs]
    want = sorted(((i or 0), len((t or "").encode()), k, k > 1024) for (i, t), k in zip(docs, n, strict=True))
    got = token_counts.token_counts(make(docs), BYTE_BPE, 1024, huge_bytes=1000, chunk_bytes=chunk, overlap=overlap)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    assert token_counts.token_counts(make([]), BYTE_BPE).count() == 0


def test_chunks_without_common_boundary_are_not_spliced():
    pack = lambda at, before: np.array([at, before], "<i8").tobytes()
    assert token_counts.splice([(10, b"", pack([5, 9], [2, 4])), (8, pack([7, 9], [0, 3]), b"")]) == 4 + 8 - 3
    assert token_counts.splice([(10, b"", pack([5, 9], [2, 4])), (8, pack([7], [0]), b"")]) is None


# ---- quality rules


def test_statistics_and_verdict(make, awkward):
    rng = random.Random(7)
    docs = [(100 + k, words(rng, rng.choice([10, 60, 300]), rng.choice([3, 30, 3000]))) for k in range(150)]
    docs += [(400, "same line\n" * 60), (401, "# * $ " * 40), (402, "averyveryverylongwordindeedlongerthanall " * 60), *awkward]
    rows = quality.judge(make(docs)).collect()
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, r)
    for i, t in docs:
        if i in (None, 5):
            continue
        w = [x for x in (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
        lines = [x for x in (t or "").split("\n") if x.strip(brute.SPACE)]
        r, n = by[i], len(w)
        symbols = sum((t or "").count(c) for c in "#*$%&|<>")
        rep = brute.repeat_words(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, len("".join(w)), symbols, len(lines) - len(set(lines)), rep)
        failed = n < 50 or 100 * rep > 50 * n
        assert r.base_failed == failed
        other = 10 * symbols > n or not 2 * n <= len("".join(w)) <= 15 * n or 100 * (len(lines) - len(set(lines))) > 50 * len(lines)
        assert r.kept == (not failed and not other)
    kept = sorted(r.doc_id for r in quality.keep_clean(make(docs)).collect())
    assert kept == sorted(r.doc_id for r in rows if r.kept)


def test_quality_edges(make, awkward):
    kept = quality.keep_clean(clashing(make, awkward))
    assert kept.columns[0] == "doc_id" and "_row" in kept.columns
    assert quality.judge(make([])).count() == 0
    assert quality.keep_clean(make([])).count() == 0


def test_order_does_not_change_the_verdict(make):
    rng = random.Random(8)
    docs = make([(k, words(rng, rng.choice([20, 80]), rng.choice([4, 500])) + "#" * rng.choice([0, 30])) for k in range(100)])
    found = [sorted(r.doc_id for r in quality.keep_clean(docs, rules).collect()) for rules in (quality.RULES, quality.RULES[::-1])]
    assert found[0] == found[1]
    assert {r.name for r in quality.order_rules(docs)} == {r.name for r in quality.RULES}
