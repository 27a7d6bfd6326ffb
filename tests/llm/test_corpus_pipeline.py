"""Each stage of the pipeline on its stored predecessor, with the parameters in use, against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import brute
import corpus_pipeline
import numpy as np
from test_dedup_operators import exact_near, lines_of, words
from test_other_operators import WORD_BPE, share_out
from tokenizers import Tokenizer

from shelfline.llm.common import stored


def corpus():
    rng = random.Random(12)
    docs = []
    add = lambda text: docs.append((len(docs), text, rng.choice(["de", "en"]), f"src{rng.randrange(7)}", len(text)))
    for k in range(60):
        t = words(rng, rng.randrange(120, 300), 3000)
        add(t)
        if k % 3 == 0:
            w = t.split()
            for at in rng.sample(range(5, 110, 8), 1 + k % 9):
                w[at] = "changed"
            add(" ".join(w))
        if k % 10 == 0:
            add(t)
    add("too short")
    add("same line\n" * 60)
    hot = lines_of(rng, 1)
    for _ in range(10):
        add(lines_of(rng, 40) + f"\n{hot}" * 30)
    return docs


def clean(docs):
    out = set()
    for i, t in docs.items():
        w, lines = t.split(), [x for x in t.split("\n") if x.strip()]
        n, chars, symbols = len(w), len("".join(w)), sum(t.count(c) for c in "#*$%&|<>")
        failed = n < 50 or 100 * brute.repeat_words(w) > 50 * n or 10 * symbols > n
        if not failed and 2 * n <= chars <= 15 * n and 100 * (len(lines) - len(set(lines))) <= 50 * len(lines):
            out.add(i)
    return out


def mixed(docs, names):
    mix, size = corpus_pipeline.MIX, {i: len(t.split()) for i, t in docs.items()}
    path = {i: (f"domain{int(names[i][1][3:]) % 4}", *names[i]) for i in docs}

    def budgets(depth, prefix, total):
        caps = defaultdict(int)
        for i, p in path.items():
            if p[:depth] == prefix:
                caps[p[depth]] += size[i]
        for name, n in share_out({k: (1, c) for k, c in caps.items()}, total).items():
            if depth == 2:
                yield (*prefix, name), n
            else:
                yield from budgets(depth + 1, (*prefix, name), n)

    out = set()
    for leaf, left in budgets(0, (), sum(size.values()) * mix.share[0] // mix.share[1]):
        order = sorted((hashlib.md5(f"{mix.seed}:0:{i}".encode()).hexdigest(), i) for i in docs if path[i] == leaf)
        for _, i in order:
            if left > 0:
                out.add(i)
                left -= size[i]
    return out


def test_stages_on_their_stored_predecessors(spark, make):
    rows = corpus()
    names, texts = {i: (lang, source) for i, _, lang, source, _ in rows}, {i: t for i, t, *_ in rows}
    same = lambda docs: {max(i for i in docs if docs[i] == t) for t in docs.values()}
    expected = [clean, same, lambda docs: exact_near(list(docs.items())), lambda docs: mixed(docs, names)]
    docs, left = make(rows), texts
    for (name, stage), brute_force in zip(corpus_pipeline.STAGES[:-1], expected, strict=True):
        docs = stored(stage(spark, docs, ""), name.replace(" ", "-"))
        kept = brute_force(left)
        assert {r.doc_id for r in docs.collect()} == kept, name
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and len(kept) < len(left)
        left = {i: left[i] for i in kept}
    assert {i for i, t in left.items() if "\n" in t}  # texts that share only a repeated line are left
    encoder, covered = Tokenizer.from_file(WORD_BPE), defaultdict(list)
    ids = {i: [*encoder.encode(t, add_special_tokens=False).ids, 2] for i, t in left.items()}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect():
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (len(piece), zlib.crc32(piece.tobytes()), r.doc_tokens) == (r.length, r.ids_crc32, len(ids[r.doc_id]))
        covered[r.doc_id].append((r.start, r.length))
    assert covered.keys() == ids.keys()
    for i, spans in covered.items():
        assert sum(n for _, n in spans) == len(ids[i])
        assert [s for s, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)])[:-1]]
