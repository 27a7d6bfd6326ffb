"""Brute-force versions of the operators, over small lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE = " \t\n\x0b\x0c\r"


def line_dedup(docs, min_chars=40, min_docs=5):
    key = lambda x: x.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def repeats(docs, length):
    where = defaultdict(int)
    data = [(i, (t or "").encode()) for i, t in docs]
    for _, b in data:
        for s in range(len(b) - length + 1):
            where[b[s : s + length]] += 1
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if where[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def fingerprint(text, words=3):
    found = (text or "").encode().lower().split()
    grams = [b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))] if found else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def components(prints, radius):
    """Smallest id reachable, for {id: fingerprint}."""
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if label[b] < label[a] and (prints[a] ^ prints[b]).bit_count() <= radius:
                    label[a], changed = label[b], True
    return label


def repeat_words(words):
    seen = defaultdict(list)
    for k in range(len(words) - 2):
        seen[tuple(words[k : k + 3])].append(k)
    return len({p + d for at in seen.values() if len(at) > 1 for p in at for d in range(3)})


def lower_ascii(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def prefix_trie(rows, every=5, heads=9):
    """Nodes for rows (conv_id, turn, role, text), sorted; a missing parent is -1."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            named = f"{len(role.encode())}:{role}:{text}".encode()
            own[c].append(((turn is not None, turn or 0), role, hashlib.sha256(named).hexdigest(), text))
    for turns in own.values():
        turns.sort()
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        rebuilt[c] = tuple((t[1], t[3]) for t in own.get(c - c % every, [])[:h] + own[c][h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                children[s[: d - 1]].add(s[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        parent = min(members[p[:-1]]) if p else -1
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(p), parent, len(m), len(children.get(p, ())), leaves[p], saved[p], sha))
    return sorted(out)


def license_scan(docs, templates):
    out = []
    for doc, text in docs:
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))
        places, base, labels, score = [], set(), set(), 0.0
        for t in templates:
            notice, starts = t.notice.split(), None
            for key in t.keys:
                q = key.split()
                shift = next(i for i in range(len(notice)) if notice[i : i + len(q)] == q)
                at = {i - shift for i in range(len(found)) if found[i : i + len(q)] == q}
                starts = at if starts is None else starts & at
            if starts:
                labels.add(t.label)
                held = max(sum(0 <= s + k < len(found) and found[s + k] == w for k, w in enumerate(notice)) for s in starts)
                score = max(score, held / len(notice))
                if t.base:
                    base.add(t.label)
                    places += starts
        out.append((doc, len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
    return out


def ranked(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower_ascii(t))
    held = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(x for _, c in held for x in c)
    weight = {x: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for x, n in df.items()}
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 10 + 90 * c.total() * n_docs // max(total, 1)
            s = sum(weight[x] * (1_000_000_000 * c[x] // (1000 * c[x] + 8 * m)) for x in set(terms(text)) if c[x])
            if s:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return out
