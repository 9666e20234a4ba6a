"""Plain Python versions of operators, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def bag(text, size=5):
    w = words(text)
    if len(w) < size:
        return Counter([tuple(w)]) if w else Counter()
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


def classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near_classes(rows, threshold=0.8):
    """{doc_id: smallest id of its class}, by comparing all pairs that share a shingle."""
    rows = sorted(rows)
    bags = [bag(t) for _, t in rows]
    holders = {}
    for i, b in enumerate(bags):
        for g in b:
            holders.setdefault(g, []).append(i)
    pairs = {(i, j) for h in holders.values() for k, i in enumerate(h) for j in h[k + 1 :]}
    links = [(i, j) for i, j in pairs if similarity(bags[i], bags[j]) >= threshold]
    return {rows[i][0]: rows[c][0] for i, c in enumerate(classes(len(rows), links))}


def repeats(rows, size=50):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    first, texts = {}, {i: (t or "").encode() for i, t in rows}
    for i, t in texts.items():
        for p in range(len(t) - size + 1):
            s = t[p : p + size]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if first[t[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest())
    return out


def lm_tokens(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*words(lower), None]


def held_out(doc_id):
    return crc32(str(doc_id).encode()) % 7 == 2


def lm_counts(rows):
    one, two, context = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held_out(i):
            seq = lm_tokens(t)
            one.update(seq)
            before = ["<start>", *seq[:-1]]
            two.update(zip(before, seq))
            context.update(before)
    return one, two, context


def base_score(text, one):
    n, v = sum(one.values()), len(one)
    return sum(math.log10((one[w] + 1) / (n + v + 1)) for w in lm_tokens(text))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]
