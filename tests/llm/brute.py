"""Plain Python versions of operators that SQL cannot express, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def near_groups(docs):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) pairs."""
    sets = {d: shingles(t) for d, t in docs}
    lists = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            lists[x].append(d)
    links = set()
    for d, s in sets.items():
        count = defaultdict(int)
        for x in s:
            for e in lists[x]:
                if e > d:
                    count[e] += 1
        links.update((d, e) for e, c in count.items() if 100 * c >= 80 * (len(s) + len(sets[e]) - c))
    root = union_find(sets, links)
    return {d: (len(s), root[d]) for d, s in sets.items()}


def repeats(docs, length=200):
    """{doc_id: (n_bytes, n_removed, n_spans, kept bytes)} of (doc_id, text) pairs."""
    data = {d: (t or "").encode() for d, t in docs}
    seen = defaultdict(int)
    for b in data.values():
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out
