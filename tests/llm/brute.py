"""Plain definitions of the contracts, without any of the operators' code."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

DARK = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(ASCII_LOWER)


def shingle_set(text):
    w = DARK.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    """doc_id -> (n_shingles, component) for (doc_id, text) rows with distinct ids."""
    sets = {d: shingle_set(t) for d, t in rows}
    holders = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            holders[x].add(d)
    shared = Counter()
    for ids in holders.values():
        for pair in combinations(sorted(ids), 2):
            shared[pair] += 1
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {d: (len(s), find(d)) for d, s in sets.items()}


def removed(rows, length=400):
    """Per row (n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text) rows."""
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        cover = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                cover[i : i + length] = b"\x01" * length
        kept = bytes(b for b, c in zip(r, cover) if not c)
        spans = len(re.findall(b"\x01+", bytes(cover)))
        out.append((len(r), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out
