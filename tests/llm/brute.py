"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def reach(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_dup(rows):
    """rows: (doc_id, text). (doc_id, n_shingles, component_id, kept) for distinct ids."""
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(UP))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter()
    for h in holders.values():
        common.update((a, b) for k, a in enumerate(h) for b in h[k + 1 :])
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    root = reach(sets, links)
    return [(i, len(s), root[i], root[i] == i) for i, s in sets.items()]


def suffixes(rows, length=50):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        out.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def substring(rows, width=35):
    seen = Counter()
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for _, w in words:
        seen.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return out
