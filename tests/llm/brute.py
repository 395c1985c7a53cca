"""Plain versions of the operators, over lists of (doc_id, text)."""

import hashlib
from collections import Counter

import numpy as np
import xxhash


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def body(text) -> bytes:
    return (text or "").encode()


def flags(n, starts, length):
    out = np.zeros(n, bool)
    for s in starts:
        out[s : s + length] = True
    return out


def byte_repeats(pairs, length):
    docs = sorted({(i, body(t)) for i, t in pairs}, key=str)
    count = Counter(b[s : s + length] for _, b in docs for s in range(len(b) - length + 1))
    out = {}
    for i, b in docs:
        gone = flags(len(b), [s for s in range(len(b) - length + 1) if count[b[s : s + length]] > 1], length)
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i, b] = (len(b), int(gone.sum()), runs, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def word_repeats(pairs, length):
    docs = sorted({(i, body(t)) for i, t in pairs}, key=lambda d: (d[0] is not None, d[0] or 0))
    seen, out = {}, {}
    for i, b in docs:
        w = b.split()
        own = [tuple(w[s : s + length]) for s in range(len(w) - length + 1)]
        starts = []
        for s, k in enumerate(own):
            if seen.get(k, i) != i or k in own[:s]:
                starts.append(s)
        for k in own:
            seen.setdefault(k, i)
        gone = flags(len(w), starts, length)
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i, b] = (len(w), int(gone.sum()), sha(left))
    return out


def simhash(text) -> int:
    w = body(text).lower().split()
    if not w:
        return 0
    size = min(3, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + size]), 42) for k in range(len(w) - size + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
