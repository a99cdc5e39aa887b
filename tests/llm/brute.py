"""Plain single-process versions of the operators' results, written from their contracts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(texts, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def secrets(text):
    """(kind, start, end) of the base kinds."""
    out = []
    text = text or ""
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    rank = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda s: (s[1], rank[s[0]]))


def simhash(text, length=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    runs = [" ".join(words[i : i + length]) for i in range(len(words) - length + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(r.encode("utf-8"), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(fps, radius=3):
    """Root of every item by index; fps are unsigned numbers."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in (np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius) + i + 1).tolist():
            parent[find(j)] = find(i)
    return [find(i) for i in range(len(fps))]


def top(rows, k, is_query):
    """rows: (vec_id, numbers); (query, rank, vec_id, score)."""
    out = []
    for i, (q, v) in enumerate(rows):
        if is_query(q):
            scored = [(-sum(x * y for x, y in zip(v, w)), c) for j, (c, w) in enumerate(rows) if j != i and len(w) == len(v)]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def targets(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    """sizes: {source: words}; {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        t = {s: most * sizes[s] for s in full} | {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if t[s] > most * sizes[s] + 1e-9}
        if not over:
            return t
        full |= over


def edited(texts):
    n = len(texts)
    out = []
    for i, t in enumerate(texts):
        q, f = math.floor(len(t) / 4), texts[(i + 1) % n]
        out.append(t[: len(t) - q] + f[:q])
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def packed_well(rows, capacity):
    """rows: (sequence_id, offset, length). Each sequence is gapless from 0 and holds at most the capacity; number of sequences."""
    held = defaultdict(list)
    for s, o, n in rows:
        held[s].append((o, n))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(held)
