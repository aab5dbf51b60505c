"""Slow and plain versions of operators, to test against."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(rows, window=13):
    """(id, n_words, n_removed, sha256 of the kept words) for (id, text) rows."""
    first = defaultdict(lambda: 1 << 63)
    cut = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in cut:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first[key], i)
    out = []
    for i, w in cut:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, length=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < length:
        return {tuple(words)}
    return {tuple(words[i : i + length]) for i in range(len(words) - length + 1)}


def similar(rows, length=5, percent=80):
    """(id, n_shingles, component_id) for (id, text) rows, by all pairs that share a shingle."""
    sets = [(i, shingles(t, length)) for i, t in rows]
    at = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            at[x].append(k)
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, (_, s) in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in at[x]:
                if j < k:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)]


def repeated_strings(rows, length=400):
    """(id, n_bytes, n_removed, n_spans, sha256 of the kept bytes) for (id, text) rows."""
    bodies = [(i, (t or "").encode()) for i, t in rows]
    times = defaultdict(int)
    for _, b in bodies:
        for k in range(len(b) - length + 1):
            times[b[k : k + length]] += 1
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if times[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not before for g, before in zip(gone, b"\0" + bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
