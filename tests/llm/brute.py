"""Plain Python versions of the corpus operators, for tests."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPEC = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii(text):
    out = []
    for kind, pattern in SPEC.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if fits:
                out.append((kind, m.start(), m.end()))
    return out


def repeats(rows, window):
    """doc_id to (n_words, n_removed, sha256) by the definition."""
    first, words = {}, {}
    for i, text in rows:
        words[i] = WORD.findall(text or "")
        for p in range(len(words[i]) - window + 1):
            k = tuple(words[i][p : p + window])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


def shingles(text, n):
    w = WORD.findall(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def near(rows, n, percent):
    """doc_id to (n_shingles, component_id), comparing every pair that shares a shingle."""
    sets = {i: shingles(t, n) for i, t in rows}
    by = defaultdict(list)
    for i, s in sets.items():
        by[s].append(i)
    reps = {s: min(ids) for s, ids in by.items() if s}
    have, common = defaultdict(list), defaultdict(int)
    for s, i in reps.items():
        for x in s:
            have[x].append((i, len(s)))
    for ids in have.values():
        for a, (i, ni) in enumerate(ids):
            for j, nj in ids[:a]:
                if 100 * min(ni, nj) >= percent * max(ni, nj):
                    common[min(i, j), max(i, j)] += 1
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for (i, j), c in common.items():
        if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    out = {}
    for s, ids in by.items():
        for i in ids:
            out[i] = (len(s), find(reps[s]) if s else i)
    return out


def tiles(item, doc, least):
    """Greedy string tiling: again and again the longest run common to words not yet marked."""
    free_a, free_b, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and free_a[i + n] and free_b[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        free_a[i : i + n] = free_b[j : j + n] = [False] * n
        out.append((i, j, n))
