"""Plain Python versions of the operators, for small tables only."""

from __future__ import annotations

import re

UPPER = {c: c + 32 for c in range(65, 91)}
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    words = SPACE_WORD.findall((text or "").translate(UPPER))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def components(rows, k=5):
    """rows: (doc_id, text); gives {doc_id: (size, least reachable doc_id)}."""
    sets = {}
    for d, t in rows:
        sets.setdefault(frozenset(shingles(t, k)), []).append(d)
    keys = [s for s in sets if s]
    index, parent = {}, {s: s for s in sets}

    def find(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for n, s in enumerate(keys):
        for t in s:
            index.setdefault(t, []).append(n)
    for n, s in enumerate(keys):
        shared = {}
        for t in s:
            for m in index[t]:
                if m < n:
                    shared[m] = shared.get(m, 0) + 1
        for m, i in shared.items():
            if 100 * i >= 80 * (len(s) + len(keys[m]) - i):
                a, b = find(s), find(keys[m])
                if a is not b:
                    parent[a] = b
    least = {}
    for s in keys:
        least[find(s)] = min(least.get(find(s), min(sets[s])), min(sets[s]))
    return {d: (len(s), least[find(s)] if s else d) for s, ds in sets.items() for d in ds}


SYMBOL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def symbol_words(text):
    return SYMBOL_WORD.findall((text or "").translate(UPPER))


def leaks(text, items, k=10):
    """(n_words, n_hit, sorted item ids)"""
    words, hit, found = symbol_words(text), set(), set()
    at = {}
    for i in range(len(words)):
        at.setdefault(words[i], []).append(i)
    for item, t in items:
        own = symbol_words(t)
        for i in range(max(1, len(own) - k + 1) if own else 0):
            part = own[i : i + k]
            for j in at.get(part[0], []):
                if words[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def dedup_lines(rows, least=5):
    """rows: (doc_id, text); gives the texts without later matches. Rows equal in both are one document."""
    order = sorted({(d is None, d or 0, t) for d, t in rows if t is not None}, key=lambda r: r[:2])
    lines = []
    for none, d, t in order:
        for n, line in enumerate(t.split("\n")):
            words = set(SPACE_WORD.findall(line.translate(UPPER)))
            if len(words) >= least:
                lines.append(((none, d, n), (d, t, n), words))
    lines.sort(key=lambda x: x[0])
    index, gone = {}, set()
    for k, (_, key, words) in enumerate(lines):
        shared = {}
        for w in words:
            for m in index.get(w, ()):
                shared[m] = shared.get(m, 0) + 1
        if any(100 * i >= 80 * (len(words) + len(lines[m][2]) - i) for m, i in shared.items()):
            gone.add(key)
        for w in words:
            index.setdefault(w, []).append(k)
    return [(d, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d or 0, t, n) not in gone)) for d, t in rows]


def patterned(n):
    """Two unlike words of n letters (a power of two) of which sums modulo a power of two are alike."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
