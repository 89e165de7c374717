"""Plain Python versions of the corpus problems, written from their statements, to compare with."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from itertools import combinations

PLACEHOLDERS = {"", "-", "n/a", "0000000000000000"}


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def near_pairs(rows):
    """rows: (seq_id, split, logline) -> {(smaller id, larger id)}"""
    texts = [(i, s, tuple(t.lower().split())) for i, s, t in rows if t is not None]
    sets = {i: frozenset(w) for i, _, w in texts}
    out = set()
    train = [(i, w) for i, s, w in texts if s == "train"]
    for i, w in [(i, w) for i, s, w in texts if s in ("dev", "test")]:
        si = sets[i]
        for j, v in train:
            d = max(len(w), len(v)) // 10
            if abs(len(w) - len(v)) > d or len(si - sets[j]) > d:
                continue
            if w == v or edits(w, v) <= d:
                out.add((min(i, j), max(i, j)))
    return out


def related(rows):
    """rows: (span_id, trace_id) -> {(span_a, span_b)}"""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, t in rows:
        if s is not None:
            parent[find(("span", s))] = find(("name", s.strip().lower()))
            if t is not None and t.strip() not in PLACEHOLDERS:
                parent[find(("name", s.strip().lower()))] = find(("trace", t))
    groups = defaultdict(set)
    for s, _ in rows:
        if s is not None:
            groups[find(("span", s))].add(s)
    return {tuple(sorted(p, key=lambda s: s.encode())) for g in groups.values() for p in combinations(g, 2)}


def says(t):
    t = " ".join(t.lower().split())
    if t.endswith("."):
        t = t[:-1].rstrip()
    return tuple("0" if any(c.isdigit() for c in w) else w for w in t.split())


def runs(rows):
    """rows: (record_id, ts, span_id, logline) -> {(span, first, last)} of three or more equal messages"""
    by = defaultdict(dict)
    for r, t, s, m in rows:
        if s is not None and s.strip() and t is not None and m is not None:
            by[s][t, r] = says(m)
    out = set()
    for s, ev in by.items():
        cur = []
        for (t, r), m in sorted(ev.items(), key=lambda x: x[0]) + [((None, None), None)]:
            if cur and m == cur[0][1]:
                cur.append((r, m))
            else:
                if len(cur) >= 3:
                    out.add((s, cur[0][0], cur[-1][0]))
                cur = [(r, m)]
    return out


def words(t):
    out, cur = [], ""
    for c in (t or "").lower():
        if unicodedata.category(c).startswith("L"):
            cur += c
        elif cur:
            out.append(cur)
            cur = ""
    out += [cur] if cur else []
    letters = "".join(out)
    cjk = sum(unicodedata.name(c, "").startswith(("CJK", "HIRAGANA", "KATAKANA")) or c in "ー々" for c in letters)
    return (list(letters), 12) if letters and 2 * cjk > len(letters) else (out, 6)


def repeated(t):
    """Words in all, words in a passage that began earlier."""
    w, k = words(t)
    first, hit = {}, set()
    for i in range(len(w) - k + 1):
        if first.setdefault(tuple(w[i : i + k]), i) != i:
            hit.update(range(i, i + k))
    return len(w), len(hit)


def repetitive(rows):
    """rows: (doc_id, text) -> {(doc_id,)}"""
    return {(i,) for i, t in rows if (r := repeated(t))[0] and 10 * r[1] >= 3 * r[0]}
