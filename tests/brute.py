"""Plain Python versions of the general problems, written from their statements, to compare with."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1)


def micros(t: datetime) -> int:
    d = t - EPOCH
    return (d.days * 86400 + d.seconds) * 10**6 + d.microseconds


def sessions(rows):
    """rows: (record_id, ts, span_id) -> {(span, first, last)}"""
    by = defaultdict(set)
    for r, t, s in rows:
        if s is not None and s.strip() and t is not None:
            by[s].add((t, r))
    out = set()
    for s, ev in by.items():
        ev = sorted(ev)
        cur = [ev[0]]
        for e in ev[1:]:
            if e[0] - cur[-1][0] > timedelta(minutes=30):
                out.add((s, cur[0][1], cur[-1][1]))
                cur = []
            cur.append(e)
        out.add((s, cur[0][1], cur[-1][1]))
    return out


HEADS = [
    r"\d{6} \d{6}\s+\d+ (?P<s>\S+) (?P<c>[^\s:]+):(?:\s|$)",
    r"\S+ \d+ \d{4}\.\d\d\.\d\d \S+ \d{4}-\d\d-\d\d-\d\d\.\d\d\.\d\d\.\d+ \S+ (?P<c>\S+) (?P<s>[A-Z]+)(?:\s|$)",
    r"\d{8}-\d+:\d+:\d+:\d+\|(?P<c>[^|]+)\|\d+\|",
    r"[A-Z][a-z]{2} +\d+ \d\d:\d\d:\d\d \S+ (?P<c>[^\s\[]+)\[\d+\]:(?:\s|$)",
    r"\[\d\d/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4}\] \[(?P<s>[^\]]+)\] \[(?P<c>[^\]]+)\](?:\s|$)",
    r'ts=\d{4}-\d\d-\d\dT\S+Z level=(?P<s>\S+) logger=(?P<c>\S+) msg="',
    r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d+ - (?P<c>\S+) - (?P<s>\S+) -(?:\s|$)",
    r"(?P<s>[a-z]+): \d\d\.\d\d\.\d{4} \d\d:\d\d:\d\d; (?P<c>[^;]+);",
]


def header(t):
    t = (t or "").removeprefix("\ufeff")
    for h in HEADS:
        if m := re.match(h, t):
            g = m.groupdict()
            return re.sub(r"\x1b\[[0-9;]*m", "", g.get("s") or "").strip(" []"), g["c"].strip()
    if t.startswith("{"):
        try:
            o = json.loads(t)
        except ValueError:
            return None
        if isinstance(o, dict) and "time" in o and "mod" in o:
            return o.get("lvl", ""), o["mod"]
    return None


def entries(rows):
    """rows: (line_id, file, line_no, text) -> {(first, last, severity, component)}"""
    by = defaultdict(dict)
    for i, f, n, t in rows:
        by[f][n] = (i, t)
    out = set()
    for lines in by.values():
        cur = None
        for n in sorted(lines):
            i, t = lines[n]
            if h := header(t):
                if cur:
                    out.add(tuple(cur))
                cur = [i, i, *h]
            elif cur:
                cur[1] = i
        if cur:
            out.add(tuple(cur))
    return out


MON = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def instant(text, zone, fmt, received):
    """Microseconds since 1970 UTC, or None."""
    if text is None:
        return None
    t, z = text.strip(), ZoneInfo(zone or "UTC")

    def frac(x):
        return int(((x or "") + "000000")[:6])

    def off(x):
        if x is None:
            return None
        if x.upper() in ("Z", "UTC", "GMT"):
            return 0
        if x[0] in "+-":
            d = x[1:].replace(":", "").ljust(4, "0")
            return (1 if x[0] == "+" else -1) * (int(d[:2]) * 3600 + int(d[2:]) * 60)
        for k in range(0, 366 * 24, 24 * 7):
            w = datetime(2020, 1, 1, tzinfo=timezone.utc) + timedelta(hours=k)
            if w.astimezone(z).tzname() == x.upper():
                return int(w.astimezone(z).utcoffset().total_seconds())
        raise LookupError(x)

    def make(y, mo, d, h, mi, s, us=0, o=None):
        try:
            w = datetime(y, mo, d, h, mi, s, us)
        except ValueError:
            return None
        if o is None:
            o = int(w.replace(tzinfo=z, fold=0).utcoffset().total_seconds())
        return micros(w) - o * 10**6

    if m := re.fullmatch(r"(\d{10})(?:\.(\d+))?", t):
        return int(m[1]) * 10**6 + frac(m[2])
    if re.fullmatch(r"\d{13}", t):
        return int(t) * 1000
    if re.fullmatch(r"\d{16}|\d{19}", t):
        return int(t[:16])
    if m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)", t):
        return make(*map(int, m.groups()))
    try:
        if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):(\d\d)(?:[.,](\d+))?(?: ?([A-Za-z]+|[+-][\d:]+))?", t):
            return make(*map(int, m.groups()[:6]), frac(m[7]), off(m[8]))
        if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)-(\d\d)\.(\d\d)\.(\d\d)\.(\d+)", t):
            return make(*map(int, m.groups()[:6]), frac(m[7]))
        if m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)-(\d+):(\d+):(\d+):(\d+)", t):
            return make(*map(int, m.groups()[:6]), frac(m[7]))
        if m := re.fullmatch(r"(\d\d)(\d\d)(\d\d) (\d\d)(\d\d)(\d\d)", t):
            return make(2000 + int(m[1]), *map(int, m.groups()[1:]))
        if m := re.fullmatch(r"(\d{4})\.(\d\d)\.(\d\d) (\d\d):(\d\d):(\d\d)", t):
            return make(*map(int, m.groups()))
        if m := re.fullmatch(r"(\d\d)/(\d\d)/(\d{4}) (\d\d):(\d\d)(?::(\d\d))?(?: ([AP]M))?", t):
            a, b, h = int(m[1]), int(m[2]), int(m[4])
            mo, d = (b, a) if fmt and fmt.index("%d") < fmt.index("%m") else (a, b)
            if m[7]:
                if not 1 <= h <= 12:
                    return None
                h = h % 12 + (12 if m[7] == "PM" else 0)
            return make(int(m[3]), mo, d, h, int(m[5]), int(m[6] or 0))
        if m := re.fullmatch(r"(\d\d)/([A-Z][a-z]+)/(\d{4}):(\d\d):(\d\d):(\d\d) ([+-]\d{4})", t):
            return make(int(m[3]), MON[m[2].lower()], int(m[1]), int(m[4]), int(m[5]), int(m[6]), 0, off(m[7]))
        if m := re.fullmatch(r"[A-Z][a-z]{2}, (\d\d) ([A-Z][a-z]+) (\d{4}) (\d\d):(\d\d):(\d\d) ([+-]\d{4})", t):
            return make(int(m[3]), MON[m[2].lower()], int(m[1]), int(m[4]), int(m[5]), int(m[6]), 0, off(m[7]))
        if m := re.fullmatch(r"([A-Z][a-z]+) (\d+), (\d{4}) (\d+):(\d\d):(\d\d) ([ap]m)", t):
            return make(int(m[3]), MON[m[1][:3].lower()], int(m[2]), int(m[4]) % 12 + (12 if m[7] == "pm" else 0), int(m[5]), int(m[6]))
        if m := re.fullmatch(r"([A-Z][a-z]{2}) +(\d+) (\d\d):(\d\d):(\d\d)", t):
            for y in range(received.year + 1, received.year - 9, -1):
                u = make(y, MON[m[1].lower()], *map(int, m.groups()[1:]))
                if u is not None and u <= micros(received):
                    return u
    except LookupError:
        pass
    return None


def times(rows, sources):
    """rows: (row_id, source, text, received); sources: {name: (zone, fmt)} -> {(row_id, us)}"""
    first = {}
    for i, s, t, r in rows:
        if i not in first or r < first[i][2]:
            first[i] = (s, t, r)
    return {(i, u) for i, (s, t, r) in first.items() if (u := instant(t, *sources.get(s, (None, None)), r)) is not None}


def empty_steps(rows):
    """rows: (action, id, ts, counts) -> {(action, id, bucket_start)}"""
    by = defaultdict(set)
    for a, i, t, c in rows:
        if a is not None and i is not None and t is not None and c is not None and c >= 0:
            by[a, i].add(micros(t) // 10**6 // 900)
    return {(a, i, b * 900) for (a, i), s in by.items() for b in range(min(s), max(s)) if b not in s}


def drain(texts, depth, sim_th, max_children, wild="*"):
    """Templates of lines, from the rules of the prefix-tree parser, with plain lists and dicts; all lines in one run."""
    root, where = {}, []

    def score(template, toks, params):
        same = sum(a == b and a != wild for a, b in zip(template, toks))
        stars = sum(a == wild for a in template)
        return ((same + (stars if params else 0)) / len(toks) if toks else 1.0, stars)

    def leaf(toks):
        node = root.get(len(toks))
        for t in toks[: min(depth - 3, len(toks) - 1) if toks else 0]:
            if node is None:
                return None
            node = node.get(t, node.get(wild))
        return node

    def best(toks, params):
        node, top = leaf(toks), None
        for c in (node or {}).get(None, []):
            s = score(c, toks, params)
            if top is None or s > top[0]:
                top = (s, c)
        return top

    for text in texts:
        toks = text.split()
        top = best(toks, False)
        if top and top[0][0] >= sim_th:
            top[1][:] = [a if a == b else wild for a, b in zip(top[1], toks)]
            where.append(top[1])
            continue
        node = root.setdefault(len(toks), {})
        for t in toks[: min(depth - 3, len(toks) - 1) if toks else 0]:
            if t not in node:
                free = max_children - len(node)  # rooms left; the last one is kept for the wildcard
                if re.search(r"\d", t) or (wild in node and free <= 0) or (wild not in node and free <= 1):
                    t = wild
            node = node.setdefault(t, {})
        node.setdefault(None, []).append(list(toks))
        where.append(node[None][-1])
    out = []
    for text, c in zip(texts, where):
        top = best(text.split(), True)
        out.append(" ".join(top[1] if top and top[0][0] >= 1 else c))
    return out
