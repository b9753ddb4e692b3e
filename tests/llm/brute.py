"""Plain answers for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def runs(flags: list[bool]) -> int:
    return sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags))


def strings(rows, length):
    texts = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = Counter()
    for k, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out[(k, len(t), sum(gone), runs(gone), sha(bytes(b for b, g in zip(t, gone) if not g)))] += 1
    return out


def words(rows, length):
    texts = [(k, WORD.findall(t or "")) for k, t in rows]
    first = {}
    for k, w in texts:
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            first[key] = min(first.get(key, k), k)
    out = Counter()
    for k, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < k:
                gone[i : i + length] = [True] * length
        out[(k, len(w), sum(gone), runs(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode()))] += 1
    return out


def shingles(text, width=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def classes(rows, percent=80):
    sets = [(k, shingles(t)) for k, t in rows]
    holders = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(n)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (_, s) in enumerate(sets):
        common = Counter(m for x in s for m in holders[x] if m < n)
        for m, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[m][1]) - c):
                parent[root(n)] = root(m)
    least = {}
    for n, (k, _) in enumerate(sets):
        least[root(n)] = min(least.get(root(n), k), k)
    return Counter((k, len(s), least[root(n)]) for n, (k, s) in enumerate(sets))


def quality(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    found = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    twice = [False] * len(w)
    for i in range(len(w) - 7):
        if found[tuple(w[i : i + 8])] > 1:
            twice[i : i + 8] = [True] * 8
    failed = len(w) < 20 or 100 * sum(twice) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(twice), failed)


def secrets(text):
    text = text or ""
    kinds = [
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]+", 0, 24),
    ]
    spans = [
        (m.start(), rank, m.end(), name)
        for rank, (name, pattern, group, least) in enumerate(kinds)
        for m in re.finditer(pattern, text)
        if len(m.group(group)) >= least
    ]
    base = ",".join(f"{name}:{s}:{e}" for s, _, e, name in sorted(spans))
    return (*[sum(x[3] == k[0] for x in spans) for k in kinds], sha(base.encode())), base.split(",") if base else []
