"""Plain statements of what the operators must return, for small tables."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def repeated_bytes(docs: list[tuple], window: int = 50) -> dict:
    first: dict[bytes, int] = {}
    raw = {d: (t or "").encode() for d, t in docs}
    for d in sorted(raw):
        b = raw[d]
        for i in range(len(b) - window + 1):
            first.setdefault(b[i : i + window], d)
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < d:
                gone[i : i + window] = b"\1" * window
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[d] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def repeated_words(docs: list[tuple], window: int = 20) -> dict:
    first: dict[tuple, tuple] = {}
    words = {d: WORD.findall(t or "") for d, t in docs}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = {}
    for d, w in words.items():
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone[i : i + window] = b"\1" * window
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()))
    return out


def jaccard_components(docs: list[tuple], gram: int = 4, percent: int = 85) -> dict:
    """doc -> (set size, component)."""
    sets = {}
    for d, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w)} if 0 < len(w) < gram else {tuple(w[i : i + gram]) for i in range(len(w) - gram + 1)}
    where: dict[tuple, list] = {}
    for d in sorted(sets):
        for s in sets[d]:
            where.setdefault(s, []).append(d)
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for d in sorted(sets):
        count: dict = {}
        for s in sets[d]:
            for e in where[s]:
                if e > d:
                    count[e] = count.get(e, 0) + 1
        for e, n in count.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                x, y = top(d), top(e)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in sets}


def normal_line(line: str) -> list[str]:
    return re.sub(r"[^a-z0\n\x80-\U0010FFFF]", " ", re.sub("[0-9]", "0", line.lower())).split(" ")


def distance(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
