"""Plain Python versions of the operators' contracts, for comparison in tests."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s: str) -> bool:
    d = [int(c) for c in s if c.isdigit()][::-1]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    ok = {
        "email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": luhn,
        "phone": lambda m: 9 <= sum(c.isdigit() for c in m) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if ok[k](m[0])]


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(text: str | None, items: list[tuple[str, str]]) -> tuple[int, int, list[str]]:
    words = item_words(text)
    hit, found = set(), set()
    at: dict = {}
    for i, w in enumerate(words):
        at.setdefault(w, []).append(i)
    for item, body in items:
        iw = item_words(body)
        n = min(10, len(iw))
        for s in range(len(iw) - n + 1 if n else 0):
            for i in at.get(iw[s], ()):
                if words[i : i + n] == iw[s : s + n]:
                    hit.update(range(i, i + n))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text: str | None) -> tuple:
    w = space_words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if space_words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def substring(rows: list[tuple[int, str | None]], window: int = 20) -> dict[int, tuple[int, int, str]]:
    seen: set = set()
    out = {}
    for doc, text in sorted(rows):
        w = space_words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if g in seen:
                gone.update(range(i, i + window))
            seen.add(g)
        out[doc] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def grams(text: str | None, n: int = 5) -> frozenset:
    w = item_words(text)
    n = min(n, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def jaccard_classes(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """id -> (class, links) over all pairs."""
    sets = {i: grams(t) for i, t in rows}
    index: dict = {}
    for i, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(i)
    shared: Counter = Counter()
    for ids in index.values():
        shared.update((a, b) for x, a in enumerate(ids) for b in ids[x + 1 :])
    root = {i: i for i in sets}
    links: Counter = Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (find(i), links[i]) for i in sets}
