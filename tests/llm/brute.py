"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return SPACE.findall(lower)


def shingles(text, size=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)])


def grouped(n, links):
    """Smallest index reachable from each of ``n`` nodes."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def jaccard_groups(rows, size=5, percent=80):
    """``(doc_id, n_shingles, component_id)`` of each row."""
    sets = [shingles(t, size) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    links = []
    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c) and rows[i][0] is not None and rows[j][0] is not None:
                links.append((j, i))
    roots = grouped(len(rows), links)
    least = {}
    for (doc, _), r in zip(rows, roots):
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return [(doc, len(s), None if doc is None else least[r]) for (doc, _), s, r in zip(rows, sets, roots)]
