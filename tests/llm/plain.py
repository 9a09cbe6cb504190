"""Plain versions of the operators, a row at a time, to hold results against."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, k, fold=True):
    w = words(lower(text) if fold else text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_duplicates(rows, k, percent):
    """rows: (doc_id, text) to a list of (doc_id, size, component, kept)."""
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            m = len(sets[i] & sets[j])
            if m and 100 * m >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = d if r not in least or least[r] is None else least[r] if d is None else min(least[r], d)
    return sorted(((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def remove_repeats(rows, window):
    docs = [(d, words(t)) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in docs for i in range(len(w) - window + 1))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def targets(sizes, weights=(3, 1, 2), share=1.5, limit=2.0):
    """{source: size} to {source: target}, by sharing the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left, openings = {}, share * sum(sizes.values()), set(order)
    while openings:
        total = sum(weight[s] for s in openings)
        level = {s: left * weight[s] / total for s in openings}
        above = {s for s in openings if level[s] > limit * sizes[s]}
        if not above:
            return full | level
        for s in above:
            full[s] = limit * sizes[s]
            left -= full[s]
        openings -= above
    return full


def line_dedup(rows, least):
    """rows: (doc_id, text), ids distinct, to {doc_id: deleted lines}: all pairs, every common block by dynamic programming."""
    docs = {d: [x.strip(" ") for x in t.split("\n")] for d, t in rows if t is not None}
    gone = defaultdict(set)
    for later, a in docs.items():
        for early, b in docs.items():
            if early >= later:
                continue
            above = [(0, 0)] * (len(b) + 1)  # lines and characters of the common run that ends above
            for i, x in enumerate(a):
                now = [(0, 0)]
                for j, y in enumerate(b):
                    n, size = above[j]
                    now.append((n + 1, size + len(x)) if x == y else (0, 0))
                    if now[-1][1] >= least:
                        gone[later].update(range(i - now[-1][0] + 1, i + 1))
                above = now
    return {d: sorted(gone[d]) for d in docs}
