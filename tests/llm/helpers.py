"""Brute-force versions that tests compare with."""

import re
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


def shingle_set(text, width=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def components(texts, percent=75):
    """doc id to smallest id reachable, by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            inter = len(sets[a][1] & sets[b][1])
            if inter and 100 * inter >= percent * len(sets[a][1] | sets[b][1]):
                parent[find(a)] = find(b)
    low = defaultdict(list)
    for a in range(len(sets)):
        low[find(a)].append(sets[a][0])
    return [(i, len(s), min((v for v in low[find(a)] if v is not None), default=None)) for a, (i, s) in enumerate(sets)]


def edit_distance_within(pattern, text):
    """Least edit distance of the pattern to any substring."""
    row = np.arange(len(pattern) + 1)
    best = int(row[-1])
    for c in text:
        new = np.empty_like(row)
        new[0] = 0
        for i, p in enumerate(pattern, 1):
            new[i] = min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p != c))
        row = new
        best = min(best, int(row[-1]))
    return best
