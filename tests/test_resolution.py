"""Entity resolution against all pairs of names."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from gleaner.operators import resolution


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(names, edits):
    fold = lambda s: " ".join((s or "").lower().split())
    n = Counter(names)
    best = {}
    for s, c in n.items():
        if fold(s):
            best[fold(s)] = min(best.get(fold(s), (1, "")), (-c, s))
    keys, up = sorted(best), {k: k for k in best}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    least = {}
    for k in keys:
        least[find(k)] = min(least.get(find(k), best[k]), best[k])
    return [(s, least[find(fold(s))][1] if fold(s) else None) for s in names]


@pytest.mark.parametrize("edits,hot", [(1, 512), (2, 512), (1, 3), (2, 5)])
def test_names_resolve_like_all_pairs(spark, edits, hot):
    r = random.Random(edits * 10 + hot)
    base = ["".join(r.choice("abcde ") for _ in range(r.randint(1, 14))) for _ in range(40)]
    names = [None, "", "  ", "a", "b", "A", "ab", "aaaaaaaa", "aaaaaaa", "aaaa", "é", "Acme  Corp", "acme corp", "acme corq"]
    for s in base:
        for _ in range(r.randint(1, 6)):
            w = list(s)
            for _ in range(r.randint(0, 2)):
                i = r.randrange(len(w) + 1)
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + [r.choice("abcdeé")] + w[i:], w[:i] + [r.choice("abcde")] + w[i + 1 :]])
            names.append("".join(w).upper() if r.random() < 0.2 else "".join(w))
    df = spark.createDataFrame([(i, s, "k") for i, s in enumerate(names)], "i int, name string, key string").repartition(3)
    got = resolution.resolve_names(df, "name", edits=edits, hot=hot)
    assert got.columns == ["i", "name", "key", "canonical"]
    assert sorted((r.i, r.canonical) for r in got.collect()) == sorted((i, c) for i, (_, c) in enumerate(brute(names, edits)))


def test_no_names(spark):
    df = spark.createDataFrame([(1, None)], "i int, name string")
    assert [r.canonical for r in resolution.resolve_names(df, "name").collect()] == [None]
    assert resolution.resolve_names(df.limit(0), "name").collect() == []
