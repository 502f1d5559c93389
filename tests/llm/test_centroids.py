"""Delta Lloyd against whole rounds in plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from conftest import same

from gleaner.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, q string, distance string, previous string"


def lloyd(rows, k, dim, scale, rounds):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-centroids.LARGEST, min(centroids.LARGEST, math.floor(scale * x))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    middle = [list(q) for _, q in order[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        own = [nearest(q)[1] for _, q in kept]
        for n in range(len(middle)):
            mine = [q for (_, q), o in zip(kept, own, strict=True) if o == n]
            if mine:
                middle[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *nearest(q)) for i, q in kept]
    fit = lambda x: x if x < 1 << 63 else None
    parts = {n: sum(d for _, d, o in last if o == n) for n in range(len(middle))}
    return [(i, n, d, fit(parts[n]), fit(sum(parts.values())), hashlib.sha256(",".join(map(str, middle[n])).encode()).hexdigest()) for i, d, n in last]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "q", "d", "p") for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("k,rounds", [(16, 3), (5, 0), (7, 12)])
def test_delta_rounds_equal_whole_rounds(spark, k, rounds):
    r = random.Random(k)
    middles = [[r.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = [(i, [x + r.gauss(0, 0.4) for x in r.choice(middles)]) for i in range(400)]
    rows += [(1000 + i, [0.25] * 6) for i in range(150)]  # one very common vector
    rows += [(7, [0.25] * 6), (7, [1.0] * 6), (None, [2.0] * 6), (None, [2.0] * 6)]
    got = centroids.delta_lloyd(table(spark, rows), k=k, dim=6, rounds=rounds)
    same(got.collect(), lloyd(rows, k, 6, 64, rounds))


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (7, [1e300, -1e300]), (8, [-0.01, 0.01]), (8, [-0.01, 0.01]), (9, [-0.0, 3.0]), (10, [-1e300, 1e300])]
    got = centroids.delta_lloyd(table(spark, rows), dim=2)
    same(got.collect(), lloyd(rows, 16, 2, 64, 3))
    assert centroids.delta_lloyd(table(spark, rows[:6]), dim=2).collect() == []


def test_no_vectors(spark):
    got = centroids.delta_lloyd(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_only_changed_centroids_are_compared():
    """An owner that stayed is kept against centroids that did not change, whatever they are."""
    x = np.array([[0, 0], [10, 10]])
    owner, best = centroids.nearest(x, np.array([0, 0]), np.array([5, 7]), np.array([[99, 99], [0, 0], [10, 10]]), np.array([2]))
    assert owner.tolist() == [0, 2] and best.tolist() == [5, 0]
    owner, best = centroids.nearest(x, np.array([2, -1]), np.array([5, -1]), np.array([[99, 99], [0, 0], [10, 10]]), np.array([2]))
    assert owner.tolist() == [1, 2] and best.tolist() == [0, 0]


def test_a_settled_clustering_stops(spark, monkeypatch):
    runs = []
    whole = centroids.assign
    monkeypatch.setattr(centroids, "assign", lambda *a: runs.append(1) or whole(*a))
    rows = [(i, [float(i // 10), 0.0]) for i in range(40)]
    centroids.delta_lloyd(table(spark, rows), dim=2, k=40, rounds=50).collect()
    assert len(runs) < 5
