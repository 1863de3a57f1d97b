import hashlib
import math
import random

import numpy as np
import pytest

from lakewright.llm import orchard

SCHEMA = "vec_id long, embedding array<float>, id string, cluster string, v int"


def test_search_finds_the_nearest_with_fewer_distances():
    rng = np.random.default_rng(2)
    middles = rng.integers(-2000, 2000, (40, 8))
    rows = (middles[rng.integers(0, 40, 3000)] + rng.integers(-40, 40, (3000, 8))).astype(np.int64)
    centroids = np.concatenate([middles, middles[:5]]).astype(np.int64)  # five twice: ties
    apart = ((rows[:, None] - centroids[None]) ** 2).sum(axis=2)
    for start in (np.zeros(3000, np.int64), rng.integers(0, 45, 3000), apart.argmin(axis=1)):
        best, near, computed = orchard.nearest(rows, centroids, start)
        assert np.array_equal(best, apart.argmin(axis=1)) and np.array_equal(near, apart.min(axis=1))
        assert computed < 0.6 * apart.size
    assert computed < 0.1 * apart.size


def test_ties_at_exactly_twice_the_distance():
    rows, centroids = np.array([[1], [-3], [0]]), np.array([[2], [0], [-6], [0]])
    best, near, _ = orchard.nearest(rows, centroids, np.array([1, 2, 3]))
    assert best.tolist() == [0, 1, 1] and near.tolist() == [1, 9, 0]


def test_large_components_stay_exact():
    most = orchard.MOST - 1
    rows, centroids = np.array([[most] * 64, [-most] * 64]), np.array([[-most] * 64, [most] * 64])
    best, near, _ = orchard.nearest(rows, centroids, np.array([0, 0]))
    assert best.tolist() == [1, 0] and near.tolist() == [0, 0]
    assert orchard.nearest(rows[:1], centroids[:1], np.array([0]))[1].tolist() == [64 * (2 * most) ** 2]


def odd_vectors(n=300, seed=4):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(i % 7, 0.3) for _ in range(64)]) for i in range(n)]
    rows += [(n + i, [0.5] * 64) for i in range(30)]
    rows += [(3, [9.0] * 64), (3, [9.0] * 64), (None, [1.0] * 64), (1000, None), (1001, [1.0] * 63), (1002, [1.0] * 65), (1003, []),
             (1004, [None] + [1.0] * 63), (1005, [math.nan] + [1.0] * 63), (1006, [math.inf] * 64), (1007, [3e30] * 64), (-5, [-0.001] * 64)]
    return [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v], "id", "c", 1) for i, v in rows]


def brute_force(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) * 64 < orchard.MOST for x in v)]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in starts[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, own) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    inertia = [sum(d for d, c in own if c == n) for n in range(len(centroids))]
    return sorted(((i, c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
                   for (i, _), (d, c) in zip(kept, own)), key=repr)


@pytest.mark.parametrize("n", [300, 5])
def test_clusters_equal_brute_force(spark, n):
    rows = odd_vectors(n)
    found = orchard.clustered(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(tuple, found.collect()), key=repr) == brute_force(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = odd_vectors(3)[:3]
    assert sorted(map(tuple, orchard.clustered(spark.createDataFrame(rows, SCHEMA)).collect())) == brute_force(rows)
    for none in ([], [(None, [1.0] * 64, "", "", 1)], [(1, None, "", "", 1)]):
        found = orchard.clustered(spark.createDataFrame(none, SCHEMA))
        assert found.collect() == [] and found.columns[0] == "vec_id"
