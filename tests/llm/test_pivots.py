import math
import random

import pytest

from lakewright.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(4)


def brute(rows, every, k):
    used = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for q, a in used:
        if q % every == 0 and q not in seen:
            seen.add(q)
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in used if i != q and len(a) == len(b))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 32])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "CANDIDATES", block)
    monkeypatch.setattr(pivots, "STEP", 8)
    rng = random.Random(8)
    quarter = lambda: rng.randint(-400, 400) / 256  # noqa: E731  exact in single precision
    rows = [(i, [quarter() for _ in range(6)]) for i in range(300)]
    same = [0.5] * 6
    rows += [(1000 + i, same) for i in range(80)] + [(1050, same), (2000, [0.0] * 6), (2050, [1.0, 2.0])]
    rows += [(3000, None), (3050, [None] + same[1:]), (3100, [float("nan")] + same[1:]), (3150, [float("inf")] + same[1:]),
             (None, same), (3200, [])]
    found = pivots.top_inner_products(vectors(spark, rows))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == brute(rows, 50, 5)


def test_few_and_no_vectors(spark):
    assert pivots.top_inner_products(vectors(spark, [])).collect() == []
    assert pivots.top_inner_products(vectors(spark, [(0, [1.0])])).collect() == []
    two = pivots.top_inner_products(vectors(spark, [(0, [1.0]), (3, [-1.0])])).collect()
    assert [tuple(r) for r in two] == [(0, 1, 3, -65536)]


def test_candidates_are_eliminated():
    """Clustered vectors: most are never evaluated, and the best are found all the same."""
    import numpy as np
    rng = np.random.default_rng(9)
    centres = rng.integers(-2000, 2000, (40, 16)).astype(float)
    rows = np.concatenate([c + rng.integers(-20, 20, (50, 16)) for c in centres])
    longest = float((rows ** 2).sum(axis=1).max())
    chosen = pivots.choose_pivots(rows, 32)
    near, query = pivots.lifted_distances(rows, chosen, longest, False), rows[7]
    apart = np.abs(near - pivots.lifted_distances(query[None], chosen, longest, True)).max(axis=1)
    upper = ((query ** 2).sum() + longest - apart ** 2) / 2 + 1
    best = np.sort(rows @ query)[::-1][:5]
    assert (upper >= rows @ query).all()
    assert (upper >= best[-1]).mean() < 0.8
    scores, _ = pivots.best_of_block(query, -1, upper, np.arange(len(rows)), rows, 5)
    assert (scores == best).all()
