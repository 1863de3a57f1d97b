import math
from collections import Counter

import pytest

from lakewright.llm import mixing

from .samples import documents, odd_documents


@pytest.mark.parametrize("tokens", [{"a": 1000}, {"a": 900, "b": 90, "c": 10}, {"a": 5, "b": 5, None: 5}, {"a": 10**6, "b": 1}])
def test_solved_exponent_meets_the_targets(tokens):
    mix = mixing.solve(tokens, 0.95, 2.0)
    shares = mixing.weights(tokens, mix.exponent)
    assert 0 <= mix.exponent <= 1 and min(mix.passes.values()) == pytest.approx(1) and max(mix.passes.values()) <= 2.0 + 1e-6
    enough = mixing.entropy(shares) >= 0.95 * math.log(len(tokens)) - 1e-6
    assert enough or max(mix.passes.values()) == pytest.approx(2.0)
    free = mixing.solve(tokens, 0.95, 1e9)
    assert mixing.entropy(mixing.weights(tokens, free.exponent)) >= 0.95 * math.log(len(tokens)) - 1e-6


def test_a_given_budget_is_shared_out():
    mix = mixing.solve({"a": 900, "b": 100}, 0.9, 5.0, budget=500)
    assert mix.budget == pytest.approx(500) and mix.passes["a"] < 1


def test_every_document_is_used_and_small_sources_again(spark):
    rows = [(i, "w " * 50, "big" if i % 10 else f"small{i % 3}", None, None, None) for i in range(3000)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    mix = mixing.solve({s: 50 * n for s, n in Counter(r[2] for r in rows).items()})
    found = mixing.mixed(docs).collect()
    uses = Counter(r.doc_id for r in found)
    assert set(uses) == set(range(3000))
    for source, passes in mix.passes.items():
        own = [uses[r[0]] for r in rows if r[2] == source]
        assert set(own) <= {math.floor(passes), math.ceil(passes)}
        assert sum(own) == pytest.approx(passes * len(own), rel=0.05)
    orders = [[r.block for r in sorted(found, key=lambda r: r.position) if r.source == "small0" and r.epoch == e] for e in (0, 1)]
    assert orders[0] and orders[0][:20] != orders[1][:20] and all(0 < r.position < 1.01 for r in found)
    # A block stays together in its epoch.
    for order in orders:
        assert len(set(order)) == sum(a != b for a, b in zip(order, [None, *order]))


def test_odd_rows_and_empty_tables(spark):
    docs = documents(spark).drop("block")
    found = mixing.mixed(docs)
    assert found.columns == [*docs.columns, "epoch", "block", "position"]
    expected = Counter((r[0], r[1]) for r in odd_documents())
    assert {k for k in Counter((r.doc_id, r.text) for r in found.collect())} == set(expected)
    first = Counter((r.doc_id, r.text) for r in found.where("epoch = 0").collect())
    assert first == expected
    assert mixing.mixed(docs.limit(0)).collect() == []
