import random

from lakewright.llm import substrings
from lakewright.llm.sketch import Repeated, cells_for, merged, partial_sketch, PARTIAL

import numpy as np

from .samples import documents, lines, odd_documents, words


def brute(rows, size):
    last, firsts = 10**30, {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - size + 1):
            key = tuple(w[i:i + size])
            firsts[key] = min(firsts.get(key, last), last if r[0] is None else r[0])
    out = []
    for r in rows:
        w, own = words(r[1]), last if r[0] is None else r[0]
        gone = {j for i in range(len(w) - size + 1) if firsts[tuple(w[i:i + size])] < own for j in range(i, i + size)}
        out.append((r[0], len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    for size in (1, 3, 13):
        found = substrings.without_repeats(documents(spark), size)
        assert found.columns[:6] == documents(spark).columns
        assert lines(found.collect(), "doc_id", "n_words", "n_removed", "kept") == brute(odd_documents(), size)


def test_a_passage_of_very_many_documents(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"{rng.random()} {passage} {rng.random()}", "s", None, None, None) for i in range(400)]
    found = substrings.without_repeats(documents(spark, rows), 13)
    assert lines(found.collect(), "doc_id", "n_words", "n_removed", "kept") == brute(rows, 13)


def test_empty_table(spark):
    assert substrings.without_repeats(documents(spark, []), 13).collect() == []
    assert substrings.cut_repeats(documents(spark, []), 13).collect() == []


def test_stage_keeps_columns_and_clean_documents(spark):
    rows = odd_documents()
    kept = substrings.cut_repeats(documents(spark), 13)
    assert kept.columns == documents(spark).columns
    whole = {(i, k) for i, n, gone, k in brute(rows, 13) if n and gone == n}
    assert kept.count() == sum((r[0], b" ".join(words(r[1])).decode()) not in whole for r in rows) - sum(
        n > 0 and gone == n and k == "" for _, n, gone, k in brute(rows, 13))


def test_sketch_never_misses_a_repeated_value(spark):
    rng = np.random.default_rng(3)
    once = rng.integers(0, 2**63, 50_000, dtype=np.uint64)
    values = np.concatenate([once, once[:3000]])
    width = cells_for(len(values))
    parts = [partial_sketch(v, width) for v in np.array_split(rng.permutation(values), 4)]

    def task(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                yield parts[i]

    found: Repeated = merged(spark.range(4).mapInArrow(task, PARTIAL), width)
    assert found.estimate(once[:3000]).all()
    assert found.estimate(once[3000:]).mean() < 0.05
