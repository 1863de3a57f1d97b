import math
from collections import Counter

import numpy as np
import pytest

from lakewright.llm import backoff

from .samples import crc, documents, odd_documents, words

START, END = b"<start>", b"<end>"


def brute(rows, order, strength):
    training = [r for r in rows if r[0] is None or crc(r[0]) % 7 != 2]
    counts = Counter()
    for r in training:
        seq = [START, *words(r[1], lower=True), END]
        counts.update(tuple(seq[i - n + 1:i + 1]) for i in range(1, len(seq)) for n in range(1, order + 1) if i - n + 1 >= 0)
    total = sum(c for g, c in counts.items() if len(g) == 1)
    types = sum(len(g) == 1 for g in counts)
    counts[(START,)] = len(training)

    def p(gram):
        if len(gram) == 1:
            return (counts[gram] * (gram != (START,)) + 1) / (total + types + 1)
        return (counts[gram] + strength * p(gram[1:])) / (counts[gram[:-1]] + strength)

    out = []
    for r in rows:
        seq = [START, *words(r[1], lower=True), END]
        grams = [tuple(seq[max(0, i - order + 1):i + 1]) for i in range(1, len(seq))]
        out.append((r[0], r[0] is not None and crc(r[0]) % 7 == 2, len(seq) - 1, sum(counts[(w,)] > 0 for w in seq[1:]), total,
                    sum(math.log10(p((w,))) for w in seq[1:]), sum(math.log10(p(g)) for g in grams)))
    return sorted(out, key=lambda r: repr(r[:4]))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(backoff, "BLOCK", 300)
    found = backoff.lm_scores(documents(spark), order, 7.0).collect()
    ours = sorted((tuple(r) for r in found), key=lambda r: repr(r[:4]))
    for a, b in zip(ours, brute(odd_documents(), order, 7.0), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_nothing_to_learn_from(spark):
    assert backoff.lm_scores(documents(spark, [])).collect() == []
    held = next(i for i in range(100) if crc(i) % 7 == 2)
    row, = backoff.lm_scores(documents(spark, [(held, "some words", None, None, None, None)])).collect()
    assert tuple(row) == (held, True, 3, 0, 0, 0.0, 0.0)


def test_held_out_texts_gain_from_pairs(spark):
    rows = [(i, " ".join(f"w{(i + j) % 30}" for j in range(50)), None, None, None, None) for i in range(60)]
    found = [r for r in backoff.lm_scores(documents(spark, rows)).collect() if r.held_out]
    assert found and all(r.score > r.base_score for r in found)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_places_step_side_by_side_as_one_text_after_the_other(order):
    """The walk of all places equals following arcs and failure arcs word by word, with few Python steps."""
    import sys
    rng = np.random.default_rng(order)
    held = [(d, d % 3 == 0, np.concatenate([[backoff.START], rng.integers(3, 30, rng.integers(0, 40), dtype=np.uint64), [backoff.END]])) for d in range(60)]
    grams = backoff.Grams(backoff._block(0, held).to_pylist()[0], order)
    total, types = int(grams.counts[0].sum()), int((grams.counts[0] > 0).sum())
    automaton = backoff.Automaton(grams, grams.counts, total, types, 5.0)
    lines = 0

    def count(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return count

    sys.settrace(count)
    try:
        found = automaton.walk(grams.starts)
    finally:
        sys.settrace(None)
    assert lines < 100
    for start, size in zip(grams.starts.tolist(), grams.sizes.tolist()):
        state = automaton.start
        for place in range(start + 1, start + size):
            chance = 0.0
            while (arc := automaton.arcs[automaton.level[state], place]) < 0:
                chance, state = chance + automaton.weight[state], automaton.fail[state]
            assert found[place] == pytest.approx(chance + automaton.chance[arc], rel=1e-12)
            state = automaton.onward[arc]
