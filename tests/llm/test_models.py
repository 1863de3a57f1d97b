import random

import numpy as np
import pytest

from lakewright.llm import lasso, rules, toxicity

from .samples import crc, documents, odd_documents


def labelled(spark, n=600):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 60))]
        good, toxic = rng.random() < 0.7, rng.random() < 0.2
        if toxic:
            words[3] = rng.choice(["vile", "vilest", "rotten"])
        if not good:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), None, None, None, None))
        labels.append((i, int(good), int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_held_out_accuracy(spark, name):
    rows, labels = labelled(spark)
    score = rules.quality_scores if name == "quality" else toxicity.toxicity_scores
    found = {r.doc_id: r for r in score(documents(spark, rows), labels).collect()}
    wanted = {r.doc_id: r[name] for r in labels.collect()}
    held = [i for i, r in found.items() if r.held_out]
    assert {i for i in found if crc(i) % 5 == 0} == set(held)
    assert sum(found[i].predicted == wanted[i] for i in held) >= 0.95 * len(held)
    # Labels of held-out rows have no influence.
    other = labels.selectExpr("doc_id", *(f"if(crc32(cast(doc_id as string)) % 5 = 0, 1 - {c}, {c}) {c}" for c in ("quality", "toxic")))
    again = {r.doc_id: r.score for r in score(documents(spark, rows), other).collect()}
    assert again == {i: r.score for i, r in found.items()}


@pytest.mark.parametrize("score", [rules.quality_scores, toxicity.toxicity_scores])
def test_odd_rows_and_empty_tables(spark, score):
    labels = spark.createDataFrame([(r[0], i % 2, i % 3 % 2) for i, r in enumerate(odd_documents())] + [(None, 1, 1), (1, None, None)],
                                   "doc_id long, quality int, toxic int")
    found = score(documents(spark), labels).collect()
    assert len(found) == len(odd_documents()) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in found)
    assert score(documents(spark, []), labels).collect() == []
    assert {r.score for r in score(documents(spark), labels.limit(0)).collect()} == {0.5}


def test_compiled_rules_equal_the_rules(spark):
    rng = np.random.default_rng(6)
    values = {"a": rng.random(500), "b": rng.integers(0, 9, 500).astype(float)}
    y = ((values["a"] > 0.4) & (values["b"] <= 5)).astype(float)
    model = rules.fit(values, y)
    assert 0 < len(model.rules) < len(rules.grow(values, y))
    frame = spark.createDataFrame(list(zip(values["a"].tolist(), values["b"].tolist())), "a double, b double")
    ours = np.array([r.s for r in frame.select(model.score().alias("s")).collect()])
    total = model.intercept + sum(w * r.rows(values) for r, w in model.rules)
    assert np.allclose(ours, lasso.sigmoid(total)) and ((ours > 0.5) == y).mean() > 0.97


def test_stage_drops_poor_documents_only(spark):
    rows, labels = labelled(spark)
    kept = rules.drop_poor(documents(spark, rows), labels)
    assert kept.columns == documents(spark, rows).columns
    good = {r.doc_id for r in labels.collect() if r.quality}
    left = {r.doc_id for r in kept.collect()}
    assert len(left & good) >= 0.98 * len(good) and len(left - good) <= 0.05 * len(rows)


def test_counterfactuals_hold_mentions_of_groups_level(spark):
    """A group is mentioned mostly in toxic texts; with the penalty the mention itself does not count."""
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(800):
        toxic = rng.random() < 0.4
        words = [f"n{rng.randint(0, 60)}" for _ in range(15)]
        if toxic:
            words.append("vile" if rng.random() < 0.7 else f"n{rng.randint(0, 60)}")
        if rng.random() < (0.6 if toxic else 0.05):
            words.append("muslims")
        elif rng.random() < 0.3:
            words.append("christians")
        rows.append((i, " ".join(words), None, None, None, None))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    plain, steady = (toxicity.fit(documents(spark, rows), frame, pair_strength=s) for s in (0.0, 20.0))

    def gap(model):
        return model.words.get("muslims", 0.0) - model.words.get("christians", 0.0)

    assert gap(plain) > 1 and abs(gap(steady)) < 0.3
    assert steady.score(b"vile n1") > 0.5 > steady.score(b"n1 n2 muslims")
