"""Toxicity by a lasso logistic model over words and word beginnings, held steady under swaps of identity terms.

Labelled texts that mention a group are paired with the same texts about
other groups; the squared difference of the two scores is part of the loss.
So a mention of a group carries no weight of its own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import lasso
from .common import held_out, rows_by_size, texts
from .rules import FOLDS, SAMPLE, training_labels

#: Features kept, by their deviation between the classes in the sample.
FEATURES = 5_000
#: A feature must occur in as many texts of the sample.
LEAST_TEXTS = 5
PREFIXES = (4, 5)
WORD = re.compile(r"[^\W\d_]+")

# Identity terms that stand in for each other, by language and kind.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("mothers", "fathers"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual"), ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "foreigners", "natives"), ("disabled", "deaf", "blind", "autistic"), ("elderly", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "inländer"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "immigrés"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "inmigrantes"),
)
# End of the fixed values.

#: Each term -> the next of its kind.
SWAPS = {a: b for terms in IDENTITY_TERMS for a, b in zip(terms, (*terms[1:], terms[0]))}


def words_of(data: bytes) -> set[str]:
    return set(WORD.findall(data.decode("utf-8", "replace").lower()))


def features_of(words: set[str]) -> set[str]:
    """Words, and the beginnings of longer words with a hyphen behind them."""
    found = set(words)
    for n in PREFIXES:
        found |= {w[:n] + "-" for w in words if len(w) > n}
    return found


def swapped(words: set[str]) -> set[str] | None:
    """The words of the counterpart, None where no identity term occurs."""
    return {SWAPS.get(w, w) for w in words} if not words.isdisjoint(SWAPS) else None


class ToxicModel:
    """Feature -> weight, and the intercept."""

    def __init__(self, weights: dict[str, float], intercept: float) -> None:
        self.intercept = intercept
        self.words = {f: w for f, w in weights.items() if not f.endswith("-")}
        self.starts = {n: {f[:-1]: w for f, w in weights.items() if f.endswith("-") and len(f) == n + 1} for n in PREFIXES}

    def score(self, data: bytes) -> float:
        words = words_of(data)
        total = self.intercept + sum([self.words[w] for w in sorted(words & self.words.keys())])
        for n, starts in self.starts.items():
            found = {w[:n] for w in words if len(w) > n} & starts.keys()
            total += sum([starts[f] for f in sorted(found)])
        return float(lasso.sigmoid(np.float64(total)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE,
        l1: float = 2e-4, pair_strength: float = 1.0) -> ToxicModel:
    """Fitted on at most `sample` labelled rows that are not held out; only numbers of kept features reach the driver."""
    known = texts(docs, key, text).join(F.broadcast(training_labels(labels, label, key, sample)), "doc")  # `sample` rows at most

    def explode_task(batches):
        for batch in rows_by_size(batches, 1 << 20):
            found = [(f, y) for data, y in zip(batch.column("body").to_pylist(), batch.column("y").to_pylist())
                     for f in features_of(words_of(data))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found) if found else ([], []), (pa.string(), pa.float64()))],
                                  names=["feature", "y"])

    n, positive = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    counts = known.mapInArrow(explode_task, "feature string, y double").groupBy("feature").agg(
        F.count("*").alias("n"), F.sum("y").alias("positive")).where(F.col("n") >= LEAST_TEXTS)
    share = positive / n if n else 0.0
    deviation = F.abs(F.col("positive") - F.col("n") * share) / F.sqrt(F.col("n") * F.lit(max(share * (1 - share), 1e-9)))
    chosen = sorted({r.feature for r in counts.orderBy(F.desc(deviation), "feature").limit(FEATURES).collect()})
    number = {f: i for i, f in enumerate(chosen)}

    def number_task(batches):
        for batch in rows_by_size(batches, 1 << 20):
            rows, other = [], []
            for data in batch.column("body").to_pylist():
                words = words_of(data)
                twin = swapped(words)
                rows.append(sorted(number[f] for f in features_of(words) if f in number))
                other.append(None if twin is None else sorted(number[f] for f in features_of(twin) if f in number))
            yield pa.record_batch({"y": batch.column("y"), "own": pa.array(rows, pa.list_(pa.int32())),
                                   "other": pa.array(other, pa.list_(pa.int32()))})

    rows = known.mapInArrow(number_task, "y double, own array<int>, other array<int>").toPandas()
    x = lasso.Sparse(list(rows["own"]), None, len(chosen))
    both = [(a, b) for a, b in zip(rows["own"], rows["other"]) if b is not None]
    pairs = lasso.Sparse([np.concatenate([a, b]) for a, b in both],
                         [np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in both], len(chosen)) if both else None
    weights, intercept = lasso.fit(x, rows["y"].to_numpy(np.float64), l1, 400, pairs, pair_strength)
    return ToxicModel({f: float(w) for f, w in zip(chosen, weights) if w}, intercept)


def toxicity_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
                    threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out (crc32(id) modulo 5 is 0), score (0 to 1), predicted (score >= threshold).

    Only texts are input of a score. The model has at most FEATURES weights. A null
    text counts as empty and gets the intercept's score; a null id is not
    held out; repeated rows get equal scores; without labels all scores are 0.5.
    """
    model = fit(docs, labels, key, text, label, sample)

    def task(batches):
        for batch in rows_by_size(batches, 1 << 20):
            scores = [model.score(data) for data in batch.column("body").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(scores, pa.float64())})

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key, FOLDS, 0).alias("held_out"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("body"))
    return rows.mapInArrow(task, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
