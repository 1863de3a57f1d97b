"""Quality by a sparse ensemble of rules: paths of small trees over text statistics, weighted by lasso logistic regression.

The fitted rules become Spark column expressions, so scoring is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lakewright.session import cut_lineage

from . import lasso
from .common import held_out

#: Labelled rows that a model is fitted on, the first by a hash of their ids.
SAMPLE = 20_000
FOLDS = 5


def statistics(text: str = "text") -> dict[str, Column]:
    """Figures of one text; null counts as empty, and shares of nothing are 0."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.split(F.trim(F.regexp_replace(body, r"[\x20\x09-\x0D]+", " ")), " ")
    lines = F.split(body, "\n")

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    def letters(pattern: str) -> Column:
        return F.length(F.regexp_replace(body, pattern, ""))

    n = F.length(body)
    return {
        "n_chars": n.cast("double"), "n_words": F.size(words).cast("double"),
        "word_length": share(n, F.size(words)),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "lower": share(letters(r"[^\p{Ll}]+"), n), "upper": share(letters(r"[^\p{Lu}]+"), n),
        "digits": share(letters(r"[^0-9]+"), n), "stops": share(letters(r"[^.,;:?]+"), n),
        "bars": share(letters(r"[^|]+"), n), "bangs": share(letters(r"[^!]+"), n),
        "symbols": share(letters(r"[\p{L}0-9\s.,;:?!|'\"()-]+"), n),
    }


@dataclass(frozen=True)
class Rule:
    """Statistics that lie in half-open ranges: (name, above, up to), all of them."""
    ranges: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        met = F.lit(True)
        for name, above, most in self.ranges:
            if above > -np.inf:
                met = met & (F.col(name) > F.lit(above))
            if most < np.inf:
                met = met & (F.col(name) <= F.lit(most))
        return met

    def rows(self, values: dict[str, np.ndarray]) -> np.ndarray:
        met = np.ones(len(next(iter(values.values()))), bool)
        for name, above, most in self.ranges:
            met &= (values[name] > above) & (values[name] <= most)
        return met


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def grow(values: dict[str, np.ndarray], y: np.ndarray, trees: int = 24, depth: int = 3, bins: int = 48, seed: int = 11) -> list[Rule]:
    """Distinct rules: every path from the root of trees that are boosted on random halves of the rows."""
    names = list(values)
    edges = [np.unique(np.quantile(values[c], np.linspace(0, 1, bins + 1)[1:-1])) for c in names]
    codes = np.stack([np.searchsorted(e, values[c], "left") for e, c in zip(edges, names)])
    random = np.random.Generator(np.random.PCG64(seed))
    found: dict[Rule, None] = {}
    z = np.zeros(len(y))

    def split(rows: np.ndarray, residual: np.ndarray, features: np.ndarray):
        best = (1e-9, None, None)
        total, n = residual[rows].sum(), len(rows)
        for f in features:
            size = len(edges[f]) + 1
            counts = np.cumsum(np.bincount(codes[f, rows], minlength=size))[:-1]
            sums = np.cumsum(np.bincount(codes[f, rows], residual[rows], size))[:-1]
            fit = (counts >= 10) & (n - counts >= 10)
            if fit.any():
                gain = np.where(fit, sums ** 2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(n - counts, 1) - total ** 2 / n, 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        return best[1:]

    def visit(rows: np.ndarray, every: np.ndarray, residual, features, ranges: dict, level: int) -> None:
        f, k = split(rows, residual, features) if level < depth else (None, None)
        if f is None:
            z[every] += 0.5 * residual[rows].mean() * 4  # a Newton step at the middle of the curve
            return
        low, high = ranges.get(names[f], (-np.inf, np.inf))
        cut = float(edges[f][k])
        for side, bounds in ((codes[f] <= k, (low, cut)), (codes[f] > k, (cut, high))):
            own = ranges | {names[f]: bounds}
            found[Rule(tuple((c, *own[c]) for c in sorted(own)))] = None
            visit(rows[side[rows]], every[side[every]], residual, features, own, level + 1)

    for _ in range(trees):
        residual = y - lasso.sigmoid(z)
        rows = np.flatnonzero(random.random(len(y)) < 0.5)
        features = random.choice(len(names), max(1, 2 * len(names) // 3), replace=False)
        if len(rows) >= 20:
            visit(rows, np.arange(len(y)), residual, np.sort(features), {}, 0)
    return list(found)


def fit(values: dict[str, np.ndarray], y: np.ndarray, l1: float = 5e-4) -> RuleModel:
    """Without labels the score is 0.5 everywhere; with too few of them for a rule, the share of label 1."""
    rules = grow(values, y) if len(y) else []
    matrix = np.stack([r.rows(values) for r in rules], axis=1).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    weights, intercept = lasso.fit(lasso.Dense(matrix), y, l1, steps=400)
    return RuleModel(intercept, [(r, w) for r, w in zip(rules, weights) if w])


def training_labels(labels: DataFrame, label: str, key: str = "doc_id", sample: int = SAMPLE, folds: int = FOLDS) -> DataFrame:
    """At most `sample` rows (`doc`, `y`) that are not held out; rows with a null take no part."""
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key, folds, 0))
    return (usable.select(F.col(key).cast("long").alias("doc"), F.col(label).cast("double").alias("y"))
            .orderBy(F.xxhash64("doc"), "doc", "y").limit(sample))


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
                   threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out (crc32(id) modulo 5 is 0), score (0 to 1), predicted (score >= threshold).

    Only texts are input of a score. The model is fitted on at most `sample` labelled rows
    that are not held out. A null text counts as empty; a null id is
    not held out; repeated rows get equal scores.
    """
    figures = statistics(text)
    names = list(figures)
    table = cut_lineage(docs.select(F.col(key).cast("long").alias("doc"), held_out(key, FOLDS, 0).alias("held_out"),
                                    *[c.alias(n) for n, c in figures.items()]), "statistics")
    known = table.join(F.broadcast(training_labels(labels, label, key, sample)), "doc").select("y", *names)  # `sample` rows at most
    rows = known.toPandas()
    model = fit({n: rows[n].to_numpy(np.float64) for n in names}, rows["y"].to_numpy(np.float64))
    return table.select(F.col("doc").alias("doc_id"), "held_out", model.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def drop_poor(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier does not reject, all columns as they were; rows without an id are scored by their text as well."""
    figures = statistics(text)
    names = list(figures)
    own = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("body"))
    known = own.join(F.broadcast(training_labels(labels, "quality", key)), "doc")
    rows = known.select("y", *[c.alias(n) for n, c in statistics("body").items()]).toPandas()
    model = fit({n: rows[n].to_numpy(np.float64) for n in names}, rows["y"].to_numpy(np.float64))
    # The one-row generator keeps the statistics from being computed again for every rule.
    inner = docs.select(F.struct(*docs.columns).alias("_row"), F.inline(F.array(F.struct(*[c.alias(n) for n, c in figures.items()]))))
    return inner.where(model.score() >= threshold).select("_row.*")
