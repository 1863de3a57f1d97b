"""Mixing sources to target weights by temperature, realised as permutations of blocks under a token budget."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakewright.session import cut_lineage

#: Blocks of documents in each source; what a plan holds does not grow with the documents.
BLOCKS = 1024


def n_tokens(text: str = "text") -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


@dataclass(frozen=True)
class Mix:
    """exponent, and for each source how often it is passed over; a budget of tokens."""
    exponent: float
    passes: dict[str | None, float]
    budget: float


def weights(tokens: dict, exponent: float) -> dict:
    """Shares to the power of the exponent, normalised; 1 keeps the sources' own shares, 0 makes them equal."""
    total = sum(tokens.values())
    raised = {s: (n / total) ** exponent for s, n in tokens.items() if n > 0}
    whole = sum(raised.values())
    return {s: r / whole for s, r in raised.items()}


def entropy(shares: dict) -> float:
    return -sum(w * math.log(w) for w in shares.values() if w > 0)


def solve(tokens: dict, entropy_share: float = 0.95, most_passes: float = 2.0, budget: float | None = None, rounds: int = 60) -> Mix:
    """The largest exponent in [0, 1] whose weights have the target entropy, raised as far as the limit of passes asks.

    entropy_share: target as a share of the greatest entropy. budget: None for the least
    at which every source is passed over once, so that no document is left out.
    Where even exponent 1 passes over a source more often than the limit, because of a
    given budget, 1 is taken. Sources without tokens are passed over once.
    """
    def passes(exponent: float) -> dict:
        shares = weights(tokens, exponent)
        total = budget if budget is not None else max(tokens[s] / w for s, w in shares.items())
        return {s: w * total / tokens[s] for s, w in shares.items()}

    used = {s: n for s, n in tokens.items() if n > 0}
    if not used:
        return Mix(1.0, {s: 1.0 for s in tokens}, 0.0)
    target = entropy_share * math.log(len(used))

    def bisect(holds) -> float:
        """Holds at 0 and not at 1: the largest exponent for which it does."""
        low, high = 0.0, 1.0
        for _ in range(rounds):
            middle = (low + high) / 2
            low, high = (middle, high) if holds(middle) else (low, middle)
        return low

    exponent = 1.0 if entropy(weights(tokens, 1.0)) >= target else bisect(lambda e: entropy(weights(tokens, e)) >= target)
    if max(passes(exponent).values()) > most_passes:
        low = bisect(lambda e: max(passes(e).values()) > most_passes)
        exponent = max(exponent, min(1.0, low + 2.0 ** -rounds * 4))
    found = passes(exponent)
    # A least budget means one pass or more; rounding must not leave a block out.
    found = {s: max(p, 1.0) if budget is None else p for s, p in found.items()}
    return Mix(exponent, {s: 1.0 for s in tokens} | found, sum(found[s] * n for s, n in used.items()))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", entropy_share: float = 0.95,
          most_passes: float = 2.0, budget: float | None = None, seed: int = 17) -> DataFrame:
    """`docs` with `epoch` (int), `block` (int) and `position` (double), a row for each time that a document is used.

    A source's documents are dealt into blocks by a hash of their ids.
    Every epoch takes the blocks in a permutation of its own; whole epochs
    take them all, the last takes them as long as the budget of the source
    lasts, to the nearest block. Sorted by `position`, the sources run side by side at
    their weights. The rows of one source spread over all its blocks, so a hot source is no hot key.

    A null source is a source. Documents without an id are dealt by their
    text; equal rows fall into one block. An empty table gives an empty
    result. Columns of `docs` with a new name stay beside it; `in_order` takes any names.
    """
    spark = docs.sparkSession
    own = F.xxhash64(F.lit(seed), F.col(key), F.when(F.col(key).isNull(), F.col(text)))
    # The caller's row is one column, so that its names meet none in here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("s"),
                       F.pmod(own, F.lit(BLOCKS)).cast("int").alias("block"), n_tokens(text).alias("n"))
    sizes = cut_lineage(rows.groupBy("s", "block").agg(F.sum("n").alias("n")), "blocks")
    # One number per source.
    tokens = {r.s: r.n or 0 for r in sizes.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    mix = solve(tokens, entropy_share, most_passes, budget)
    passes = spark.createDataFrame([(s, float(p)) for s, p in mix.passes.items()], "s string, passes double")
    epochs = sizes.join(passes, sizes["s"].eqNullSafe(passes["s"])).select(
        sizes["s"], "block", "n", "passes", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("passes") - 1, F.lit(0)).cast("int"))).alias("epoch"))
    turn = Window.partitionBy("s", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "s", "block"), "block")
    each = Window.partitionBy("s", "epoch")
    planned = (epochs.withColumn("rank", F.row_number().over(turn)).withColumn("blocks", F.count("*").over(each))
               .withColumn("before", F.sum("n").over(turn) - F.col("n") / 2).withColumn("all", F.sum("n").over(each))
               .where((F.col("epoch") + 1 <= F.col("passes")) | (F.col("before") <= (F.col("passes") - F.col("epoch")) * F.col("all")))
               .select(F.col("s").alias("of"), F.col("block").alias("b"), "epoch",
                       ((F.col("epoch") + (F.col("rank") - 0.5) / F.col("blocks")) / F.col("passes")).alias("position")))
    plan = planned.groupBy("of", "b").agg(F.collect_list(F.struct("epoch", "position")).alias("uses"))
    used = (rows.join(plan, rows["s"].eqNullSafe(plan["of"]) & (rows["block"] == plan["b"]))
            .select("row", "block", F.explode("uses").alias("use")))
    return used.select("row.*", F.col("use.epoch").alias("epoch"), "block", F.col("use.position").alias("position"))


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 17, **how) -> DataFrame:
    """The uses of `mixed` with the columns of `docs` alone, written in the mixture's order: a block is no unit, its rows are spread over tasks by a hash."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c: names[docs.columns.index(c)] for c in (key, text, how.pop("source", "source"))}
    key, text, source = at.values()
    tie = F.xxhash64(F.lit(seed), F.col(key), F.when(F.col(key).isNull(), F.col(text)), "epoch")
    found = mixed(plain, key, text, source, seed=seed, **how).withColumn("tie", tie)
    return found.repartitionByRange("position", "tie").sortWithinPartitions("position", "tie").select(*names).toDF(*docs.columns)
