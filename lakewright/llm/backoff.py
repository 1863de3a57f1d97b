"""Language-model scoring: smoothed n-grams as an automaton with failure arcs, walked once over each text.

Documents are packed into blocks of tokens. Each block sends its distinct
n-grams, hashed and with their training counts, to be summed over the corpus,
and gets the sums back in the order it sent them. From these it builds the
part of the automaton that its own texts can reach. So nothing of the model
is broadcast, and the model may grow with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakewright.session import cut_lineage

from .common import (LAST_ID, Words, body, held_out, longs, odd_numbers, pack_longs, pack_sorted, rows_by_size, runs,
                     share_of, shuffle_parts, unpack_longs, unpack_sorted, unzstd, zstd)

#: Hashes that stand for the start of a text, a context only, and for its end, a token.
START, END = np.uint64(1), np.uint64(2)
#: Tokens in a block; a longer text is a block of its own.
BLOCK = 600_000

_BLOCKS = "block long, kind int, bucket int, docs binary, sizes binary, held binary, words binary, tokens binary, counts binary"
_SENT = "bucket int, kind int, block long, keys binary, counts binary"
_REPLY = "block long, kind int, bucket int, counts binary, total long, types long"


def token_blocks(docs: DataFrame, key: str, text: str, folds: int, fold: int) -> DataFrame:
    """Blocks of whole documents: ids, token numbers (start of text included), held-out marks, word hashes, tokens."""
    def task(batches):
        from pyspark import TaskContext
        words, held, n, made = Words(), [], 0, TaskContext.get().partitionId() << 32
        for batch in rows_by_size(batches, 1 << 20):
            for doc, out, data in zip(longs(batch.column("doc")).tolist(), batch.column("out").to_pylist(),
                                      batch.column("body").to_pylist()):
                found = data.lower().split()
                hashes = np.concatenate([[START], words.of(found)[:, 0], [END]])
                held.append((doc, out, hashes))
                n += len(hashes)
                if n >= BLOCK:
                    yield _block(made, held)
                    held, n, made = [], 0, made + 1
        if held:
            yield _block(made, held)

    rows = docs.select(F.col(key).cast("long").alias("doc"), held_out(key, folds, fold).alias("out"), body(text).alias("body"))
    return rows.mapInArrow(task, _BLOCKS)


def _block(number: int, held) -> pa.RecordBatch:
    hashes = np.concatenate([h for _, _, h in held])
    words, tokens, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which take little room
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    packed = rank[tokens].astype("<u4").view(np.uint8).reshape(-1, 4).T
    row = {"block": number, "kind": 0, "bucket": -1, "docs": pack_longs([d for d, _, _ in held]),
           "sizes": pack_longs([len(h) for _, _, h in held]), "held": zstd(np.array([o for _, o, _ in held], np.uint8)),
           "words": zstd(words[order]), "tokens": zstd(packed), "counts": None}
    return pa.RecordBatch.from_pylist([row], _arrow(_BLOCKS))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


class Grams:
    """Distinct n-grams of a block for n = 1 .. order, each order's in ascending order of their hashes.

    keys[n-1]: hashes. at[n-1]: for every place of the block the number of the n-gram that
    ends there, -1 where none does. last[n-1]: a place where each n-gram ends.
    """

    def __init__(self, row: dict, order: int) -> None:
        self.docs, self.sizes = unpack_longs(row["docs"]), unpack_longs(row["sizes"])
        self.held = unzstd(row["held"], np.uint8).astype(bool)
        tokens = np.ascontiguousarray(unzstd(row["tokens"], np.uint8).reshape(4, -1).T).view("<u4").ravel()
        hashes = unzstd(row["words"], np.uint64)[tokens]
        self.starts = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(hashes)) - np.repeat(self.starts, self.sizes)
        self.training = np.repeat(~self.held, self.sizes) & (place > 0)
        self.keys, self.at, self.last, self.counts = [], [], [], []
        for n in range(1, order + 1):
            odd = odd_numbers(n, n)
            keys = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
            for j in range(n):
                keys += hashes[j:len(hashes) - n + 1 + j] * odd[j]
            ends = np.arange(n - 1, len(hashes))
            inside = place[ends] >= n - 1
            found, inverse = np.unique(keys[inside], return_inverse=True)
            at = np.full(len(hashes), -1)
            at[ends[inside]] = inverse
            last = np.zeros(len(found), np.int64)
            last[inverse] = ends[inside]
            self.keys.append(found)
            self.at.append(at)
            self.last.append(last)
            self.counts.append(np.bincount(at[self.training & (at >= 0)], minlength=len(found)))


def gram_counts(blocks: DataFrame, order: int) -> DataFrame:
    """For each block, order and bucket of hashes the corpus counts of its n-grams, in the order of `Grams`.

    total, types: sum and number of the training counts of a bucket, on one of its rows.
    """
    spark = blocks.sparkSession
    tokens = blocks.agg(F.count("*")).first()[0] * BLOCK
    buckets = max(shuffle_parts(spark), order * tokens // (4 * BLOCK))

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grams, sent = Grams(row, order), []
                for n, (keys, counts) in enumerate(zip(grams.keys, grams.counts), 1):
                    bucket = share_of(keys, buckets)
                    sent += [(int(bucket[s]), n, row["block"], pack_sorted(keys[s:e]), pack_longs(counts[s:e]))
                             for s, e in zip(*runs(bucket))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*sent), _arrow(_SENT))],
                                                 schema=_arrow(_SENT))

    def add(batches):
        last, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["bucket"], row["kind"]) != last:
                    yield from _summed(last, held)
                    last, held = (row["bucket"], row["kind"]), []
                held.append((row["block"], unpack_sorted(row["keys"]), unpack_longs(row["counts"])))
        yield from _summed(last, held)

    sent = blocks.mapInArrow(send, _SENT)
    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(add, _REPLY)


def _summed(name, held):
    if not held:
        return
    keys, inverse = np.unique(np.concatenate([k for _, k, _ in held]), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, inverse, np.concatenate([c for _, _, c in held]))
    back, at, rows = sums[inverse], 0, []
    for number, (block, own, _) in enumerate(held):
        first = number == 0
        rows.append({"block": block, "kind": name[1], "bucket": name[0], "counts": pack_longs(back[at:at + len(own)]),
                     "total": int(sums.sum()) * first, "types": int((sums > 0).sum()) * first})
        at += len(own)
    yield pa.RecordBatch.from_pylist(rows, _arrow(_REPLY))


class Automaton:
    """States are contexts of up to order - 1 words, 0 is the empty one; arcs carry log10 probabilities.

    An n-gram seen in training is an arc from its context. Where a state has
    no arc for a word, its failure arc leads to the context without its
    oldest word, at the weight that smoothing leaves for it:

        p(w | c) = (count(c w) + strength * p(w | c')) / (count(c) + strength),

    at the bottom (count(w) + 1) / (total + types + 1), which leaves a share
    for unknown words. The probabilities of a context add up to one.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], total: int, types: int, strength: float) -> None:
        order = len(counts)
        # The start of text is followed by a token as often as there is an end.
        first = grams.at[0][grams.starts[0]]
        end = grams.at[0][grams.starts[0] + grams.sizes[0] - 1]
        contexts = [counts[0].copy(), *counts[1:]]
        contexts[0][first] = counts[0][end]
        offsets = np.cumsum([1, *map(len, counts[:-1])])
        below = (counts[0] + 1) / (total + types + 1)
        self.known, self.base = counts[0] > 0, np.log10(below)
        reached = contexts[0] > 0 if order > 1 else np.zeros(len(counts[0]), bool)
        # Arcs are numbered by their n-grams, one order after the other; those never seen are no arcs.
        seen, chances, onward = [np.ones(len(counts[0]), bool)], [self.base], [np.where(reached, offsets[0] + np.arange(len(counts[0])), 0)]
        fail, weight, level = [np.zeros(1, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        for n in range(2, order + 1):
            last, own = grams.last[n - 1], counts[n - 1]
            before, suffix = grams.at[n - 2][last - 1], grams.at[n - 2][last]
            p = (own + strength * below[suffix]) / (contexts[n - 2][before] + strength)
            seen.append(own > 0)
            chances.append(np.log10(p))
            onward.append(offsets[n - 1] + np.arange(len(own)) if n < order else offsets[n - 2] + suffix)
            # Failure arcs of the contexts of n - 1 words.
            weight.append(np.log10(strength / (contexts[n - 2] + strength)))
            fail.append(np.zeros(len(contexts[0]), np.int64) if n == 2 else
                        offsets[n - 3] + grams.at[n - 3][grams.last[n - 2]])
            level.append(np.full(len(contexts[n - 2]), n - 1))
            below = p
        self.order, self.chance, self.onward = order, np.concatenate(chances), np.concatenate(onward)
        self.fail, self.weight, self.level = np.concatenate(fail), np.concatenate(weight), np.concatenate(level)
        firsts = np.cumsum([0, *map(len, counts[:-1])])
        #: For every order the arc that spells the n-gram which ends at a place, -1 where there is none.
        self.arcs = np.stack([np.where((at >= 0) & there[at], f + at, -1) for at, there, f in zip(grams.at, seen, firsts)])
        self.start = int(offsets[0] + first) if order > 1 and contexts[0][first] else 0

    def walk(self, starts: np.ndarray) -> np.ndarray:
        """For every place the log10 probability of its token; texts begin at `starts`, with a place that is no token.

        All places step at once. The arc that a text takes at a place is the longest one seen
        there: with an n-gram all its parts have been seen, so the state before it has that context.
        From the state where the arc before led, failure arcs are followed until a state has an arc.
        """
        places = np.arange(self.arcs.shape[1])
        taken = self.arcs[0].copy()
        for arcs in self.arcs[1:]:
            np.copyto(taken, arcs, where=arcs >= 0)
        state = np.zeros(len(places), np.int64)
        state[1:] = self.onward[taken[:-1]]
        state[starts + 1] = self.start
        found = np.zeros(len(places))
        for _ in range(self.order - 1):
            failing = places[self.arcs[self.level[state], places] < 0]
            found[failing] += self.weight[state[failing]]
            state[failing] = self.fail[state[failing]]
        found += self.chance[self.arcs[self.level[state], places]]
        found[starts] = 0
        return found


def lm_scores(docs: DataFrame, order: int = 2, strength: float = 300.0, key: str = "doc_id", text: str = "text",
              folds: int = 7, fold: int = 2) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens (long), base_score, score (double, log10).

    Tokens are the words between ASCII white space, A-Z in lower case, then
    one end; a null or empty text has the end alone. The model learns from
    documents whose crc32(id) modulo `folds` is not `fold`; one whose id is null trains.
    base_score adds up smoothed single words, score walks the automaton.
    Repeated rows count as often as they come. Other columns are not read;
    an empty table gives an empty result. Words are told apart by 64-bit hashes.
    """
    blocks = cut_lineage(token_blocks(docs, key, text, folds, fold), "blocks")
    replies = cut_lineage(gram_counts(blocks, order), "counts")
    total, types = replies.where("kind = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()

    def task(batches):
        row, counts = None, []
        for batch in batches:
            for new in batch.to_pylist():
                if new["kind"] == 0:
                    if row:
                        yield _scored(row, counts, order, total, types, strength)
                    row, counts = new, [[] for _ in range(order)]
                else:
                    counts[new["kind"] - 1].append(unpack_longs(new["counts"]))
        if row:
            yield _scored(row, counts, order, total, types, strength)

    both = blocks.unionByName(replies.drop("total", "types"), allowMissingColumns=True)
    scored = both.repartition("block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(
        task, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("doc_id", F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")))


def _scored(row: dict, counts: list[list[np.ndarray]], order: int, total: int, types: int, strength: float) -> pa.RecordBatch:
    grams = Grams(row, order)
    summed = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in counts]
    automaton = Automaton(grams, summed, total, types, strength)
    base = automaton.base[grams.at[0]]
    known = automaton.known[grams.at[0]].astype(np.int64)
    base[grams.starts], known[grams.starts] = 0, 0
    known, base, score = (np.add.reduceat(v, grams.starts) for v in (known, base, automaton.walk(grams.starts)))
    return pa.record_batch({
        "doc_id": grams.docs, "held_out": pa.array(grams.held), "n_tokens": grams.sizes - 1, "n_known": known,
        "train_tokens": np.full(len(known), total, np.int64), "base_score": base, "score": score})
