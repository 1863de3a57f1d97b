"""Texts whose sets of shingles are similar: every pair is decided by the exact share, none is lost on the way.

A set that has a pair shares most of its shingles with it. A sketch of all shingles
tells which ones may come in two texts; sets with too few of those have no pair. Of the others, each
set's rarest shingles are sent, so many that two similar sets have one of them in common.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lakewright.session import cut_lineage

from .common import gives_back, rows_by_size, texts, unzstd, zstd
from .components import connected_components
from .sketch import PARTIAL, cells_for, merged, partial_sketch
from .substrings import BYTES, SKETCHED, Windows

#: Bits of a hash that choose the cell of its count, and cells that are added up together.
COUNTED, SEGMENT = 22, 1 << 16
#: Pairs that share one sending of a set.
SLICE = 64
#: Nodes that a task remembers as sent; beyond that it may send a set again.
SENT = 1 << 18


def shingle_sets(made: Windows, bodies: list[bytes]) -> list[np.ndarray]:
    """Ascending distinct hashes of each text's shingles: one for fewer words than a shingle, none without words.

    Words are what lies between ASCII white space, A-Z in lower case.
    """
    bodies = [b.lower() for b in bodies]
    row, hashes, _ = made.of_batch(bodies)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    found = np.split(hashes[new], np.searchsorted(row[new], np.arange(1, len(bodies))))
    for at, own in enumerate(found):
        if not len(own) and (few := bodies[at].split()):
            found[at] = np.array([xxhash.xxh3_64_intdigest(b" ".join(few))], np.uint64)
    return found


def least_overlap(n: int, share: Fraction) -> int:
    """The least whole number that is `share` of n or more."""
    return -(-n * share.numerator // share.denominator)


def text_sets(docs: DataFrame, key: str, text: str, words: int, share: Fraction, fingerprint: Callable[[bytes], int]) -> DataFrame:
    """`doc`, `node` (equal sets have equal ones), `n` (shingles) and, where a pair is possible, `hashes` and `fp`, the text's fingerprint.

    hashes: the shingles that may come in other texts. A task sends those of a set once.
    """
    rows = texts(docs, key, text)
    n_bytes = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    width = cells_for(n_bytes // 6 + 1)

    @gives_back
    def sketch_task(batches):
        made, held, n = Windows(words), [], 0
        for batch in rows_by_size(batches, BYTES):
            held += shingle_sets(made, batch.column("body").to_pylist())
            n += sum(map(len, held[-batch.num_rows:]))
            if n >= SKETCHED:
                yield partial_sketch(np.concatenate(held), width)
                held, n = [], 0
        if n:
            yield partial_sketch(np.concatenate(held), width)

    repeated = docs.sparkSession.sparkContext.broadcast(merged(rows.mapInArrow(sketch_task, PARTIAL), width))

    @gives_back
    def task(batches):
        made, sent = Windows(words), set()
        for batch in rows_by_size(batches, BYTES):
            nodes, sizes, hashes, prints = [], [], [], []
            bodies = batch.column("body").to_pylist()
            for body, own in zip(bodies, shingle_sets(made, bodies)):
                node, shared = xxhash.xxh3_64_intdigest(own.tobytes()), own[repeated.value.estimate(own)]
                nodes.append(node)
                sizes.append(len(own))
                possible = len(own) and len(shared) >= least_overlap(len(own), share) and node not in sent
                hashes.append(shared.tobytes() if possible else None)
                prints.append(np.array(fingerprint(body), np.uint64).view(np.int64).item() if possible else None)
                if possible:
                    sent.add(node)
            if len(sent) > SENT:
                sent.clear()
            yield pa.record_batch({"doc": batch.column("doc"), "node": np.array(nodes, np.uint64).view(np.int64),
                                   "n": np.array(sizes, np.int64), "hashes": pa.array(hashes, pa.binary()),
                                   "fp": pa.array(prints, pa.int64())})

    return rows.mapInArrow(task, "doc long, node long, n long, hashes binary, fp long")


def levels(sets: DataFrame) -> np.ndarray:
    """How common the shingles of a cell are in `sets`: eight steps for every power of two. Always as many cells."""
    @gives_back
    def send(batches):
        counts = np.zeros(1 << COUNTED, np.int64)
        for batch in batches:
            for own in batch.column("hashes").to_pylist():
                np.add.at(counts, _cells(np.frombuffer(own, np.uint64)), 1)
        for at, part in enumerate(counts.reshape(-1, SEGMENT)):
            if part.any():
                yield pa.record_batch({"segment": pa.array([at], pa.int32()), "counts": pa.array([zstd(part)], pa.binary())})

    @gives_back
    def add(batches):
        last, held = None, None
        for batch in batches:
            for segment, counts in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist()):
                if segment != last:
                    if last is not None:
                        yield _level(last, held)
                    last, held = segment, np.zeros(SEGMENT, np.int64)
                held += unzstd(counts, np.int64)
        if last is not None:
            yield _level(last, held)

    found = np.zeros(1 << COUNTED, np.uint8)
    schema = "segment int, counts binary"
    added = sets.select("hashes").mapInArrow(send, schema).repartition("segment").sortWithinPartitions("segment").mapInArrow(add, schema)
    for segment, level in added.toLocalIterator():
        found[segment * SEGMENT:(segment + 1) * SEGMENT] = unzstd(bytes(level), np.uint8)
    return found


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTED)).astype(np.int64)


def _level(segment: int, counts: np.ndarray) -> pa.RecordBatch:
    level = np.minimum(255, 8 * np.log2(counts + 1)).astype(np.uint8)
    return pa.record_batch({"segment": pa.array([segment], pa.int32()), "counts": pa.array([zstd(level)], pa.binary())})


def prefixes(sets: DataFrame, share: Fraction) -> DataFrame:
    """`k`, `node`, `n`, `at`: the rarest shingles of each set and their places in its order, which is the same for all sets.

    A similar set has all but n - least_overlap(n) of them. Shingles of one text alone come first in the order and are not sent.
    """
    common = sets.sparkSession.sparkContext.broadcast(levels(sets))

    @gives_back
    def task(batches):
        for batch in rows_by_size(batches, BYTES, "hashes"):
            keys, places = [], []
            for n, own in zip(batch.column("n").to_pylist(), batch.column("hashes").to_pylist()):
                own = np.frombuffer(own, np.uint64)
                own = own[np.lexsort((own, common.value[_cells(own)]))]
                alone = n - len(own)
                keys.append(own[:n - least_overlap(n, share) + 1 - alone])
                places.append(alone + np.arange(len(keys[-1])))
            sent = [len(k) for k in keys]
            yield pa.record_batch({
                "k": np.concatenate(keys).view(np.int64), "node": np.repeat(batch.column("node").to_numpy(), sent),
                "n": np.repeat(batch.column("n").to_numpy(), sent), "at": np.concatenate(places)})

    return sets.select("node", "n", "hashes").mapInArrow(task, "k long, node long, n long, at long")


def _possible(a: str, b: str, share: Fraction) -> Column:
    """Whether the shingles from the places of a common one on are enough; true at the first one that two similar sets share."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))
    return left * (share.numerator + share.denominator) >= (n + m) * share.numerator


def similar(pairs: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """Those of the pairs `a`, `b` whose shared part is `share` of all their shingles or more."""
    @gives_back
    def task(batches):
        for batch in rows_by_size(batches, BYTES, "hashes_a"):
            near = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "hashes_a", "hashes_b"))):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")  # two ascending runs
                shared = int((both[1:] == both[:-1]).sum())
                near.append(shared * share.denominator >= (n + m - shared) * share.numerator)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return _with_sets(_with_sets(pairs, sets, "b"), sets, "a").mapInArrow(task, "a long, b long")


def _with_sets(pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """A set of very many pairs is sent once for every SLICE of them, so none is a hot key."""
    other = "a" if side == "b" else "b"
    needed = pairs.groupBy(F.col(side).alias("node")).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    sent = sets.join(needed, "node").select(
        F.col("node").alias(side), "slices", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
        F.col("n").alias(f"n_{side}"), F.col("hashes").alias(f"hashes_{side}"))
    own = pairs.join(needed.withColumnRenamed("node", side), side).withColumn(
        "slice", F.pmod(F.xxhash64(other), F.col("slices")).cast("int")).drop("slices")
    return own.join(sent.drop("slices"), [side, "slice"]).drop("slice")


def set_links(sets: DataFrame, near: DataFrame, share: Fraction) -> DataFrame:
    """`a`, `b`: pairs of similar sets that span every component of `sets` (`node`, `n`, `hashes`).

    First come the pairs `near`, links of fingerprints, and the members of each bucket, the sets
    that send one shingle, with one of them; these span nearly all of a group of copies. Then
    all that share a bucket and are not in one component yet, whatever their number.
    Every pair is decided by its two sets.
    """
    sent = cut_lineage(prefixes(sets, share), "prefixes")
    # Of a group of copies the middle one has the fewest rare shingles of its own.
    first = sent.groupBy("k").agg(F.min(F.struct("at", "node", "n")).alias("b"), F.count("*").alias("many")).where("many > 1")
    stars = (sent.alias("a").join(first, "k").where((F.col("a.node") != F.col("b.node")) & _possible("a", "b", share))
             .select(F.greatest("a.node", "b.node").alias("a"), F.least("a.node", "b.node").alias("b")))
    stars = cut_lineage(near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).unionByName(stars).distinct(), "compared")
    found = cut_lineage(similar(stars, sets, share), "similar")
    roots = connected_components(found)
    rooted = cut_lineage(sent.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    mixed = rooted.groupBy("k").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("k")
    rooted = cut_lineage(rooted.join(mixed, "k"), "mixed")
    rest = (rooted.alias("a").join(rooted.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.node") > F.col("b.node"))
                                   & (F.col("a.root") != F.col("b.root")) & _possible("a", "b", share))
            .select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct().join(stars, ["a", "b"], "left_anti"))
    return found.unionByName(similar(cut_lineage(rest, "compared"), sets, share))


def similar_sets(docs: DataFrame, key: str, text: str, words: int, similarity: float, fingerprint: Callable[[bytes], int],
                 near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`doc`, `node`, `component_id`: a row per row of `docs`; the least id reachable over pairs of similar sets.

    near: links of `node`s by their `fp`, the fingerprints, as pairs `a`, `b`.
    """
    share = Fraction(str(similarity))
    found = cut_lineage(text_sets(docs, key, text, words, share, fingerprint), "sets")
    sets = cut_lineage(found.where("hashes is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"), F.first("fp").alias("fp")), "distinct")
    links = cut_lineage(near(sets.select("fp", "node")), "near")
    roots = connected_components(set_links(sets, links, share))
    firsts = found.groupBy("node").agg(F.min("doc").alias("first"))
    rooted = cut_lineage(firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return found.select("doc", "node").join(rooted.join(least, "root").select("node", "component_id"), "node")
