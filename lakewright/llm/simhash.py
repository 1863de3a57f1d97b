"""SimHash near-duplicates: bit-sliced comparison of fingerprints that share blocks of bits."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lakewright.session import cut_lineage

from .common import gives_back, rows_by_size, runs, texts
from .components import connected_components
from .jaccard import similar_sets

BITS = 64
#: Fingerprints of one bucket that are compared in one piece; larger buckets are cut into pairs of pieces.
PIECE = 16_384
#: Words of 64 lanes compared at once.
LANES = 1 << 16
#: Bytes of a signature: bins of a one-permutation minimum hash.
SIGNATURE = 64
#: A count kept in a byte lane stays below 256.
LANE_ROWS = 255


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, signed: bool = False) -> DataFrame:
    """`doc`, `fp` (long): bit b is set where over half of the shingles' XXH64 have it; signed: `sig` (binary) as well.

    Words are what lies between ASCII white space, A-Z in lower case; fewer
    words than a shingle make one shingle, none (null, empty) makes zero.
    Equal rows give equal rows.
    """
    @gives_back
    def task(batches):
        for batch in rows_by_size(batches, 1 << 20):
            found = [_fingerprint(x, words, signed) for x in batch.column("body").to_pylist()]
            columns = {"doc": batch.column("doc"), "fp": np.array([f for f, _ in found], np.uint64).view(np.int64)}
            yield pa.record_batch(columns | ({"sig": pa.array([s for _, s in found], pa.binary())} if signed else {}))

    return texts(docs, key, text).mapInArrow(task, "doc long, fp long" + ", sig binary" * signed)


def _fingerprint(data: bytes, size: int, signed: bool = False) -> tuple[int, bytes]:
    found = data.lower().split()
    if not found:
        return 0, bytes(SIGNATURE)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(size, len(found))
    starts, ends = starts[: len(found) - size + 1].tolist(), ends[size - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    counts, least = np.zeros(BITS, np.int64), np.full(SIGNATURE, ~np.uint64(0))
    for at in range(0, len(starts), LANES):
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at:at + LANES], ends[at:at + LANES])], "<u8")
        # Eight byte lanes a word: sums of up to 255 rows stay inside their lanes.
        lanes = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), LANE_ROWS), axis=0)
        counts += sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
        if signed:
            np.minimum.at(least, (hashes >> np.uint64(58)).astype(np.int64), hashes << np.uint64(6))
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0]), _signature(least) if signed else b""


def _signature(least: np.ndarray) -> bytes:
    """A byte of the least hash of each of 64 bins; an empty bin takes the byte of the next full one, changed by how far that is."""
    full = np.flatnonzero(least != ~np.uint64(0))
    if not len(full):
        return bytes(SIGNATURE)
    place = np.arange(SIGNATURE)
    after = np.searchsorted(full, place) % len(full)
    far = (full[after] - place) % SIGNATURE
    return ((least[full[after]] >> np.uint64(6)).astype(np.uint8) + (far * 37).astype(np.uint8)).tobytes()


def block_masks(blocks: int, kept: int) -> list[int]:
    """Every choice of `kept` out of `blocks` blocks of bits, as masks.

    Two fingerprints within blocks - kept bits agree on one mask at least: no
    more blocks than that hold a difference, so `kept` of them are equal on both sides.
    """
    cuts = np.linspace(0, BITS, blocks + 1).round().astype(int).tolist()
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(blocks, kept)]


def links(prints: DataFrame, radius: int = 3, masks: list[int] | None = None, agree: float | None = None) -> DataFrame:
    """`a`, `b`: links within `radius` bits that span every component of distinct `node`s with fingerprints `fp`.

    masks: None for those that lose no link. agree: links also need that share of equal bytes in
    the nodes' signatures `sig`. Each bucket of equal masked bits gives a forest over its members, not
    all its pairs. A bucket of more than PIECE members is cut into pieces,
    and every pair of pieces is a task of its own.
    """
    def signed(mask: int) -> int:
        return mask - (1 << 64) if mask >> 63 else mask

    own_columns = ["fp", "node"] + ["sig"] * (agree is not None)
    keyed = prints.select(*own_columns, F.posexplode(F.array(*[
        F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks or block_masks(radius + 3, 3)])).alias("t", "k"))
    large = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > PIECE)
    pieces = F.ceil(F.coalesce("n", F.lit(1)) / PIECE).cast("int")
    own, other = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"), F.col("other")
    dealt = (keyed.join(large, ["t", "k"], "left").withColumn("pieces", pieces).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
             .select("t", "k", F.least("own", other).alias("i"), F.greatest("own", other).alias("j"), *own_columns))
    bucket = ["t", "k", "i", "j"]

    @gives_back
    def task(batches):
        for group in _whole_groups(batches):
            yield pa.record_batch(forest(*group, radius, agree), names=["a", "b"])

    return dealt.repartition(*bucket).sortWithinPartitions(*bucket, "node").mapInArrow(task, "a long, b long")


def _whole_groups(batches, rows: int = 1 << 17):
    """Fingerprints, nodes, signatures (or None) and bucket numbers of many whole buckets at once."""
    kept: list[pa.RecordBatch] = []

    def cut(final: bool):
        table = pa.Table.from_batches(kept)
        keys = np.stack([table.column(c).to_numpy() for c in ("t", "k", "i", "j")])
        new = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        end = len(new) if final else int(np.flatnonzero(new)[-1])
        group = None
        if end:
            part = table.slice(0, end)
            sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(end, -1) if "sig" in table.column_names else None
            group = part.column("fp").to_numpy().view(np.uint64), part.column("node").to_numpy(), sigs, np.cumsum(new[:end]) - 1
        return group, table.slice(end).to_batches()

    held = 0
    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            held += batch.num_rows
        if held >= rows:
            group, kept = cut(False)
            held = sum(b.num_rows for b in kept)
            if group:
                yield group
    if held:
        yield cut(True)[0]


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(64, words): bit p of 64 fingerprints side by side in each word of plane p."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64, BITS)
    return np.packbits(bits.transpose(2, 0, 1), axis=-1, bitorder="little").view("<u8").reshape(BITS, -1)


def near_lanes(planes: np.ndarray, words: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of (query, word) pairs with a lane within `radius` bits, and their lanes as bits.

    Differences are added plane by plane into carry-save counters, one bit of
    the count in each; a lane that overflows them is out. Pairs whose lanes
    are all out are abandoned after every eighth plane.
    """
    width = radius.bit_length()
    places = np.arange(len(words))
    counter = np.zeros((width, len(words)), np.uint64)
    out = np.zeros(len(words), np.uint64)
    for plane in range(BITS):
        carry = planes[plane][words] ^ (np.uint64(0) - (queries >> np.uint64(plane) & np.uint64(1)))
        for bit in range(width):
            carry, counter[bit] = counter[bit] & carry, counter[bit] ^ carry
        out |= carry
        if plane % 8 == 7:
            alive = out != ~np.uint64(0)
            if not alive.all():
                places, words, queries, out, counter = places[alive], words[alive], queries[alive], out[alive], counter[:, alive]
    above = np.zeros(len(words), np.uint64)
    equal = ~above
    for bit in reversed(range(width)):
        wanted = ~np.uint64(0) if radius >> bit & 1 else np.uint64(0)
        above |= equal & counter[bit] & ~wanted
        equal &= ~(counter[bit] ^ wanted)
    near = ~(out | above)
    return places[near != 0], near[near != 0]


def forest(prints: np.ndarray, nodes: np.ndarray, sigs: np.ndarray | None, buckets: np.ndarray, radius: int,
           agree: float | None) -> list[np.ndarray]:
    """Links (member, first member of its component) inside every bucket."""
    starts, ends = runs(buckets)
    many = ends - starts > 1
    starts, sizes = starts[many], (ends - starts)[many]
    roots = np.arange(len(prints))
    if len(starts):
        words = -(-sizes // 64)
        first = np.cumsum(words) - words
        member = np.repeat(starts, sizes) + _within(sizes)
        place = np.repeat(first * 64, sizes) + _within(sizes)
        padded, used = np.zeros(words.sum() * 64, np.uint64), np.full(words.sum() * 64, -1)
        padded[place], used[place] = prints[member], member
        planes = bit_planes(padded)
        # Each member is compared with its own word and those behind it.
        behind = np.repeat(first + words, sizes) - place // 64
        total = np.cumsum(behind)
        start = 0
        while start < len(member):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + LANES, "right")))
            n = behind[start:stop]
            query = np.repeat(np.arange(start, stop), n)
            word = np.repeat(place[start:stop] // 64, n) + _within(n)
            at, lanes = near_lanes(planes, word, prints[member[query]], radius)
            for part in range(0, len(at), 4096):
                pair, lane = np.nonzero(np.unpackbits(
                    lanes[part:part + 4096].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64))
                pair = at[part:part + 4096][pair]
                a, b = member[query[pair]], used[word[pair] * 64 + lane]
                a, b = a[b >= 0], b[b >= 0]
                if agree is not None:
                    apart = roots[a] != roots[b]
                    a, b = a[apart], b[apart]
                    same = (sigs[a] == sigs[b]).mean(axis=1) >= agree
                    a, b = a[same], b[same]
                join(roots, a, b)
            start = stop
    linked = np.flatnonzero(roots != np.arange(len(roots)))
    return [nodes[linked], nodes[roots[linked]]]


def _within(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def join(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a and b, in place; afterwards every entry names its root."""
    while True:
        left, right = roots[a], roots[b]
        apart = left != right
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        low, high = np.minimum(left, right)[apart], np.maximum(left, right)[apart]
        np.minimum.at(roots, high, low)
        while not np.array_equal(higher := roots[roots], roots):
            roots[:] = higher


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints within `radius` bits are linked; component_id is the
    smallest id reachable over links, the own one included. Ids may repeat or be null: a
    null id is never a component's number unless all its documents have none.
    An empty table gives an empty result; other columns are not read.
    """
    prints = cut_lineage(fingerprints(docs, key, text, words).withColumn("node", F.col("fp")), "prints")
    return _grouped(prints, lambda nodes: links(nodes, radius))


def _grouped(prints: DataFrame, linked) -> DataFrame:
    own = [c for c in prints.columns if c != "doc"]
    distinct = cut_lineage(prints.groupBy(*own).agg(F.min("doc").alias("first")), "distinct")
    roots = connected_components(linked(distinct))
    rooted = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("node", "component_id"), "node").select(
        F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of `docs`: doc_id, component_id, for texts whose sets of shingles are similar (shared part of all) by `similarity` or more.

    Every such pair is a link, and no other. Fingerprints are compared as in `simhash_groups`, and
    their links decided by the sets themselves. Texts just so similar differ in about a sixth of the bits
    of their fingerprints, which other pairs come near too; so sets that share rare shingles and
    are not in one group by then are compared as well. Ids are treated as in `simhash_groups`; texts without words are equal.
    """
    return similar_sets(docs, key, text, words, similarity, lambda body: _fingerprint(body, words)[0], links).select(F.col("doc").alias("doc_id"), "component_id")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with one of each group of `similar_groups` left, the one with the smallest id, all columns as they were.

    Of rows with one id one stays. Rows without an id cannot be told apart by it and stay.
    """
    groups = similar_groups(docs, key, text, words, similarity)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    kept = docs.join(first, key, "left_semi").dropDuplicates([key])
    return kept.unionByName(docs.where(F.col(key).isNull()))
