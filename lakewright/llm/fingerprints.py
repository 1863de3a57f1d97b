"""Document fingerprints: digests of content-defined chunks, weighted by length, that measure containment."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .chunking import Sizes, chunk_ends
from .common import LAST_ID, longs, rows_by_size, shuffle_parts

#: Small chunks, so that an edit changes little of a short document's fingerprint.
SIZES = Sizes(32, 64, 256)
DIGEST_BITS = 48

Print = dict[int, int]


def prints(bodies: list[bytes], sizes: Sizes = SIZES) -> list[Print]:
    """For each text the bytes that each of its chunks' digests stands for."""
    found = []
    digest, shift = xxhash.xxh3_64_intdigest, 64 - DIGEST_BITS
    for body, ends in zip(bodies, chunk_ends(bodies, sizes)):
        own: Print = {}
        start = 0
        for end in ends:
            d = digest(body[start:end]) >> shift
            own[d] = own.get(d, 0) + end - start
            start = end
        found.append(own)
    return found


def shown(own: Print) -> str:
    """A fingerprint as text: `digest:bytes`, in ascending order of the digests."""
    return " ".join([f"{d:012x}:{n}" for d, n in sorted(own.items())])


def parsed(text: str) -> Print:
    return {int(d, 16): int(n) for d, n in (x.split(":") for x in text.split())}


def containment(own: Print, other: Print) -> float:
    """The share of the first one's bytes whose chunks the other one has as well; of an empty text 1 in another, else 0."""
    if not own:
        return float(not other)
    return sum([min(n, other[d]) for d, n in own.items() if d in other]) / sum(own.values())


def neighbours(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows in runs of descending `key`: `run`, `copy` (0, or 1 for the row that follows a run), `doc`, `body`.

    Rows fall into ranges of the key; only the first id of each range, one
    number per partition, passes through the driver, so that a copy of that
    row can end the range before it. The last range ends with the very first row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-LAST_ID - 1)).alias("doc"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    parts = shuffle_parts(spark)
    cuts = rows.agg(F.percentile_approx("doc", [i / parts for i in range(1, parts)] or [0.5], 100_000)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @pandas_udf("int")
    def run_of(doc):
        import pandas as pd
        return pd.Series(len(cuts) - np.searchsorted(cuts, doc.to_numpy(), "left"), dtype="int32")

    heads = rows.select("doc", run_of("doc").alias("run")).groupBy("run").agg(F.max("doc").alias("head")).orderBy("run").collect()
    follows = {h.head: heads[i - 1].run for i, h in enumerate(heads)}  # the run that the head's row follows; the first follows the last
    copied = F.create_map(*[F.lit(x).cast(t) for pair in follows.items() for x, t in zip(pair, ("long", "int"))]) if follows else F.create_map()
    own = F.struct(F.col("run"), F.lit(0).alias("copy"))
    more = F.struct(F.try_element_at(copied, F.col("doc")).alias("run"), F.lit(1).alias("copy")) if follows else own
    placed = rows.withColumn("run", run_of("doc")).withColumn("at", F.explode(
        F.when(F.col("doc").isin(list(follows)), F.array(own, more)).otherwise(F.array(own))))
    placed = placed.select("at.run", "at.copy", "doc", "body")
    return placed.repartition(parts, "run").sortWithinPartitions("run", "copy", F.desc("doc"), F.xxhash64("body"), "body")


def edited(own: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(own) // 2
    return own[:len(own) - half] + following[:half]


def neighbour_prints(docs: DataFrame, key: str = "doc_id", text: str = "text", sizes: Sizes = SIZES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next smaller id, after the last one
    the first; without an id a document comes last, rows with one id
    follow each other in the order of their hashed texts. The edited text has its last half replaced by the
    next one's beginning. near_*: containment of the fingerprint in the
    edited text's and in the next document's. A null text counts as empty;
    a single document is its own next one. Other columns are not read.
    """
    def task(batches):
        held: list[tuple] = []
        for batch in rows_by_size(batches, 1 << 19):
            columns = [batch.column(c).to_pylist() for c in ("run", "copy", "body")]
            new = list(zip(*columns, longs(batch.column("doc")).tolist()))
            found = prints([b.encode() for _, _, b, _ in new], sizes)
            held += [(*row, own) for row, own in zip(new, found)]
            yield _compared(held, sizes)
            held = held[-1:]  # its next row may come with the next batch

    out = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
    found = neighbours(docs, key, text).mapInArrow(task, out)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != -LAST_ID - 1, F.col("doc_id")))


def _compared(held: list[tuple], sizes: Sizes) -> pa.RecordBatch:
    pairs = [(a, b) for a, b in zip(held, held[1:]) if a[1] == 0 and a[0] == b[0]]
    changed = [edited(a[2], b[2]).encode() for a, b in pairs]
    theirs = prints(changed, sizes)
    return pa.record_batch({
        "doc_id": pa.array([a[3] for a, _ in pairs], pa.int64()),
        "n_chars": pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
        "fingerprint": pa.array([shown(a[4]) for a, _ in pairs], pa.string()),
        "edited_fingerprint": pa.array([shown(p) for p in theirs], pa.string()),
        "near_edited": pa.array([containment(a[4], p) for (a, _), p in zip(pairs, theirs)], pa.float64()),
        "near_next": pa.array([containment(a[4], b[4]) for a, b in pairs], pa.float64())})
