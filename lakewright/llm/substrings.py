"""Substring dedup: windows of words that also start in an earlier document are cut out.

A count-min sketch of all windows comes first. Only windows that it estimates
repeated, and those are all that are and a few more, are grouped exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import (LAST_ID, Words, gives_back, longs, odd_numbers, pack_longs, pack_sorted, rows_by_size, runs, share_of,
                     shuffle_parts, texts, unpack_longs, unpack_sorted, unzstd, zstd)
from .sketch import PARTIAL, cells_for, merged, partial_sketch

#: Windows that a task holds before it passes them on.
HELD = 1 << 21
#: And before it passes on their sketch, of which a fuller one takes less room for each.
SKETCHED = 1 << 22
PRIME = 1_000_003
#: Text bytes hashed at once; a longer text is hashed alone.
BYTES = 1 << 20


class Windows:
    """Hashes of every window of `size` words: 64 bits and 32 more, multilinear in the words' own 128-bit hashes."""

    def __init__(self, size: int) -> None:
        self.size, self.words, self.odd = size, Words(), (odd_numbers(size, 1), odd_numbers(size, 2))

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        hashes = self.words.of(words)
        n = max(0, len(words) - self.size + 1)
        sums = [np.zeros(n, np.uint64) for _ in range(2)]
        for half in range(2):
            column = np.ascontiguousarray(hashes[:, half])
            for place in range(self.size):
                sums[half] += column[place:place + n] * self.odd[half][place]
        return sums[0], (sums[1] >> np.uint64(32)).astype(np.uint32)

    def of_batch(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of many texts at once: row numbers, and the two hashes."""
        each = [b.split() for b in bodies]
        sizes = np.array([len(w) for w in each], np.int64)
        first, second = self.of([w for words in each for w in words])
        row = np.repeat(np.arange(len(each)), sizes)[: len(first)]
        # A window may not cross into the next text.
        inside = np.arange(len(first)) + self.size <= np.cumsum(sizes)[row] if len(first) else np.empty(0, bool)
        return row[inside], first[inside], second[inside]


def share(doc, shares: int):
    """The share of the documents that an id belongs to; for columns and arrays alike."""
    return doc % PRIME % shares if isinstance(doc, np.ndarray) else F.pmod(F.pmod(doc, F.lit(PRIME)), F.lit(shares)).cast("int")


def repeated_windows(docs: DataFrame, size: int, shares: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`share`, `docs`, `hashes` (packed, of equal length): windows of documents that also start in one with a smaller id.

    A share of documents has several rows. A null id counts as larger than all.
    """
    spark = docs.sparkSession
    bodies = texts(docs, key, text)
    n_bytes = bodies.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    windows = n_bytes // 6 + 1
    width = cells_for(windows)

    @gives_back
    def sketch_task(batches):
        made, held, n = Windows(size), [], 0
        for batch in rows_by_size(batches, BYTES):
            held.append(made.of_batch(batch.column("body").to_pylist())[1])
            n += len(held[-1])
            if n >= SKETCHED:
                yield partial_sketch(np.concatenate(held), width)
                held, n = [], 0
        if n:
            yield partial_sketch(np.concatenate(held), width)

    repeated = spark.sparkContext.broadcast(merged(bodies.mapInArrow(sketch_task, PARTIAL), width))
    buckets = max(shuffle_parts(spark), windows // HELD)

    @gives_back
    def pick_task(batches):
        made, held, n = Windows(size), [], 0
        for batch in rows_by_size(batches, BYTES):
            row, first, second = made.of_batch(batch.column("body").to_pylist())
            found = repeated.value.estimate(first)
            held.append((first[found], second[found], longs(batch.column("doc"))[row[found]]))
            n += found.sum()
            if n >= HELD:
                yield _packed(held, buckets)
                held, n = [], 0
        if n:
            yield _packed(held, buckets)

    @gives_back
    def group_task(batches):
        last, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != last:
                    yield from _later(held, shares)
                    last, held = row["bucket"], []
                held.append((unpack_sorted(row["first"]), unzstd(row["second"], np.uint32), unpack_longs(row["docs"])))
        yield from _later(held, shares)

    picked = bodies.mapInArrow(pick_task, "bucket int, first binary, second binary, docs binary")
    return (picked.repartition(buckets, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(group_task, "share int, docs binary, hashes binary"))


def _packed(held, buckets: int) -> pa.RecordBatch:
    """A row for each bucket of hashes, so that a window of very many documents stays a few bytes for each."""
    first, second, doc = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((doc, second, first))
    first, second, doc = first[order], second[order], doc[order]
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (doc[1:] != doc[:-1])])
    first, second, doc = first[new], second[new], doc[new]
    bucket = share_of(first, buckets)
    rows = [(int(bucket[s]), pack_sorted(first[s:e]), zstd(second[s:e]), pack_longs(doc[s:e])) for s, e in zip(*runs(bucket))]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 3))],
                           names=["bucket", "first", "second", "docs"])


def _later(held, shares: int):
    """Of one bucket: the windows of every document that an earlier one has as well, a row for each share of documents."""
    if not held:
        return
    first, second, doc = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((doc, second, first))
    first, second, doc = first[order], second[order], doc[order]
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    first, doc = first[doc > least], doc[doc > least]
    own = share(doc, shares)
    order = np.lexsort((doc, own))
    first, doc, own = first[order], doc[order], own[order]
    rows = [(int(own[s]), pack_longs(doc[s:e]), zstd(first[s:e])) for s, e in zip(*runs(own))]
    for at in range(0, len(rows), 1000):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 1000]), (pa.int32(), pa.binary(), pa.binary()))],
                              names=["share", "docs", "hashes"])


def without_repeats(docs: DataFrame, size: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `n_words`, `n_removed` (long) and `kept` (string) beside their own columns, which no new name may match.

    Words are what lies between ASCII white space, unchanged. Each word that
    is covered by a window of `size` words whose sequence also starts in a
    document with a smaller id is removed; windows are judged on the input.
    kept: the other words, joined by one space. Null and empty texts have no
    words; a null id counts as larger than all; rows with one id are one
    document and do not remove each other's words.
    """
    spark = docs.sparkSession
    shares = shuffle_parts(spark)
    own = list(docs.columns)
    fields = docs.schema
    doc = F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID))
    rows = docs.select(*own, share(doc, shares).alias("_share"), F.lit(1).alias("_kind"), doc.alias("_doc"))
    later = repeated_windows(docs, size, shares, key, text).select(
        F.col("share").alias("_share"), F.lit(0).alias("_kind"), F.col("docs").alias("_docs"), F.col("hashes").alias("_hashes"))
    # A share's windows come before its documents.
    both = rows.unionByName(later, allowMissingColumns=True).repartitionById(shares, F.col("_share")).sortWithinPartitions("_share", "_kind", "_doc")
    out = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields),
                     "n_words long", "n_removed long", "kept string"])

    @gives_back
    def task(batches):
        made, part, gone = Windows(size), None, Gone()
        for batch in rows_by_size(batches, BYTES, text):
            shares_, kinds = batch.column("_share").to_numpy(), batch.column("_kind").to_numpy()
            for s, e in zip(*runs(shares_.astype(np.int64) * 2 + kinds)):
                if shares_[s] != part:
                    part, gone = shares_[s], Gone()
                rows = batch.slice(s, e - s)
                if kinds[s] == 0:
                    gone.add(rows)
                else:
                    yield _cut(rows, made, gone, own, text)

    return both.mapInArrow(task, out)


class Gone:
    """The repeated windows of a share of documents, by document."""

    def __init__(self) -> None:
        self.held, self.docs, self.hashes = [], np.empty(0, np.int64), np.empty(0, np.uint64)

    def add(self, rows: pa.RecordBatch) -> None:
        self.held += [(unpack_longs(d), unzstd(h, np.uint64)) for d, h in zip(
            rows.column("_docs").to_pylist(), rows.column("_hashes").to_pylist())]

    def of(self, doc: int) -> np.ndarray:
        if self.held:
            docs, hashes = (np.concatenate(x) for x in zip(*self.held))
            order = np.argsort(docs, kind="stable")
            self.docs, self.hashes, self.held = docs[order], hashes[order], []
        return self.hashes[np.searchsorted(self.docs, doc, "left"):np.searchsorted(self.docs, doc, "right")]


def _cut(rows: pa.RecordBatch, made: Windows, gone: Gone, own: list[str], text: str) -> pa.RecordBatch:
    counts, removed, kept = [], [], []
    for doc, data in zip(rows.column("_doc").to_pylist(), rows.column(text).cast(pa.binary()).to_pylist()):
        words = (data or b"").split()
        marks = _covered(made, words, gone.of(doc))
        counts.append(len(words))
        removed.append(int(marks.sum()))
        left = [w for w, m in zip(words, marks.tolist()) if not m] if removed[-1] else words
        kept.append(b" ".join(left).decode("utf-8", "replace"))
    return pa.record_batch([*(rows.column(c) for c in own), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                            pa.array(kept, pa.string())], names=[*own, "n_words", "n_removed", "kept"])


def _covered(made: Windows, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
    gone = np.zeros(len(words) + 1, np.int64)
    if len(hashes) and len(words) >= made.size:
        at = np.flatnonzero(np.isin(made.of(words)[0], hashes))
        np.add.at(gone, at, 1)
        np.add.at(gone, at + made.size, -1)
    return np.cumsum(gone)[:-1] > 0


def digest(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def cut_repeats(docs: DataFrame, size: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the words left as their text; a document of which nothing is left goes, one without words stays.

    All columns stay as they were but `text` and, where there is one, `n_chars`.
    Texts from which nothing is removed are unchanged.
    """
    # Under names of their own the caller's columns meet none of the operator's.
    names, columns = [f"c{i}" for i in range(len(docs.columns))], docs.columns
    place, docs = dict(zip(columns, names)), docs.toDF(*names)
    key, text, n_chars = place[key], place[text], place.get("n_chars")
    cut = without_repeats(docs, size, key, text)
    cut = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    cut = cut.withColumn(text, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(text)))
    if n_chars:
        cut = cut.withColumn(n_chars, F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema[n_chars].dataType))
                             .otherwise(F.col(n_chars)))
    return cut.select(*names).toDF(*columns)
