"""Token counts of texts; huge ones in overlapping chunks that are spliced where two encodings agree.

A huge text is cut into chunks, each of which runs on into the next one. The
chunks are dealt to all tasks and encoded with offsets. Two neighbours are
spliced inside their overlap, at a place where both have a boundary and the
same ids before it. Where there is no such place the text is cut again
with wider chunks and overlaps, in the end as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lakewright.session import cut_lineage

from .common import rows_by_size, shuffle_parts, texts
from .encoding import encoder, tokenizer

#: A boundary is stable where a visible ASCII character is followed by one of these: no token, special
#: token or normalisation reaches over it, so what follows is encoded alike whatever comes before.
_BLANKS = np.frombuffer(b" \t\n\r", np.uint8)


@dataclass(frozen=True)
class Cuts:
    """In characters: how far chunks lie apart, and how far each reaches into the next. A text of twice `chunk` bytes is not cut."""
    chunk: int = 1 << 14
    overlap: int = 1 << 8

    def __post_init__(self) -> None:
        if not 0 < self.overlap <= self.chunk:
            raise ValueError("an overlap is no longer than the chunk")

    def wider(self) -> "Cuts":
        return Cuts(self.chunk * 4, self.overlap * 16 if self.overlap * 16 <= self.chunk * 4 else self.chunk * 4)

    def spans(self, n: int) -> list[tuple[int, int]]:
        """Begin and end of every chunk of a text of n characters."""
        count = max(1, -(-(n - self.overlap) // self.chunk))
        return [(k * self.chunk, n if k == count - 1 else (k + 1) * self.chunk + self.overlap) for k in range(count)]


@dataclass(frozen=True)
class Encoded:
    """A chunk: all its tokens; at each stable boundary its place in the text, the tokens before it, and a hash of those since the boundary before."""
    n_tokens: int
    places: np.ndarray
    before: np.ndarray
    hashes: np.ndarray

    def inside(self, begin: int, end: int) -> "Encoded":
        found = slice(*np.searchsorted(self.places, [begin, end + 1]))
        return Encoded(self.n_tokens, self.places[found], self.before[found], self.hashes[found])

    def pack(self) -> bytes:
        return np.stack([self.places, self.before, self.hashes]).astype("<i8").tobytes()


def unpack(n_tokens: int, data: bytes) -> Encoded:
    return Encoded(n_tokens, *np.frombuffer(data, "<i8").reshape(3, -1))


def encode_chunks(chunks: list[tuple[int, str]], path: str) -> list[Encoded]:
    """Chunks of texts (place in the text, characters), encoded with offsets."""
    out = []
    for (begin, text), own in zip(chunks, tokenizer(path).encode_batch([t for _, t in chunks], add_special_tokens=False)):
        ids = np.array(own.ids, "<u4")
        starts, ends = np.array(own.offsets, np.int64).reshape(-1, 2).T
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.flatnonzero((points[:-1] > 0x20) & (points[:-1] < 0x7F) & np.isin(points[1:], _BLANKS)) + 1
        before = np.searchsorted(starts, at)
        free = before == np.searchsorted(ends, at, "right")
        at, before = at[free], before[free]
        raw, cuts = ids.tobytes(), [0, *before.tolist()]
        hashes = np.array([xxhash.xxh3_64_intdigest(raw[4 * a:4 * b]) for a, b in zip(cuts, cuts[1:])], np.uint64).view(np.int64)
        out.append(Encoded(len(ids), at + begin, before, hashes))
    return out


def splice(left: Encoded, right: Encoded) -> tuple[int, int] | None:
    """Tokens of both chunks before the first common boundary with the same ids since the one before it; None where there is none.

    The right chunk's first piece may have lost its beginning, which its hash shows.
    """
    common, a, b = np.intersect1d(left.places, right.places, return_indices=True)
    same = np.flatnonzero(left.hashes[a] == right.hashes[b])
    return (int(left.before[a[same[0]]]), int(right.before[b[same[0]]])) if len(same) else None


def token_counts(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text", cuts: Cuts = Cuts()) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    For tokenizers that drop white space and letter case, and have no special token with white space in it; special
    tokens in a text count as such. A null text counts as empty; a null id
    stays null; repeated rows give repeated rows; other columns are not read. A text that is
    no valid UTF-8 is encoded with replacement characters.
    """
    whole = 2 * cuts.chunk

    def task(batches):
        from pyspark import TaskContext
        known, row = encoder(path, True), TaskContext.get().partitionId() << 32
        for batch in rows_by_size(batches, 1 << 20):
            doc, bodies = batch.column("doc").to_pylist(), batch.column("body").to_pylist()
            short = [n for n, b in enumerate(bodies) if len(b) <= whole]
            counts = known.counts([bodies[n] for n in short])
            yield pa.record_batch([
                pa.nulls(len(short), pa.int64()), pa.array([doc[n] for n in short], pa.int64()),
                pa.array([len(bodies[n]) for n in short], pa.int64()), pa.array(counts, pa.int64()), pa.nulls(len(short), pa.binary())],
                names=["row", "doc", "n_bytes", "n_tokens", "body"])
            huge = [n for n, b in enumerate(bodies) if len(b) > whole]
            if huge:
                yield pa.record_batch([
                    pa.array(range(row, row + len(huge)), pa.int64()), pa.array([doc[n] for n in huge], pa.int64()),
                    pa.array([len(bodies[n]) for n in huge], pa.int64()), pa.nulls(len(huge), pa.int64()),
                    pa.array([bodies[n] for n in huge], pa.binary())],
                    names=["row", "doc", "n_bytes", "n_tokens", "body"])
                row += len(huge)

    found = cut_lineage(texts(docs, key, text).mapInArrow(task, "row long, doc long, n_bytes long, n_tokens long, body binary"), "counted")
    done = [found.where("body is null").select(F.col("doc").alias("doc_id"), "n_bytes", "n_tokens")]
    left, n = found.where("body is not null").select("row", "doc", "n_bytes", "body"), None
    while n != 0:
        counts = cut_lineage(_count_huge(left, path, cuts), "spliced")
        done.append(counts.where("n_tokens is not null").select(F.col("doc").alias("doc_id"), "n_bytes", "n_tokens"))
        failed = counts.where("n_tokens is null").select("row")
        n = failed.count()
        left, cuts = left.join(failed, "row", "left_semi"), cuts.wider()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def _count_huge(huge: DataFrame, path: str, cuts: Cuts) -> DataFrame:
    """`row`, `doc`, `n_bytes`, `n_tokens` (null: could not be aligned) of whole texts."""
    def split(batches):
        for batch in rows_by_size(batches, 1 << 20):
            for row, doc, n_bytes, body in zip(*(batch.column(c).to_pylist() for c in ("row", "doc", "n_bytes", "body"))):
                text = body.decode("utf-8", "replace")
                spans = cuts.spans(len(text))
                yield pa.record_batch({
                    "row": np.full(len(spans), row), "doc": pa.array([doc] * len(spans), pa.int64()), "n_bytes": np.full(len(spans), n_bytes),
                    "chunk": np.arange(len(spans)), "begin": np.array([b for b, _ in spans], np.int64),
                    "body": pa.array([text[b:e].encode("utf-8", "surrogatepass") for b, e in spans], pa.binary())})

    def encode(batches):
        for batch in rows_by_size(batches, 1 << 18):
            chunks = [(b, x.decode("utf-8", "surrogatepass")) for b, x in zip(batch.column("begin").to_pylist(), batch.column("body").to_pylist())]
            made = encode_chunks(chunks, path)
            edges = []
            for (begin, text), own in zip(chunks, made):
                end = begin + len(text)
                head, tail = own.inside(begin, begin + cuts.overlap), own.inside(end - cuts.overlap, end)
                edges.append((head.pack(), tail.pack()))
            yield pa.record_batch({
                **{c: batch.column(c) for c in ("row", "doc", "n_bytes", "chunk")}, "n_tokens": np.array([m.n_tokens for m in made], np.int64),
                "head": pa.array([h for h, _ in edges], pa.binary()), "tail": pa.array([t for _, t in edges], pa.binary())})

    def join(batches):
        last, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if last is not None and row["row"] != last["row"]:
                    yield _spliced(last, held)
                    held = []
                held, last = _joined(held, row), row
        if last is not None:
            yield _spliced(last, held)

    chunks = huge.mapInArrow(split, "row long, doc long, n_bytes long, chunk long, begin long, body binary")
    encoded = chunks.repartition(shuffle_parts(huge.sparkSession), "row", "chunk").mapInArrow(
        encode, "row long, doc long, n_bytes long, chunk long, n_tokens long, head binary, tail binary")
    return encoded.repartition("row").sortWithinPartitions("row", "chunk").mapInArrow(join, "row long, doc long, n_bytes long, n_tokens long")


def _joined(held: list, row: dict) -> list:
    """[tokens so far, those of the last chunk that another one counts, its tail, aligned so far] with one more chunk."""
    tail = unpack(row["n_tokens"], row["tail"])
    if not held:
        return [0, 0, tail, True]
    total, dropped, left, good = held
    found = splice(left, unpack(row["n_tokens"], row["head"])) if good else None
    return [total + found[0] - dropped, found[1], tail, True] if found else [0, 0, tail, False]


def _spliced(row: dict, held: list) -> pa.RecordBatch:
    total, dropped, tail, good = held
    return pa.record_batch([pa.array([row["row"]], pa.int64()), pa.array([row["doc"]], pa.int64()), pa.array([row["n_bytes"]], pa.int64()),
                            pa.array([total + tail.n_tokens - dropped if good else None], pa.int64())], names=["row", "doc", "n_bytes", "n_tokens"])
