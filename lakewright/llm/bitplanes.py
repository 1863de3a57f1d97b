"""Token ids as a file format: fixed-size blocks of ids as bit or byte planes, each compressed, with a chunk index.

The files are Parquet, so that Spark's commit protocol guards them on any
store; a row is a segment of whole documents and holds

    part, segment      parts ascend with doc_id, segments within a part
    start              ids in the part before this segment
    n_ids              ids in this segment
    docs, sizes        its documents' ids and numbers of ids
    chunk_ids          chunk index: ids of each chunk
    plane_ends         chunk index: where each plane of each chunk ends in `payload`
    payload            compressed planes, lowest first
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import LAST_ID, longs, pack_longs, rows_by_size, shuffle_parts, texts, unpack_longs
from .encoding import encoder

CHUNK = 1 << 16
SEGMENT = 1 << 20

_SEGMENTS = ("part int, segment int, start long, n_ids long, docs binary, sizes binary, chunk_ids array<int>, "
             "plane_ends array<array<int>>, payload binary")


def to_planes(ids: np.ndarray, bits: bool = True) -> list[np.ndarray]:
    """Planes of an array of ids, lowest first, up to the highest that any id uses."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    width = int(ids.max()).bit_length() if len(ids) else 0
    if not bits:
        return [np.ascontiguousarray(raw[:, i]) for i in range(-(-width // 8))]
    used = np.unpackbits(np.ascontiguousarray(raw[:, :-(-width // 8)]), axis=1, bitorder="little")[:, :width]
    return list(np.packbits(np.ascontiguousarray(used.T), axis=1, bitorder="little"))


def from_planes(planes: list[np.ndarray], n: int, bits: bool = True) -> np.ndarray:
    if not planes:
        return np.zeros(n, np.uint32)
    raw = np.zeros((n, 4), np.uint8)
    if not bits:
        for i, plane in enumerate(planes):
            raw[:, i] = plane
    else:
        spread = np.unpackbits(np.stack(planes), axis=1, count=n, bitorder="little")
        whole = np.zeros((-(-len(planes) // 8) * 8, n), np.uint8)
        whole[:len(planes)] = spread
        raw[:, :len(whole) // 8] = np.packbits(np.ascontiguousarray(whole.T), axis=1, bitorder="little")
    return raw.view("<u4").ravel()


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, bits: bool = True, key: str = "doc_id",
              text: str = "text", chunk: int = CHUNK, segment: int = SEGMENT) -> None:
    """Encodes every text, null as empty, with `end_id` after each, and writes the ids in ascending order of `key`.

    For tokenizers that drop white space and letter case. Documents without
    an id come last; rows with one id follow each other. A document is never
    cut between segments; other columns are not read.
    """
    spark = docs.sparkSession
    rows = texts(docs, key, text)
    parts = shuffle_parts(spark)
    cuts = rows.agg(F.percentile_approx("doc", [i / parts for i in range(1, parts)] or [0.5], 100_000)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    def encode(batches):
        known = encoder(tokenizer_path, True)
        for batch in rows_by_size(batches, 1 << 20):
            ids, lengths = known.encode(batch.column("body").to_pylist(), end_id)
            small = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids.astype("<u4")
            ends, data, width = np.cumsum(lengths) * small.itemsize, small.tobytes(), small.itemsize
            docs_ = longs(batch.column("doc"))
            yield pa.record_batch({
                "part": pa.array(np.searchsorted(cuts, docs_, "left").astype(np.int32)), "doc": docs_,
                "width": np.full(len(docs_), width, np.int32),
                "ids": pa.array([data[e - n:e] for e, n in zip(ends.tolist(), (lengths * width).tolist())], pa.binary())})

    def pack(batches):
        part, number, start, held, n = None, 0, 0, [], 0
        for batch in batches:
            for own, doc, width, data in zip(*(batch.column(c).to_pylist() for c in ("part", "doc", "width", "ids"))):
                if held and (own != part or n >= segment):
                    yield _segment(part, number, start, held, chunk, bits)
                    number, start, held, n = number + 1, start + n, [], 0
                if own != part:
                    part, number, start = own, 0, 0
                ids = np.frombuffer(data, f"<u{width}")
                held.append((doc, ids))
                n += len(ids)
        if held:
            yield _segment(part, number, start, held, chunk, bits)

    (rows.mapInArrow(encode, "part int, doc long, width int, ids binary")
     .repartition(parts, "part").sortWithinPartitions("part", "doc").mapInArrow(pack, _SEGMENTS)
     .write.option("compression", "none").parquet(path))


def _segment(part: int, number: int, start: int, held, chunk: int, bits: bool) -> pa.RecordBatch:
    ids = np.concatenate([i.astype(np.uint32) for _, i in held])
    press = zstandard.ZstdCompressor(level=1)
    payload, chunk_ids, plane_ends, at = [], [], [], 0
    for s in range(0, len(ids), chunk):
        planes = [press.compress(p.tobytes()) for p in to_planes(ids[s:s + chunk], bits)]
        ends = (at + np.cumsum([len(p) for p in planes], dtype=np.int64)).tolist()
        payload += planes
        chunk_ids.append(len(ids[s:s + chunk]))
        plane_ends.append(ends)
        at = ends[-1] if ends else at
    return pa.record_batch([
        pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()),
        pa.array([pack_longs([d for d, _ in held])], pa.binary()), pa.array([pack_longs([len(i) for _, i in held])], pa.binary()),
        pa.array([chunk_ids], pa.list_(pa.int32())), pa.array([plane_ends], pa.list_(pa.list_(pa.int32()))),
        pa.array([b"".join(payload)], pa.binary())],
        names=["part", "segment", "start", "n_ids", "docs", "sizes", "chunk_ids", "plane_ends", "payload"])


def read_chunk(payload: bytes, begin: int, ends: list[int], n: int, bits: bool = True) -> np.ndarray:
    """The ids of one chunk; `begin` is where the chunk before it ends."""
    press, planes = zstandard.ZstdDecompressor(), []
    for end in ends:
        planes.append(np.frombuffer(press.decompress(payload[begin:end]), np.uint8))
        begin = end
    return from_planes(planes, n, bits)


def read_ids(spark: SparkSession, path: str, bits: bool = True, checksums: bool = False) -> DataFrame:
    """From the files doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit).

    checksums: ids_crc32 (long) in place of the ids.
    """
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    # One number per part: as many as the files were dealt to.
    sizes = {r.part: r.n for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    first, total = {}, 0
    for part in sorted(sizes):
        first[part], total = total, total + sizes[part]
    result = pa.field("ids_crc32", pa.int64()) if checksums else pa.field("ids", pa.binary())

    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                begin, ids = 0, []
                for n, ends in zip(row["chunk_ids"], row["plane_ends"]):
                    ids.append(read_chunk(row["payload"], begin, ends, n, bits))
                    begin = ends[-1] if ends else begin
                data = memoryview(np.concatenate(ids).astype("<u4").tobytes() if ids else b"")
                own = unpack_longs(row["sizes"])
                ends = np.cumsum(own)
                parts = [data[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), own.tolist())]
                values = [zlib.crc32(p) for p in parts] if checksums else [bytes(p) for p in parts]
                yield pa.record_batch({"doc": unpack_longs(row["docs"]), "start": first[row["part"]] + row["start"] + ends - own,
                                       "n_tokens": own, result.name: pa.array(values, result.type)})

    found = segments.mapInArrow(task, f"doc long, start long, n_tokens long, {'ids_crc32 long' if checksums else 'ids binary'}")
    return found.select(F.when(F.col("doc") != LAST_ID, F.col("doc")).alias("doc_id"), "start", "n_tokens", result.name)
