"""Helpers of the operators in this folder."""

from __future__ import annotations

import ctypes
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: An id of its own for documents without one: they come after all others.
LAST_ID = 2**63 - 1


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only what an operator reads: `doc` (long, may be null) and `body` (UTF-8 bytes, null: empty)."""
    return docs.select(F.col(key).cast("long").alias("doc"), body(text).alias("body"))


def body(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(key: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo `folds`, is `fold`. An id that is null is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def longs(column: pa.Array, null: int = LAST_ID) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def rows_by_size(batches, limit: int, size: str = "body"):
    """Arrow batches cut so that the binary column `size` of each holds about `limit` bytes; a longer row comes alone."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(size)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def gives_back(task):
    """The task, at whose end the memory it has freed goes back to the system.

    Spark keeps a Python worker for the tasks of all later stages, and the allocators of
    Python and Arrow keep what the largest task of it took.
    """
    @wraps(task)
    def run(batches):
        yield from task(batches)
        give_back()
    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


@lru_cache
def _trim():
    """malloc_trim, which GNU's C library has."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


class Words(dict):
    """Word (bytes) -> place in `hashes`, two 64-bit hashes of each word met so far. Starts anew beyond `limit` words."""

    def __init__(self, limit: int = 300_000) -> None:
        super().__init__()
        self.limit, self.fresh, self.hashes = limit, [], np.empty((0, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        self.fresh.append(xxhash.xxh3_128_digest(word))
        return place

    def of(self, words: list[bytes]) -> np.ndarray:
        """Hashes of the words, one row each."""
        if len(self) > self.limit:
            self.clear()
            self.hashes = np.empty((0, 2), np.uint64)
        places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            new = np.frombuffer(b"".join(self.fresh), np.uint64).reshape(-1, 2)
            self.hashes, self.fresh = np.concatenate([self.hashes, new]), []
        return self.hashes[places]


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """Fixed odd 64-bit multipliers."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache
def _press() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@lru_cache
def _unpress() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def zstd(data) -> bytes:
    return _press().compress(np.ascontiguousarray(data).tobytes())


def unzstd(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(_unpress().decompress(data), dtype)


def pack_ids(ids: np.ndarray) -> bytes:
    """Unsigned 32-bit ids: as many byte planes as they need."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    used = -(-int(ids.max()).bit_length() // 8) if len(ids) else 0
    return used.to_bytes(1, "little") + zstd(raw[:, :used].T) if used else len(ids).to_bytes(9, "big")


def unpack_ids(data: bytes) -> np.ndarray:
    if not data[0]:
        return np.zeros(int.from_bytes(data, "big"), np.uint32)
    planes = unzstd(data[1:], np.uint8).reshape(data[0], -1)
    raw = np.zeros((planes.shape[1], 4), np.uint8)
    raw[:, :data[0]] = planes.T
    return raw.view("<u4").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit integers: differences, by byte planes."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstd(steps.view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = unzstd(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_longs(values: np.ndarray) -> bytes:
    return zstd(np.asarray(values, "<i8").view(np.uint8).reshape(-1, 8).T)


def unpack_longs(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unzstd(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def share_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Places 0..parts-1 that ascend with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    if not len(sorted_values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return starts, np.append(starts[1:], len(sorted_values))
