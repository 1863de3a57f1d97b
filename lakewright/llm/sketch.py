"""Count-min sketch of 64-bit hashes: tasks' sketches are merged by segment; tells which values may have come twice."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back, gives_back, runs, unzstd, zstd

#: Cells in a segment; a segment is the unit of merging.
SEGMENT = 1 << 20
#: Most cells in a row of the sketch: two bitmaps of 128 MB in each Python worker.
MOST_CELLS = 1 << 30


def cells_for(values: int, each: int = 4) -> int:
    """Cells of a row: `each` for every expected value, up to MOST_CELLS, beyond which estimates only get coarser."""
    return min(MOST_CELLS, max(SEGMENT, -(-values * each // SEGMENT) * SEGMENT))


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cell of each 64-bit hash in a row of the sketch; the two rows use its two halves."""
    half = hashes >> np.uint64(32) if row == 0 else hashes & np.uint64(0xFFFFFFFF)
    half *= np.uint64(width)
    half >>= np.uint64(32)
    return half.astype(np.uint32)


def partial_sketch(hashes: np.ndarray, width: int) -> pa.RecordBatch:
    """Segments that hold a cell: those that count one or more, and two or more, as packed places."""
    segments, ones, twos = [], [], []
    for row in range(2):
        ordered = cells(hashes, row, width)
        ordered.sort()
        # Masks instead of places: a task holds millions of cells.
        new = np.ones(len(ordered) + 1, bool)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:-1])
        found, more = ordered[new[:-1]], ~new[1:][new[:-1]]
        own = found // SEGMENT
        for s, e in zip(*runs(own)):
            segments.append(row * (MOST_CELLS // SEGMENT) + int(own[s]))
            ones.append(_packed(found[s:e] % SEGMENT))
            twos.append(_packed(found[s:e][more[s:e]] % SEGMENT))
    return pa.record_batch({"segment": pa.array(segments, pa.int32()), "ones": pa.array(ones, pa.binary()),
                            "twos": pa.array(twos, pa.binary())})


PARTIAL = "segment int, ones binary, twos binary"


def _packed(places: np.ndarray) -> bytes:
    """Ascending places in a segment: differences by byte planes, little more than a byte for each."""
    steps = np.diff(places, prepend=np.uint32(0)).astype("<u4")
    return zstd(steps.view(np.uint8).reshape(-1, 4).T)


def _bits(packed: bytes) -> np.ndarray:
    """The bitmap of packed places."""
    steps = np.ascontiguousarray(unzstd(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    bits = np.zeros(SEGMENT, np.uint8)
    bits[np.cumsum(steps)] = 1
    return np.packbits(bits, bitorder="little")


@dataclass
class Repeated:
    """Bitmaps of the cells that count two or more, one per row."""
    width: int
    rows: list[np.ndarray]

    # It travels compressed, and is opened once in each Python worker.
    def __getstate__(self):
        return self.width, [zstd(r) for r in self.rows]

    def __setstate__(self, state) -> None:
        self.width, self.rows = state[0], [unzstd(r, np.uint8) for r in state[1]]

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        """True where the least count over the rows is two or more: for every repeated value, and some others."""
        found = np.ones(len(hashes), bool)
        for row, bits in enumerate(self.rows):
            cell = cells(hashes, row, self.width)
            found &= bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 == 1
        return found


def merged(partials: DataFrame, width: int) -> Repeated:
    """All tasks' sketches added up.

    A task merges a segment as a stream of places, whatever their number.
    Only the bitmaps of repeated cells reach the driver: 2 * width / 8 bytes
    at most, so never more than 2 * MOST_CELLS / 8.
    """
    @gives_back
    def task(batches):
        last, one, two = None, None, None
        for batch in batches:
            for segment, ones, twos in zip(*(batch.column(c).to_pylist() for c in ("segment", "ones", "twos"))):
                if segment != last:
                    if last is not None and two.any():
                        yield _row(last, two)
                    last, one, two = segment, np.zeros(SEGMENT // 8, np.uint8), np.zeros(SEGMENT // 8, np.uint8)
                new = _bits(ones)
                two |= one & new | _bits(twos)
                one |= new
        if last is not None and two.any():
            yield _row(last, two)

    rows = [np.zeros(width // 8, np.uint8) for _ in range(2)]
    found = partials.repartition("segment").sortWithinPartitions("segment").mapInArrow(task, "segment int, twos binary")
    for segment, twos in found.toLocalIterator():
        row, own = divmod(segment, MOST_CELLS // SEGMENT)
        rows[row][own * SEGMENT // 8:(own + 1) * SEGMENT // 8] = unzstd(bytes(twos), np.uint8)
    give_back()
    return Repeated(width, rows)


def _row(segment: int, two: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"segment": pa.array([segment], pa.int32()), "twos": pa.array([zstd(two)], pa.binary())})
