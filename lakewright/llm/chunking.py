"""Content-defined chunks of bytes: gear hashes of the last 32 bytes choose where a chunk ends."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np

#: A random word for every byte value, from a fixed seed.
GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**32, 256, dtype=np.uint32)
WINDOW = 32


def gear(data: np.ndarray) -> np.ndarray:
    """At every byte the hash of the `WINDOW` bytes that end there, by doubling the window."""
    found, width = GEAR[data], 1
    while width < WINDOW:
        shifted = found[:-width] << np.uint32(width)
        found[width:] += shifted
        width *= 2
    return found


@dataclass(frozen=True)
class Sizes:
    """Least, normal and greatest chunk size in bytes, powers of two; the least is no smaller than the hash's window."""
    least: int
    normal: int
    greatest: int

    def __post_init__(self) -> None:
        if not WINDOW <= self.least < self.normal < self.greatest:
            raise ValueError("sizes must ascend from the width of the hash")


def _mask(bits: int) -> np.uint32:
    """The highest bits: they depend on the whole window."""
    return np.uint32(((1 << bits) - 1) << (32 - bits))


def chunk_ends(bodies: list[bytes], sizes: Sizes, whole_characters: bool = False) -> list[list[int]]:
    """Ends of the chunks of each text; an empty text has none.

    Normalised chunking: before the normal size a chunk ends only where more
    bits of the hash are zero than behind it, so sizes stay near the normal
    one. whole_characters: an end inside a UTF-8 character moves behind it.
    """
    data = np.frombuffer(b"".join(bodies), np.uint8)
    if not len(data):
        return [[] for _ in bodies]
    hashes = gear(data)
    bits = sizes.normal.bit_length() - 1
    easy = np.flatnonzero(hashes & _mask(bits - 1) == 0)
    hard = easy[hashes[easy] & _mask(bits + 1) == 0]
    easy, hard = (easy + 1).tolist(), (hard + 1).tolist()
    found, start = [], 0
    for body in bodies:
        stop, ends, at = start + len(body), [], start
        while at < stop:
            end = _end(at, easy, hard, sizes)
            if whole_characters:
                while end < stop and data[end] & 0xC0 == 0x80:
                    end += 1
            at = min(end, stop)
            ends.append(at - start)
        found.append(ends)
        start = stop
    return found


def _end(at: int, easy: list[int], hard: list[int], sizes: Sizes) -> int:
    i = bisect_left(hard, at + sizes.least)
    if i < len(hard) and hard[i] < at + sizes.normal:
        return hard[i]
    i = bisect_left(easy, at + sizes.normal)
    if i < len(easy) and easy[i] <= at + sizes.greatest:
        return easy[i]
    return at + sizes.greatest
