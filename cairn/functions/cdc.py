"""Content-defined chunking by a gear hash.

A chunk ends after the first byte at which the rolling hash has zeros in the mask's bits, at least `least` and at most
`most` bytes long. The hash of 64 bytes doesn't depend on what lies before them, so the hashes of a whole buffer come
from six doubling steps in numpy; only the 64 bytes after a chunk's warm-up starts need the hash from its reset.
The gear table is a parameter: TABLE is this library's own, so boundaries aren't those of other tables.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np


def own_table() -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.sha256(b"gear" + i.to_bytes(2, "little")).digest()[:8] for i in range(256)), "<u8")


TABLE = own_table()
#: Bytes whose hashes are held at a time.
WINDOW = 4 << 20


@dataclass(frozen=True)
class Chunking:
    target: int = 64 * 1024
    table: np.ndarray = field(default_factory=lambda: TABLE, compare=False, repr=False)

    def __post_init__(self):
        if self.target < 128 or self.target & (self.target - 1):
            raise ValueError("the target size must be a power of two, 128 at least")

    @property
    def least(self) -> int:
        return self.target // 8

    @property
    def most(self) -> int:
        return self.target * 2

    @property
    def mask(self) -> int:
        return (self.target - 1) << (64 - (self.target - 1).bit_length())


def _hits(data: np.ndarray, c: Chunking, before: np.ndarray) -> np.ndarray:
    """Positions at which the hash of the 64 bytes up to them fits the mask; before: up to 63 bytes that precede."""
    h = c.table[np.concatenate([before, data])]
    for k in (1, 2, 4, 8, 16, 32):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint64(k)
        h = h + shifted
    return np.flatnonzero((h[len(before) :] & np.uint64(c.mask)) == 0)


def boundaries(data: bytes, c: Chunking | None = None) -> list[int]:
    """The chunks' ends; none for no data."""
    c = c or Chunking()
    x = np.frombuffer(data, np.uint8)
    hits = np.concatenate([np.zeros(0, np.int64), *[_hits(x[lo : lo + WINDOW], c, x[max(0, lo - 63) : lo]) + lo for lo in range(0, len(x), WINDOW)]])
    ends, start = [], 0
    while start < len(x):
        left = len(x) - start
        if left < c.least:
            ends.append(len(x))
            break
        warm = start + max(c.least - 65, 0)
        stop = min(start + c.most, len(x))
        end, h = None, 0
        for i in range(warm, min(warm + 63, stop)):  # the hash starts from zero here
            h = ((h << 1) + int(c.table[x[i]])) & 0xFFFFFFFFFFFFFFFF
            if not h & c.mask:
                end = i + 1
                break
        if end is None:
            at = np.searchsorted(hits, warm + 63)
            end = int(hits[at]) + 1 if at < len(hits) and hits[at] < stop else stop
        end = max(end, start + min(c.least, left))
        ends.append(end)
        start = end
    return ends


def chunks(data: bytes, c: Chunking | None = None) -> list[tuple[int, int]]:
    """(offset, size) of each chunk."""
    ends = boundaries(data, c)
    return [(a, b - a) for a, b in zip([0, *ends], ends, strict=False)]


class StreamingChunker:
    """Chunks of blocks fed one after another; the same as those of all blocks joined."""

    def __init__(self, c: Chunking | None = None):
        self.c, self.held, self.offset = c or Chunking(), bytearray(), 0

    def _emit(self, found: list[tuple[int, int]]) -> list[tuple[int, bytes]]:
        out = [(self.offset + a, bytes(self.held[a : a + n])) for a, n in found]
        used = sum(n for _, n in found)
        del self.held[:used]
        self.offset += used
        return out

    def feed(self, block: bytes) -> list[tuple[int, bytes]]:
        """Chunks that no later block can change: those that start `most` bytes or more before the end."""
        self.held += block
        size = len(self.held)
        return self._emit([(a, n) for a, n in chunks(bytes(self.held), self.c) if size - a >= self.c.most]) if size >= self.c.most else []

    def finish(self) -> list[tuple[int, bytes]]:
        return self._emit(chunks(bytes(self.held), self.c))
