"""Small helpers that several operators use inside their tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

#: Mixing constants of a 64-bit finaliser (fixed values).
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class ByteHash:
    """64-bit hashes of many slices of one byte buffer, by differences of one running sum.

    Each byte counts with a random weight times a power of an odd base; the power is divided out again, so a slice's
    hash depends on its bytes only.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self._weights = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self._powers, self._inverse = _powers(self.BASE, 1), _powers(pow(self.BASE, -1, 1 << 64), 1)

    def slices(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        if n >= len(self._powers):
            self._powers = _powers(self.BASE, 2 * n)
            self._inverse = _powers(pow(self.BASE, -1, 1 << 64), 2 * n)
        running = np.zeros(n + 1, np.uint64)
        np.cumsum(self._weights[np.frombuffer(data, np.uint8)] * self._powers[:n], out=running[1:])
        return mix64((running[ends] - running[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))


class WordHash:
    """64-bit hashes of many slices of one byte buffer: eight bytes after the other are mixed in, so nothing is linear.

    Hashes of two seeds are independent of each other. A slice of up to eight bytes shares its hash with none of its length.
    """

    #: Steps of eight bytes that all slices take together; what is longer goes on alone.
    STEPS = 64

    def __init__(self, seed: int) -> None:
        self._seed = seed
        self._start, self._add = mix64(np.array([2 * seed + 1, 2 * seed + 2], np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def slices(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        # All stretches of eight bytes, as numbers.
        eights = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
        out = mix64((ends - starts).astype(np.uint64) + self._start)
        rows, at = np.arange(len(starts)), starts
        for _ in range(self.STEPS):
            left = np.minimum(ends[rows] - at, 8)
            some = left > 0
            if not some.all():
                rows, at, left = rows[some], at[some], left[some]
            if not len(rows):
                return out
            value = eights[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left.astype(np.uint64)))
            out[rows] = mix64((out[rows] ^ value) * np.uint64(ByteHash.BASE) + self._add)
            at = at + 8
        for row, begin in zip(rows.tolist(), at.tolist(), strict=True):
            rest = xxh64_intdigest(data[begin:ends[row]], self._seed)
            out[row:row + 1] = mix64((out[row:row + 1] ^ np.uint64(rest)) * np.uint64(ByteHash.BASE) + self._add)
        return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of a UTF-8 buffer."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _BLANK[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[0::2], edges[1::2]


def bounded(values: list[bytes | None], most: int) -> Iterator[range]:
    """Runs of neighbouring values with about `most` bytes together; a longer value stands alone."""
    start = size = 0
    for i, value in enumerate(values):
        here = len(value) if value else 0
        if size and size + here > most:
            yield range(start, i)
            start, size = i, 0
        size += here
    if start < len(values):
        yield range(start, len(values))


def arrow_map(function: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A `mapInArrow` function that treats one batch after the other; None leaves the batch out."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None:
                yield out

    return over


def ragged_arange(counts: np.ndarray) -> np.ndarray:
    """0..counts[0]-1, 0..counts[1]-1, and so on, in one array."""
    total = int(counts.sum())
    firsts = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(firsts, counts)
