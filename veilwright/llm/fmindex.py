"""A small compressed full-text index over integer symbols: suffix order, wavelet matrix, backward search.

It serves one shard inside one task. All searches run in lockstep, one array operation for all of them.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with rank: a running popcount per 64-bit word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self._words = np.packbits(padded, bitorder="little").view(np.uint64)
        self._before = np.concatenate([[0], np.cumsum(np.bitwise_count(self._words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits."""
        word = at >> 6
        inside = self._words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self._before[word] + np.bitwise_count(inside)


class WaveletMatrix:
    """Symbols bit by bit, the most significant level first, each level sorted stably by the bit."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.size, self._levels = len(symbols), []
        for shift in range(max(1, (alphabet - 1).bit_length()) - 1, -1, -1):
            bit = ((symbols >> shift) & 1).astype(bool)
            self._levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of `symbol` among the first `at` places, for arrays of both."""
        begin, end = np.zeros_like(at), at
        for shift, bits, zeros in self._levels:
            ones = bits.rank(np.concatenate([begin, end]))
            ones_begin, ones_end = ones[:len(begin)], ones[len(begin):]
            one = ((symbol >> shift) & 1).astype(bool)
            begin = np.where(one, zeros + ones_begin, begin - ones_begin)
            end = np.where(one, zeros + ones_end, end - ones_end)
        return end - begin


def suffix_order(text: np.ndarray, alphabet: int, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Positions ordered by their next `depth` symbols or more, and (depth, rank) tables on the way.

    Ranks of neighbouring stretches are packed into one integer: three at a time where they fit, else two.
    """
    n, reach, rank, top = len(text), 1, text.astype(np.int64), alphabet
    tables = [(1, rank)]
    while True:
        width = max(1, top.bit_length())
        parts = 3 if 3 * width <= 62 else 2
        key = rank + 1
        for k in range(1, parts):
            later = np.zeros(n, np.int64)
            if k * reach < n:
                later[:n - k * reach] = rank[k * reach:] + 1
            key = (key << width) | later
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]).astype(np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        top, reach = n, reach * parts
        tables.append((reach, rank))
        if reach >= depth:
            return order, tables


class FMIndex:
    """Index of `text` (symbols from 0, below `alphabet`) for patterns of up to `longest` symbols.

    Suffixes need to be sorted by `longest` symbols only: intervals of shorter patterns, and the steps between them, do
    not depend on the order beyond.
    """

    def __init__(self, text: np.ndarray, alphabet: int, longest: int) -> None:
        self.order, tables = suffix_order(text, alphabet, longest)
        self._tables = tables
        self._smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self._last = WaveletMatrix(text[self.order - 1], alphabet)
        self.size = len(text)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of `symbol` followed by the patterns of [low, high)."""
        found = self._last.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self._smaller[symbol] + found[:len(low)], self._smaller[symbol] + found[len(low):]

    def heads(self, depth: int) -> np.ndarray:
        """Marks the places in suffix order where the next `depth` symbols differ from those of the place before."""
        reach, rank = max((t for t in self._tables if t[0] <= depth), key=lambda t: t[0])
        marks = np.ones(self.size, bool)
        marks[1:] = False
        for offset in [*range(0, depth - reach, reach), depth - reach]:
            shifted = np.full(self.size, -1, np.int64)
            shifted[:self.size - offset] = rank[offset:]
            here = shifted[self.order]
            marks[1:] |= here[1:] != here[:-1]
        return marks


def matching_windows(passages: list[np.ndarray], owners: np.ndarray, alphabet: int, window: int) -> list[np.ndarray]:
    """For each window of each passage, the smallest owner among all passages that hold the same window.

    The passages (symbols from 1; 0 parts them) are indexed together and streamed through the index from their ends:
    each step puts one more symbol in front of the match, and a match of `window` symbols first lets its last one go.
    """
    lengths = np.array([len(p) for p in passages])
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(int(lengths.sum()) + len(passages), np.int64)
    for at, p in zip(starts.tolist(), passages, strict=True):
        text[at:at + len(p)] = p
    index = FMIndex(text, alphabet, window)
    places = np.arange(index.size)
    # Where a match of window - 1 symbols that includes a place begins and ends.
    shorter = index.heads(window - 1)
    opens = np.maximum.accumulate(np.where(shorter, places, 0))
    closes = np.append(np.flatnonzero(shorter), index.size)[np.cumsum(shorter)]
    # The smallest owner of each class of equal windows.
    heads = index.heads(window)
    owner_of = np.repeat(owners, lengths + 1)[index.order]
    smallest = np.minimum.reduceat(owner_of, np.flatnonzero(heads))
    class_of = np.cumsum(heads) - 1

    out = [np.zeros(0, owners.dtype)] * len(passages)
    found = np.zeros(int(np.maximum(0, lengths - window + 1).sum()), owners.dtype)
    first_window = np.cumsum(np.maximum(0, lengths - window + 1)) - np.maximum(0, lengths - window + 1)
    active = np.argsort(-lengths, kind="stable")
    low, high = np.zeros(len(active), np.int64), np.full(len(active), index.size, np.int64)
    for step in range(int(lengths.max(initial=0))):
        alive = int(np.searchsorted(-lengths[active], -step, side="left"))  # longer than `step`
        active, low, high = active[:alive], low[:alive], high[:alive]
        if step >= window:
            low, high = opens[low], closes[low]
        at = lengths[active] - 1 - step
        low, high = index.extend(text[starts[active] + at], low, high)
        if step >= window - 1:
            found[first_window[active] + at] = smallest[class_of[low]]
    for i, (a, n) in enumerate(zip(first_window.tolist(), lengths.tolist(), strict=True)):
        out[i] = found[a:a + max(0, n - window + 1)]
    return out
