"""Compressed FM-index over word numbers: a wavelet matrix of the Burrows-Wheeler transform and symbol counts.

The suffix array, by prefix doubling, and the indexed text are needed to build it alone and
are not kept. Matching statistics of many places of a streamed text are found at once.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """rank(symbol, place) over a sequence; per bit of the alphabet one bit vector with counts per 64 bits."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.levels = []
        s = sequence.astype(np.int32)
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level & 1).astype(np.uint8)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(packed) + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            self.levels.append((packed, before, len(bit) - int(bit.sum())))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

        symbols = np.arange(symbols)
        self.begin = self._down(symbols, [np.zeros(len(symbols), np.int64)])[0]  # where each symbol's run begins at the last level

    def _down(self, symbol: np.ndarray, places: list[np.ndarray]) -> list[np.ndarray]:
        for k, (packed, before, zeros) in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            for n, at in enumerate(places):
                word = at >> 6
                ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
                places[n] = np.where(one, zeros + ones, at - ones)
        return places

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before low and before high."""
        begin = self.begin[symbol]
        low, high = self._down(symbol, [low, high])
        return low - begin, high - begin


def suffix_array(sequence: np.ndarray, longest: int) -> np.ndarray:
    """Order of the suffixes, which differ within `longest` symbols."""
    n = len(sequence)
    rank, step = sequence.astype(np.int64), 0
    while True:
        if step:
            other = np.zeros(n, np.int64)
            other[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + other
        else:
            key = rank
        order = np.argsort(key)
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = new
        if rank[order[-1]] == n - 1 or step > longest:
            return order
        step = max(1, step * 2)


class FMIndex:
    """Index of segments of symbols 1..symbols-1, of `lengths` each; a border that equals no other ends each segment."""

    def __init__(self, segments: np.ndarray, lengths: np.ndarray, symbols: int):
        count = len(lengths)
        begin = np.cumsum(lengths + 1) - (lengths + 1)  # of each segment in the text with borders
        text = np.zeros(len(segments) + count, np.int32)
        real = np.ones(len(text), bool)
        real[begin + lengths] = False
        text[real] = segments
        unique = text + np.int32(count - 1)
        unique[~real] = np.arange(count)
        bwt = text[suffix_array(unique, int(lengths.max()) + 1) - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.wavelet = WaveletMatrix(bwt, symbols)

    def matching(self, text: np.ndarray, ends: np.ndarray, room: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics before each of `ends` in a text: (length, low, high).

        length: symbols of the longest run that ends there, within the `room` before it and at most
        `most`, and that the index has more than once; low and high: its interval, 0 and 0 for none.
        """
        length, lows, highs = (np.zeros(len(ends), np.int32) for _ in range(3))
        at, symbol = np.arange(len(ends)), text[ends - 1]
        low, high = self.before[symbol], self.before[symbol + 1]
        for k in range(1, most + 1):
            more = high - low > 1
            at, low, high = at[more], low[more], high[more]
            length[at], lows[at], highs[at] = k, low, high
            go = room[at] > k
            at, low, high = at[go], low[go], high[go]
            if k == most or not len(at):
                break
            symbol = text[ends[at] - k - 1]
            a, b = self.wavelet.ranks(symbol, low, high)
            low, high = self.before[symbol] + a, self.before[symbol] + b
        return length, lows, highs
