"""Words and tokens of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once; a longer text is handled alone.
CHUNK = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser of MurmurHash3, in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def mix(x: np.ndarray) -> np.ndarray:
    return _mixed(x.astype(np.uint64, copy=True))


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * _GOLD + np.uint64(seed))


_VALUES = numbers(256, 17) | np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)

#: Byte classes: 0 ASCII white space, 1 the rest.
SPACES = np.ones(256, np.uint8)
SPACES[[0x20, *range(0x09, 0x0E)]] = 0
#: 0 white space, 1 letters, digits and bytes of other scripts, 2 ASCII punctuation and controls.
SHAPES = np.full(256, 2, np.uint8)
SHAPES[[0x20, *range(0x09, 0x0E)]] = 0
SHAPES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 32


@dataclass
class Words:
    data: np.ndarray  # bytes of the texts
    start: np.ndarray  # of each word in data
    end: np.ndarray
    doc: np.ndarray  # the word's text, as a row number of the chunk
    first: np.ndarray  # the first word of each text, and the number of words at the end
    hash: np.ndarray  # of each word, 64 bits


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(first row, rows) of pieces with at most `most` bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > at and total + size > most:
            yield at, k - at
            at, total = k, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes) - at


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array, classes: np.ndarray = SPACES, lower: bool = False) -> Words:
    """Maximal runs of bytes of one class other than 0; a text's border also ends a run."""
    data, offsets = buffers(column)
    if lower:
        data = LOWERED[data]
    kind = classes[data]
    new = np.empty(len(data), bool)
    if len(data):
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new[offsets[:-1][offsets[:-1] < len(data)]] = True
    runs = np.flatnonzero(new)
    ends = np.append(runs[1:], len(data))
    real = kind[runs] != 0
    start, end = runs[real], ends[real]
    length = end - start
    if len(start):
        power = np.multiply.accumulate(np.full(int(length.max()), _BASE, np.uint64))
        inside = np.repeat(start, length)
        at = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
        inside += at
        value = _VALUES[data[inside]] * power[at]
        hashed = _mixed(np.add.reduceat(value, np.cumsum(length) - length))
    else:
        hashed = np.zeros(0, np.uint64)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, start, end, doc, first, hashed)


def ngrams(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that start at each word, over text borders too; fewer than n words give none."""
    if len(hashed) < n:
        return np.zeros(0, np.uint64)
    total = hashed[: len(hashed) - n + 1].copy()
    for k in range(1, n):
        total *= _BASE
        total += hashed[k : len(hashed) - n + 1 + k]
    return _mixed(total)
