"""Hashed word shingles of whole columns of text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: An odd base for the hash of a word's bytes, its inverse modulo 2**64, and multipliers for word places.
BASE = 0x9E3779B97F4A7C15
_draw = np.random.default_rng(20240229)
_BYTE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _draw.integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i up to n at least."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = pow(BASE, -1, 1 << 64)
        one = np.ones(size, np.uint64)
        one[1:] = U(BASE)
        other = np.ones(size, np.uint64)
        other[1:] = U(inverse)
        _powers[size] = np.cumprod(one), np.cumprod(other)
    return _powers[size]


def forget() -> None:
    """Give back what the process holds between calls: workers outlive a task, and the next stage needs their memory."""
    _powers.clear()
    pa.default_memory_pool().release_unused()


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) and the number of words of each text."""
    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size = int(ends[-1] - ends[0]) if len(texts) else 0
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    raw = np.frombuffer(data, np.uint8, count=size, offset=int(ends[0]))
    ends = ends - ends[0]
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][(ends[:-1] < size)]
    begins[first] = inside[first]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = ends[1:][ends[1:] > 0] - 1
    stops[last] = inside[last]
    (begin,), (stop,) = np.nonzero(begins), np.nonzero(stops)
    up, down = powers(size)
    sums = np.cumsum(_BYTE[raw] * up[:size])
    h = sums[stop] - np.where(begin > 0, sums[begin - 1], U(0))
    h = mixed(h * down[begin] + (stop - begin).astype(np.uint64))
    return h, np.diff(np.searchsorted(begin, ends))


def shingle_hashes(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``width`` words and their number for each text; fewer words make one shingle, none make none."""
    words, n = word_hashes(texts)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    total = int(count.sum())
    start = np.repeat(np.cumsum(n) - n - (np.cumsum(count) - count), count) + np.arange(total)
    length = np.minimum(np.repeat(n, count), width)
    h = np.zeros(total, np.uint64)
    for j in range(width):
        there = length > j
        h[there] += mixed(words[start[there] + j] ^ _PLACE[j]) * _PLACE[j + 8]
    return mixed(h + length.astype(np.uint64)), count
