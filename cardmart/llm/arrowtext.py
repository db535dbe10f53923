"""Arrow text columns as flat numpy arrays: bytes, word bounds and word hashes without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd multiplier of the byte hash and the constants of the 64-bit finaliser (fixed values).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * MIX[1]
    return x ^ (x >> np.uint64(31))


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the offsets of the rows; null is empty."""
    column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row (one entry more than rows)."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word never spans two rows
    start, end = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    start[:-1] = inside
    start[1:-1] &= ~inside[:-1] | edge[1:-1]
    end[1:] = inside
    end[1:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start[:-1]), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Bytes that are hashed at once.
CHUNK = 1 << 18


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: mixed bytes in a polynomial over the place inside the word."""
    lengths = ends - starts
    before = np.concatenate(([0], np.cumsum(lengths)))
    table = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
    power = powers(int(lengths.max()) if len(lengths) else 1, BASE | np.uint64(1))
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(before, before[at] + CHUNK)) - 1)
        n, first = lengths[at:to], before[at:to] - before[at]
        inner = np.arange(before[to] - before[at]) - np.repeat(first, n)
        value = table[data[inner + np.repeat(starts[at:to], n)]] * power[inner]
        out[at:to] = np.add.reduceat(value, first)
        at = to
    return mix(out ^ (lengths.astype(np.uint64) * BASE))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size hashes (fewer words than that: none)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.array([BASE | np.uint64(1)])  # arrays, which wrap around without a warning
    total, power = np.zeros(n, np.uint64), np.ones(1, np.uint64)
    doubling, done, bits = words.copy(), 0, size
    width = 1
    # a window of any size is put together from windows of 1, 2, 4 ... words
    factor = base
    while bits:
        if bits & 1:
            total += doubling[done : done + n] * power
            done += width
            power = power * factor
        bits >>= 1
        if bits:
            doubling = doubling[: len(doubling) - width] + doubling[width:] * factor
            factor = factor * factor
            width *= 2
    return mix(total)


def row_slices(column: pa.Array, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of at most so many bytes each, or of one longer row."""
    offsets = flat_bytes(column)[1]
    out, at = [], 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        out.append((at, to - at))
        at = to
    return out
