"""Vectorised text kernels that run inside Arrow tasks.

Words are maximal runs of bytes other than space and 0x09-0x0D. Non-ASCII bytes are word bytes,
so working on UTF-8 gives the same words as working on characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel works on at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, at least n of them, grown by doubling."""
    table = _tables.get(base, np.ones(1, dtype=np.uint64))
    while len(table) < n:
        table = np.concatenate([table, table * np.uint64(pow(base, len(table), 1 << 64))])
    if n <= 2 * SLICE_BYTES:  # those of a very long word aren't kept
        _tables[base] = table
    return table[:n]


def release() -> None:
    """Give memory that is free in this worker back to the system: workers are used again, by other stages too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about `limit` bytes; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
    del data, offsets, column
    release()


@dataclass
class Words:
    """The words of a slice: byte ranges, the row of each, and the rows' first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: its letters as the digits of a number, from running sums over the bytes of a stretch."""
        n, out, i = len(self), np.empty(len(self), dtype=np.uint64), 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.start, self.start[i] + SLICE_BYTES)))
            begin, start, end = self.start[i], self.start[i:j] - self.start[i], self.end[i:j] - self.start[i]
            size = int(end[-1])
            sums = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum((self.data[begin : begin + size].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, size), out=sums[1:])
            out[i:j] = (sums[end] - sums[start]) * _powers(_INVERSE, size)[start]
            i = j
        return mix(out + _GOLDEN * (self.end - self.start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    if lower:
        data = np.frombuffer(data.tobytes().translate(LOWER.tobytes()), dtype=np.uint8)
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = np.frombuffer(data.tobytes().translate(_WORD.tobytes()), dtype=bool)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    starts[borders] = inside[borders]
    start = np.flatnonzero(starts)
    stops = np.zeros(len(data) + 1, dtype=bool)
    stops[1:] = inside[:-1] & ~inside[1:]
    stops[borders] |= inside[borders - 1]
    end = np.flatnonzero(stops)
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, start, end, row, first)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles: (row, hash), in order of row and hash.

    A row with fewer than k words, but at least one, has its whole sequence as one shingle.
    """
    h, counts = w.hashes(), w.counts
    n = len(h)
    total = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        total = total * _SHINGLE + h[j : j + len(total)]
    whole = w.row[: len(total)] == w.row[k - 1 :] if len(total) else np.zeros(0, dtype=bool)
    rows, values = [w.row[: len(total)][whole]], [mix(total[whole])]
    short = np.flatnonzero((counts > 0) & (counts < k))
    for size in range(1, k):
        own = short[counts[short] == size]
        part = np.full(len(own), size, dtype=np.uint64)
        for j in range(size):
            part = part * _SHINGLE + h[w.first[own] + j]
        rows.append(own)
        values.append(mix(part ^ _GOLDEN))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]


def binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive byte ranges of `data` as a binary column."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return column.cast(pa.binary())
