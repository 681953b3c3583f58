"""Vectorised scanning of Arrow text columns: word bounds, word hashes, window hashes.

Hashes are polynomials modulo 2**64 over random byte values, taken from prefix sums and
then mixed, so a batch needs a handful of numpy passes and no Python loop over words.
Equal words have equal hashes in every batch and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text scanned at a time; a longer text is scanned alone.
SLICE_BYTES = 1 << 20

#: Fixed by the contract of word separators: space and 0x09-0x0D.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(
    1, 1 << 63, 256, dtype=np.uint64
)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a base modulo 2**64, kept up to the longest text seen."""

    def __init__(self, base: int) -> None:
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            have = len(self.values)
            step = np.uint64(pow(self.base, have, 1 << 64))
            self.values = np.concatenate([self.values, self.values * step])
        return self.values[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


class Words(NamedTuple):
    """Words of consecutive texts. ``bounds[i]:bounds[i + 1]`` are those of text i."""

    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # first byte of each word
    stop: np.ndarray  # byte after each word
    bounds: np.ndarray
    hash: np.ndarray  # uint64 of each word


def text_slices(
    column: pa.Array, size: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after, bytes, offsets of rows) of pieces of about ``size`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        after = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        after = min(max(after, row + 1), len(column))
        first = offsets[row]
        yield row, after, data[first : offsets[after]], offsets[row : after + 1] - first
        row = after


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * base**i over i < k, for k from 0."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _UP.upto(len(values)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Mixed hashes of the spans start:stop of what ``sums`` was made from."""
    return mix((sums[stop] - sums[start]) * _DOWN.upto(len(sums))[start])


def scan_words(data: np.ndarray, offsets: np.ndarray, hashed: bool = True) -> Words:
    """Words between blanks of the texts in ``data``, whose rows begin at ``offsets``."""
    inside = ~BLANKS[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][(offsets[:-1] < len(data)) & (offsets[:-1] > 0)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = (
        span_hash(prefix_hash(_BYTES[data]), start, stop) if hashed else np.zeros(0, np.uint64)
    )
    return Words(data, start, stop, np.searchsorted(start, offsets), hashes)


def window_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window of ``size`` words inside one text, and its hash."""
    at = window_starts(words.bounds, size)
    return at, span_hash(prefix_hash(words.hash), at, at + size)


def window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Indices at which a window of ``size`` ends inside the same row."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    return ragged(bounds[:-1], counts)


def ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges first[i], first[i] + 1, ... of counts[i] numbers, one after the other."""
    total = int(counts.sum())
    begins = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(first - begins, counts)


#: Bytes compared at a time, and from which on a span is compared alone.
_COMPARED, _LONG_SPAN = 1 << 17, 1 << 14


def equal_spans(
    left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, size: np.ndarray
) -> np.ndarray:
    """Whether the bytes left[a:a + size] and right[b:b + size] are the same, by row."""
    same = np.ones(len(size), bool)
    for i in np.flatnonzero(size > _LONG_SPAN).tolist():
        same[i] = np.array_equal(left[a[i] : a[i] + size[i]], right[b[i] : b[i] + size[i]])
    rows = np.flatnonzero((size > 0) & (size <= _LONG_SPAN) & ~((a == b) & (left is right)))
    ends = np.cumsum(size[rows])
    first = 0
    while first < len(rows):
        done = ends[first - 1] if first else 0
        after = max(int(np.searchsorted(ends, done + _COMPARED, "right")), first + 1)
        some = rows[first:after]
        n = size[some]
        found = left[ragged(a[some], n)] == right[ragged(b[some], n)]
        same[some] = np.logical_and.reduceat(found, np.cumsum(n) - n)
        first = after
    return same


def long_column(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit numbers as the BIGINT with the same bits."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))
