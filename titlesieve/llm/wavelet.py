"""Wavelet matrices of token ids in one self-contained file image.

Bit-plane p holds, for the tokens in the order reached after the planes above it, whether
bit p is set; each plane then moves tokens with 0 before those with 1, stably. With the
number of ones before every 512th bit, any token, the count of a token in a stretch and
the place of its k-th occurrence take one step per plane, from the packed planes.

Layout, little-endian: MAGIC, then as uint64 the tokens, planes and documents, the bytes
of the packed document table; the table (zlib: null flags, int64 ids, int64 token counts);
for each plane from the highest, its number of zeros (uint64), the ones before every
512th bit (uint32) and the packed bits.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"WVMX0001"
_BLOCK = 512


def pack(tokens: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray) -> bytes:
    """The image of the documents' tokens, one after the other."""
    n = len(tokens)
    planes = max(1, int(tokens.max()).bit_length()) if n else 1
    table = zlib.compress(
        np.packbits(nulls).tobytes() + doc_ids.astype("<i8").tobytes() + counts.astype("<i8").tobytes(), 1
    )
    parts = [MAGIC, struct.pack("<4Q", n, planes, len(doc_ids), len(table)), table]
    current = tokens.astype(np.uint16 if planes <= 16 else np.uint32)
    for plane in range(planes - 1, -1, -1):
        ones = (current & (1 << plane)).astype(bool)
        packed = np.packbits(ones)
        parts += [struct.pack("<Q", n - int(np.count_nonzero(ones))), _ranks(packed, n), packed.tobytes()]
        current = np.concatenate([current[~ones], current[ones]])
    return b"".join(parts)


def _ranks(packed: np.ndarray, n: int) -> bytes:
    step = _BLOCK // 8
    padded = np.zeros(-(-max(len(packed), 1) // step) * step, np.uint8)
    padded[: len(packed)] = packed
    per_block = np.bitwise_count(padded).reshape(-1, step).sum(axis=1, dtype=np.uint32)
    return (np.cumsum(per_block, dtype=np.uint32) - per_block).astype("<u4").tobytes()


class WaveletFile:
    """Reads an image; planes stay packed except in :meth:`tokens`."""

    def __init__(self, image: bytes) -> None:
        if image[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet matrix of tokens")
        self.n, self.planes, docs, packed = struct.unpack_from("<4Q", image, len(MAGIC))
        at = len(MAGIC) + 32
        table = zlib.decompress(image[at : at + packed])
        at += packed
        flags = -(-docs // 8)
        self.nulls = np.unpackbits(np.frombuffer(table, np.uint8, flags))[:docs].astype(bool)
        self.doc_ids = np.frombuffer(table, "<i8", docs, flags)
        self.counts = np.frombuffer(table, "<i8", docs, flags + 8 * docs)
        self._zeros, self._rank, self._bits = [], [], []
        size = -(-self.n // 8)
        blocks = -(-max(size, 1) // (_BLOCK // 8))
        for _ in range(self.planes):
            self._zeros.append(struct.unpack_from("<Q", image, at)[0])
            self._rank.append(np.frombuffer(image, "<u4", blocks, at + 8))
            self._bits.append(np.frombuffer(image, np.uint8, size, at + 8 + 4 * blocks))
            at += 8 + 4 * blocks + size

    def tokens(self) -> np.ndarray:
        """All tokens in order, from the lowest plane up by undoing the moves."""
        out = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for level in range(self.planes - 1, -1, -1):
            ones = np.unpackbits(self._bits[level], count=self.n).astype(bool)
            zeros, above = self._zeros[level], np.empty_like(out)
            above[~ones] = out[:zeros]
            above[ones] = out[zeros:] | (1 << (self.planes - 1 - level))
            out = above
        return out

    def _ones_before(self, level: int, i: int) -> int:
        """Set bits of a plane before place i."""
        block = i // _BLOCK
        if block >= len(self._rank[level]):
            return self.n - self._zeros[level]
        head = self._bits[level][block * (_BLOCK // 8) : -(-i // 8)]
        bits = np.unpackbits(head, count=i - block * _BLOCK) if i > block * _BLOCK else head[:0]
        return int(self._rank[level][block]) + int(np.count_nonzero(bits))

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.planes):
            bit = (int(self._bits[level][i // 8]) >> (7 - i % 8)) & 1
            before = self._ones_before(level, i)
            i = self._zeros[level] + before if bit else i - before
            token = token << 1 | bit
        return token

    def _narrow(self, token: int, first: int, after: int) -> tuple[int, int]:
        for level in range(self.planes):
            a, b = self._ones_before(level, first), self._ones_before(level, after)
            if (token >> (self.planes - 1 - level)) & 1:
                first, after = self._zeros[level] + a, self._zeros[level] + b
            else:
                first, after = first - a, after - b
        return first, after

    def count(self, token: int, first: int = 0, after: int | None = None) -> int:
        """Occurrences of a token at places first <= i < after."""
        if token >> self.planes:
            return 0
        low, high = self._narrow(token, first, self.n if after is None else after)
        return high - low

    def locate(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of a token."""
        low, high = self._narrow(token, 0, self.n) if not token >> self.planes else (0, 0)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for level in range(self.planes - 1, -1, -1):
            if (token >> (self.planes - 1 - level)) & 1:
                i = self._select(level, i - self._zeros[level], ones=True)
            else:
                i = self._select(level, i, ones=False)
        return i

    def _select(self, level: int, k: int, ones: bool) -> int:
        ranks = self._rank[level].astype(np.int64)
        if not ones:
            ranks = np.arange(len(ranks)) * _BLOCK - ranks
        block = int(np.searchsorted(ranks, k, "right")) - 1
        step = _BLOCK // 8
        bits = np.unpackbits(self._bits[level][block * step : (block + 1) * step])
        return block * _BLOCK + int(np.flatnonzero(bits == ones)[k - int(ranks[block])])
