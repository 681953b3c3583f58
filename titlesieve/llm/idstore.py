"""Ids of recurring pieces of text, remembered by hash in flat arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

from titlesieve.llm.textscan import equal_spans, ragged

#: Pieces remembered before starting anew, where not said otherwise: about 70 bytes each.
MOST_PIECES = 1_000_000
#: Bytes of remembered pieces before starting anew.
MOST_BYTES = 64 << 20
#: Pieces encoded in one call; their encodings are large until they are copied.
AT_ONCE = 8_192


def _flat(coded: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, coded), np.int64, len(coded))
    return np.fromiter(chain.from_iterable(coded), np.uint32, int(size.sum())), size


class IdStore:
    """Looks pieces up by 64-bit hash and bytes, and encodes those it has not seen.

    ``encode`` turns a list of texts into a list of id lists, or into all ids, one after
    the other, and the number of each. The hash only says where to
    look: texts can be made that share it, so the bytes of a piece are kept and compared.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], Sequence[Sequence[int]] | tuple[np.ndarray, np.ndarray]],
        most: int | None = None,
    ) -> None:
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.again = np.zeros(0, bool)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.raw = np.zeros(1 << 18, np.uint8)
        self.raw_at = np.zeros(0, np.int64)
        self.raw_size = np.zeros(0, np.int64)
        self.raw_used = 0

    def find(
        self,
        hashes: np.ndarray,
        spell: Callable[[int], str],
        spans: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
    ) -> np.ndarray:
        """Places of the distinct, ascending ``hashes``; ``spell(i)`` is the text of i.

        ``spans`` are the bytes that the texts are in, and where each begins and ends. The
        place is -1 where another text of the same hash is remembered.
        """
        if len(self.keys) > (self.most or MOST_PIECES) or self.raw_used > MOST_BYTES:
            self._forget()
        place = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if spans is None:
            spans = self._spelt(spell, len(hashes))
        data, begin, end = spans
        other = np.zeros(len(hashes), bool)
        old = np.flatnonzero(known)
        at, size = self.raw_at[place[old]], end[old] - begin[old]
        same = self.raw_size[place[old]] == size
        same[same] = equal_spans(data, begin[old][same], self.raw, at[same], size[same])
        other[old[~same]] = True
        self.again[place[old]] = True
        if len(new):
            sizes = []
            for first in range(0, len(new), AT_ONCE):
                coded = self.encode([spell(i) for i in new[first : first + AT_ONCE].tolist()])
                ids, size = coded if isinstance(coded, tuple) else _flat(coded)
                sizes.append(size)
                total = len(ids)
                while self.used + total > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
                self.flat[self.used : self.used + total] = ids
                self.used += total
            size = np.concatenate(sizes)
            at = self.used - int(size.sum()) + np.cumsum(size) - size
            where = place[new]
            self._remember(data, begin[new], end[new], where)
            self.keys = np.insert(self.keys, where, hashes[new])
            self.again = np.insert(self.again, where, False)
            self.at = np.insert(self.at, where, at)
            self.size = np.insert(self.size, where, size)
            place = np.searchsorted(self.keys, hashes)
        place[other] = -1
        return place

    def _forget(self) -> None:
        """Keep the pieces that were looked up again since the last time, if they are few."""
        some = np.flatnonzero(self.again)
        keys, size, raw_size = self.keys[some], self.size[some], self.raw_size[some]
        few = 2 * len(some) <= (self.most or MOST_PIECES) and 2 * int(raw_size.sum()) <= MOST_BYTES
        flat, raw = self.flat[ragged(self.at[some], size)], self.raw[ragged(self.raw_at[some], raw_size)]
        self.clear()
        if few and len(some):
            self.keys, self.size, self.raw_size = keys, size, raw_size
            self.again = np.zeros(len(some), bool)
            self.at, self.raw_at = np.cumsum(size) - size, np.cumsum(raw_size) - raw_size
            self.flat, self.used, self.raw, self.raw_used = flat, len(flat), raw, len(raw)

    @staticmethod
    def _spelt(spell: Callable[[int], str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = [spell(i).encode() for i in range(n)]
        end = np.cumsum([len(text) for text in texts], dtype=np.int64)
        begin = np.concatenate([[0], end[:-1]]).astype(np.int64) if n else end
        return np.frombuffer(b"".join(texts), np.uint8), begin, end

    def _remember(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, where: np.ndarray) -> None:
        size = end - begin
        total = int(size.sum())
        while self.raw_used + total > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        self.raw[self.raw_used : self.raw_used + total] = data[ragged(begin, size)]
        self.raw_at = np.insert(self.raw_at, where, self.raw_used + np.cumsum(size) - size)
        self.raw_size = np.insert(self.raw_size, where, size)
        self.raw_used += total

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces at ``places``, one after the other, and the number of each."""
        size = self.size[places]
        return self.flat[ragged(self.at[places], size)], size
