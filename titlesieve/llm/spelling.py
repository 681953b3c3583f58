"""Spelling variants: edits of words probed against Bloom filters, hits joined exactly.

Words are counted over all documents. Each word of the vocabulary generates the words one
edit away, as hashes only, and probes them against blocked Bloom filters, one for each
length, that every task gets. Only what the filters let through becomes text and is
shuffled to an exact join with the vocabulary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlesieve.llm.textscan import LOWER, SLICE_BYTES, mix
from titlesieve.sources.storage import materialise

LEAST_LENGTH, LEAST_COUNT, FORM_RATIO, TYPO_MODULUS = 7, 2, 10, 31
#: Lengths from this on share one filter.
LAST_SHARD = 40
#: Filter bits for each word, and bytes of all filters that are broadcast at once. A larger
#: vocabulary is probed in several passes, each against the words of a share of the hashes.
BITS, FILTER_BYTES = 32, 16 << 20
#: Candidates that are hashed at a time, and different words counted before handing on.
CANDIDATES, COUNTED = 1 << 21, 200_000
MOST_ROUNDS = 64

#: Words are runs of these, one byte each in Latin-1; everything else parts them.
_PART = np.full(256, 0x20, np.uint8)
_PART[97:123] = np.arange(97, 123)
_PART[65:91] = LOWER[65:91]
_PART[0xC0:] = np.arange(0xC0, 256)
_RUNS = _PART.tobytes()

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _typo(prefix: int, run: bytes) -> bytes:
    """The run, or without one of its code points where the modulus divides its CRC."""
    utf8 = run if run.isascii() else run.decode("latin-1").encode()
    h = crc32(utf8, prefix)
    at = h % len(run)
    return run if h % TYPO_MODULUS else run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the long words of rows (doc_id as text, text), some counted together."""

    def out(found: Counter) -> pa.RecordBatch:
        words = [word.decode("latin-1") for word in found]
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(found.values(), pa.int64())],
            names=["word", "n"],
        )

    found: Counter = Counter()
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        for doc_id, text in zip(batch.column(0).to_pylist(), texts):
            prefix = crc32(f"{doc_id}:".encode())
            for run, n in _runs(text.as_py()):
                word = _typo(prefix, run)
                if len(word) >= LEAST_LENGTH:
                    found[word] += n
            if len(found) >= COUNTED:
                yield out(found)
                found = Counter()
    if found:
        yield out(found)


def _runs(text: str) -> Iterator[tuple[bytes, int]]:
    """Long runs of a whole text, counted about 1 MB at a time."""
    plain = text.encode("latin-1", "replace").translate(_RUNS)
    at = 0
    while at < len(plain):
        stop = at + SLICE_BYTES
        if stop < len(plain):  # a run longer than a slice is kept whole
            stop = (plain.find(b" ", stop) + 1) or len(plain)
        for run, n in Counter(plain[at:stop].split()).items():
            if len(run) >= LEAST_LENGTH:
                yield run, n
        at = stop


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of at least LEAST_LENGTH code points that occur often enough."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    counts = rows.mapInArrow(_counted, "word string, n long").groupBy("word")
    return counts.agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Filters(NamedTuple):
    """Blocked Bloom filters of 64-bit blocks, one after the other."""

    first: np.ndarray  # block at which the filter of a shard begins
    blocks: np.ndarray  # number of blocks of each, a power of two
    bits: np.ndarray

    def has(self, shard: int, hashes: np.ndarray) -> np.ndarray:
        """Whether the filter of a shard lets hashes through."""
        block, mask = _place(hashes, int(self.blocks[shard]))
        return self.bits[int(self.first[shard]) + block] & mask == mask


def _place(hashes: np.ndarray, blocks) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and its five bits there."""
    block = (hashes >> np.uint64(32)).astype(np.int64) & (blocks - 1)
    mask = np.zeros(len(hashes), np.uint64)
    for k in range(5):
        mask |= np.uint64(1) << ((hashes >> np.uint64(6 * k)) & np.uint64(63))
    return block, mask


class _Words(NamedTuple):
    """Words of one length: a row of codes each, and their sums of hashes."""

    codes: np.ndarray  # word x place
    before: np.ndarray  # word x (place + 1): sum of codes * base ** place before a place
    power: np.ndarray


def _words(words: list[bytes]) -> _Words:
    length = len(words[0])
    codes = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, _BASE)]))
    before = np.zeros((len(words), length + 1), np.uint64)
    np.cumsum(_CODES[codes] * power[:length], axis=1, out=before[:, 1:])
    return _Words(codes, before, power)


def _finish(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + np.uint64(length))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of words of one length."""
    steps = max(CANDIDATES // len(words[0]), 1)
    sums = [_words(words[at : at + steps]).before[:, -1] for at in range(0, len(words), steps)]
    return _finish(np.concatenate(sums), len(words[0]))


def _by_length(words: list[bytes]) -> Iterator[list[bytes]]:
    by: dict[int, list[bytes]] = {}
    for word in words:
        by.setdefault(len(word), []).append(word)
    yield from by.values()


def _shard(length: int) -> int:
    return min(length, LAST_SHARD)


def _filters(words: DataFrame, sizes: dict[int, int], passes: int, number: int) -> Filters:
    """The filters of the words whose hash belongs to a pass; the driver gets their blocks.

    There are at most FILTER_BYTES / 8 blocks, whatever the number of words.
    """
    blocks = np.ones(LAST_SHARD + 1, np.int64)
    for shard, n in sizes.items():
        need = max(n * BITS // (64 * passes), 16)
        blocks[shard] = 1 << int(need - 1).bit_length()
    first = np.cumsum(blocks) - blocks

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _by_length(_latin(batch.column(0))):
                hashes = word_hashes(own)
                hashes = hashes[_pass(hashes, passes) == number]
                shard = _shard(len(own[0]))
                block, mask = _place(hashes, int(blocks[shard]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block + first[shard]), pa.array(mask.view(np.int64))],
                    names=["block", "mask"],
                )

    filled = (
        words.select("word")
        .mapInArrow(fill, "block long, mask long")
        .groupBy("block")
        .agg(F.bit_or("mask").alias("mask"))
        .toArrow()
    )
    bits = np.zeros(int(blocks.sum()), np.uint64)
    bits[filled["block"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
    return Filters(first, blocks, bits)


def _pass(hashes: np.ndarray, passes: int) -> np.ndarray:
    return (hashes >> np.uint64(40)) % np.uint64(passes)


def _latin(column: pa.Array) -> list[bytes]:
    return [word.encode("latin-1") for word in column.to_pylist()]


def edits(words: list[bytes], alphabet: np.ndarray, filters: Filters, passes: int, number: int):
    """(row, neighbour) of what the filters let through, for words of one length.

    Neighbours are the words with one code point deleted, and those with one replaced by a
    larger one of the alphabet. The other half of the edits are those of the neighbours.
    """
    length = len(words[0])
    steps = max(CANDIDATES // (length * (len(alphabet) + 1)), 1)
    for at in range(0, len(words), steps):
        some = words[at : at + steps]
        own = _words(some)
        # A very long word is hashed some places at a time.
        width = max(CANDIDATES // (len(some) * (len(alphabet) + 1)), 1)
        for left in range(0, length, width):
            span = np.arange(left, min(left + width, length))
            for row, near in _some_edits(some, own, span, alphabet, filters, passes, number):
                yield at + row, near


def _some_edits(words, own: _Words, span: np.ndarray, alphabet, filters, passes, number):
    length, first = own.codes.shape[1], int(span[0])
    total = own.before[:, -1:]
    # Deleted: what follows moves one place down.
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    after = (total - own.before[:, span + 1]) * inverse
    hashes = _finish((own.before[:, span] + after).ravel(), length - 1)
    hit = filters.has(_shard(length - 1), hashes) & (_pass(hashes, passes) == number)
    for flat in np.flatnonzero(hit):
        row, place = int(flat) // len(span), first + int(flat) % len(span)
        word = words[row]
        if place == 0 or word[place] != word[place - 1]:  # else the same word as before
            yield row, word[:place] + word[place + 1 :]
    # Replaced: the difference of two codes at a place.
    now = own.codes[:, span]
    plain = total - _CODES[now] * own.power[span]
    hashes = plain[:, :, None] + _CODES[alphabet] * own.power[span][:, None]
    hashes = _finish(hashes.ravel(), length)
    hit = filters.has(_shard(length), hashes) & (_pass(hashes, passes) == number)
    hit &= (now[:, :, None] < alphabet).ravel()
    for flat in np.flatnonzero(hit):
        row, rest = divmod(int(flat), len(span) * len(alphabet))
        place, code = divmod(rest, len(alphabet))
        word, place = words[row], first + place
        yield row, word[:place] + bytes([alphabet[code]]) + word[place + 1 :]


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: each pair of stored ``words`` (word, n) one edit apart, both ways.

    A word has at most 89 * (2 * length + 1) + length near words, so no group of words
    makes pairs without bound. Filters may let other words through; the join drops them.
    """
    length = F.length("word")
    sizes = {
        r["shard"]: r["n"]
        for r in words.groupBy(F.least(length, F.lit(LAST_SHARD)).alias("shard"))
        .agg(F.count("*").alias("n"))
        .collect()
    }
    codes = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c"))
    found = [r["c"].encode("latin-1")[0] for r in codes.where("c <> ''").distinct().collect()]
    alphabet = np.array(sorted(found), np.uint8)
    passes = max(-(-sum(sizes.values()) * BITS // 8 * 2 // FILTER_BYTES), 1)
    pairs = None
    for number in range(passes):
        hits = _hits(words, alphabet, _filters(words, sizes, passes, number), passes, number)
        pairs = hits if pairs is None else pairs.unionByName(hits)
    exact = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    found_pairs = materialise(
        pairs.join(exact, "near").select("word", "n", "near", "near_n"), "near-words"
    )
    back = found_pairs.select(
        F.col("near").alias("word"),
        F.col("near_n").alias("n"),
        F.col("word").alias("near"),
        F.col("n").alias("near_n"),
    )
    return found_pairs.unionByName(back)


def _hits(words: DataFrame, alphabet, filters: Filters, passes: int, number: int) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast(filters)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = dict(zip(_latin(batch.column(0)), batch.column(1).to_pylist()))
            for own in _by_length(list(counts)):
                out: list[tuple] = []
                for row, near in edits(own, alphabet, shared.value, passes, number):
                    out.append((own[row].decode("latin-1"), counts[own[row]], near.decode("latin-1")))
                    if len(out) >= 10_000 or len(out) * len(near) > SLICE_BYTES:
                        yield _pairs(out)
                        out = []
                if out:
                    yield _pairs(out)

    return words.select("word", "n").mapInArrow(probe, "word string, n long, near string")


def _pairs(out: list[tuple]) -> pa.RecordBatch:
    word, n, near = zip(*out)
    return pa.RecordBatch.from_arrays(
        [pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(near, pa.string())],
        names=["word", "n", "near"],
    )


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: the vocabulary of ``docs`` (doc_id, text).

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z in lower case, one code point deleted
    where the CRC of ``doc_id:run`` says so; a null text has none, a null id is empty
    text. ``form`` is the near word (one code point inserted, deleted or replaced) of the
    largest count, the first in code-point order of equal ones, if that is at least
    FORM_RATIO times the word's own, else null. ``root`` follows forms to the last.
    Repeated rows count again, other columns are ignored, an empty table gives none.
    """
    words = materialise(vocabulary(docs), "vocabulary")
    best = (
        near_words(words)
        .groupBy("word")
        .agg(
            F.count("*").alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"),
        )
        .select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    )
    good = F.col("near_n") >= FORM_RATIO * F.col("n")
    formed = materialise(
        words.join(best, "word", "left").select(
            "word",
            F.when(good, F.col("near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(good, F.col("near_n")).alias("form_n"),
        ),
        "word-forms",
    )
    roots = _roots(formed.where(F.col("form").isNotNull()).select("word", "form"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to the last, twice as far in each round.

    Counts grow tenfold with each form, so there are no circles and few rounds.
    """
    current = materialise(forms.select("word", F.col("form").alias("root")), "word-roots")
    for _ in range(MOST_ROUNDS):
        further = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = current.join(further, "root", "left")
        moved = materialise(
            joined.select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("far")
            ),
            "word-roots",
        )
        current = moved.select("word", "root")
        if moved.where("far").isEmpty():
            return current
    raise RuntimeError("forms did not end")
