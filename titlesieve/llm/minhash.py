"""MinHash near-duplicates of whole documents: SuperMinHash, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titlesieve.llm.batches import add_columns, apart, kept, map_batches
from titlesieve.llm.components import components
from titlesieve.llm.lookup import rows_of
from titlesieve.llm.textscan import (
    BLANKS,
    LOWER,
    SLICE_BYTES,
    long_column,
    mix,
    prefix_hash,
    ragged,
    span_hash,
    text_slices,
)
from titlesieve.operators.positions import with_positions
from titlesieve.sources.storage import materialise

SHINGLE_WORDS = 5
#: Links have 100 * intersection >= 75 * union.
THRESHOLD = 75
BANDS, BAND_SLOTS = 24, 3
SLOTS = BANDS * BAND_SLOTS
#: Slots that must agree for a pair to be verified. A pair at the threshold agrees in 54
#: of 72 on average and in fewer than 34 with a probability below 1e-7.
LEAST_EQUAL_SLOTS = 34
#: Open buckets up to this size are compared by a join; larger ones in blocks.
SMALL, BLOCK = 32, 256
#: Members of an open bucket that a round compares with the others.
PIVOTS = 8
#: Pairs between components, for each class, from which such rounds are worth their jobs;
#: fewer are looked at faster in blocks.
PAIRS_PER_CLASS = 1_000
#: Word digests that a Python worker remembers.
MOST_WORDS = 50_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Digests(dict):
    """Words and their 128-bit digests; those met last are remembered."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MOST_WORDS:
            self.clear()
        found = self[word] = blake2b(word, digest_size=16).digest()
        return found


def word_digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each word (word x 2), and rows' bounds.

    Words stand between blanks, A-Z counts as lower case. Texts can be made whose 64-bit
    sums are equal, but not such words: the digests are cryptographic.
    """
    digest = kept("word-digests", _Digests).__getitem__
    raw = LOWER[data].tobytes()
    found, counts = [], []
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        n = 0
        while begin < end:
            stop = end
            if end - begin > 2 * SLICE_BYTES:  # on to the next blank
                rest = np.flatnonzero(BLANKS[data[begin + SLICE_BYTES : end]])
                stop = begin + SLICE_BYTES + int(rest[0]) if len(rest) else end
            words = raw[begin:stop].split()
            n += len(words)
            found.append(b"".join(map(digest, words)))
            begin = stop
        counts.append(n)
    lanes = np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)
    return lanes, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS):
    """Sorted distinct 128-bit shingles of each row (shingle x 2), and rows' bounds."""
    lanes, bounds = word_digests(data, offsets)
    counts = np.diff(bounds)
    number = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    start = ragged(bounds[:-1], number)
    row = np.repeat(np.arange(len(counts)), number)
    width = np.minimum(size, counts)[row]
    shingles = mix(lanes[start] + width[:, None].astype(np.uint64))
    for k in range(1, size):
        at = np.flatnonzero(width > k)
        shingles[at] = mix(shingles[at] * _STEP + lanes[start[at] + k])
    order = np.lexsort((shingles[:, 1], shingles[:, 0], row))
    shingles, row = shingles[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (shingles[1:] != shingles[:-1]).any(axis=1) | (row[1:] != row[:-1])
    shingles, row = shingles[new], row[new]
    return shingles, np.searchsorted(row, np.arange(len(counts) + 1))


def super_minhash(hashes: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The SuperMinHash signature of each row's set (row x slot).

    Each element has its own random permutation of the slots, and in round j offers its
    j-th slot the number j + r, 0 <= r < 1. Rounds go over all elements of the batch. A
    row is finished when all its slots are below the next round's numbers, which large
    sets are after the first or second.
    """
    rows = len(bounds) - 1
    empty = np.uint64(np.iinfo(np.uint64).max)
    signature = np.full((rows, slots), empty, np.uint64)
    flat = signature.reshape(-1)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    element, order = hashes, None
    for j in range(slots):
        if not len(element):
            break
        draw = mix(element + np.uint64((j + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        swap = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if order is None:
            slot = swap
        else:
            lines = np.arange(len(element))
            slot = order[lines, swap].astype(np.int64)
            order[lines, swap] = order[lines, j]
        np.minimum.at(flat, row * slots + slot, np.uint64(j) << np.uint64(32) | draw >> np.uint64(32))
        open_rows = (signature >= np.uint64(j + 1) << np.uint64(32)).any(axis=1)
        going = open_rows[row]
        if order is None:
            first = swap[going]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(first), 1))
            order[np.arange(len(first)), first] = 0
        else:
            order = order[going]
        element, row = element[going], row[going]
    return signature


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, after, data, offsets in text_slices(batch.column(1)):
            hashes, bounds = shingle_sets(data, offsets)
            signature = super_minhash(np.ascontiguousarray(hashes[:, 0]), bounds)
            band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (after - first, BANDS))
            for k in range(BAND_SLOTS):
                band = mix(band * _STEP + signature[:, k::BAND_SLOTS])
            a, b = set_digests(hashes, bounds)
            rows = after - first
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, rows), pa.array(np.diff(bounds)),
                    long_column(a), long_column(b),
                    pa.array([s.tobytes() for s in (signature & np.uint64(0xFF)).astype(np.uint8)], pa.binary()),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS), long_column(band.ravel())
                    ),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "slots", "bands"],
            )


def set_digests(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit digest of each row's set from either half of its shingles."""
    out = []
    for lane in (0, 1):
        out.append(span_hash(prefix_hash(mix(hashes[:, lane] + _STEP)), bounds[:-1], bounds[1:]))
    return out[0], out[1]


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Shingles that two sets share: the fewer of those equal in either half."""
    both = []
    for lane in (0, 1):
        merged = np.concatenate([x[:, lane], y[:, lane]])
        merged.sort(kind="stable")
        both.append(int(np.count_nonzero(merged[1:] == merged[:-1])))
    return min(both)


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, after, data, offsets in text_slices(batch.column(1)):
            hashes, bounds = shingle_sets(data, offsets)
            a, b = set_digests(hashes, bounds)
            sets = [hashes[i:j].tobytes() for i, j in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, after - first), long_column(a), long_column(b),
                 pa.array(sets, pa.binary())],
                names=["first_id", "d1", "d2", "shingles"],
            )


def _set(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.uint64).reshape(-1, 2)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = _set(x), _set(y)
            if 100 * min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
                continue
            both = _common(x, y)
            keep[i] = 100 * both >= THRESHOLD * (len(x) + len(y) - both)
        at = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"]
        )


def _sets_of(docs: DataFrame, classes: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, shingles) of the classes in ``reps``, computed from their texts and stored."""
    wanted = materialise(
        classes.join(reps, "rep", "left_semi").select("rep", "first_id", "d1", "d2"), "wanted"
    )
    texts = rows_of(
        docs.select(F.col("doc_id").alias("first_id"), "text"), wanted.select("first_id"), "first_id"
    )
    sets = (
        texts.transform(map_batches, _shingles, "first_id long, d1 long, d2 long, shingles binary")
        .join(wanted, ["first_id", "d1", "d2"])
        .dropDuplicates(["rep"])
        .select("rep", "shingles")
    )
    return materialise(sets, "shingles")


def _verify(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough, stored."""
    first = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y")
    return materialise(joined.transform(map_batches, _similar, "a long, b long"), "verified")


def _equal_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose signatures agree in enough slots; their slots are columns 2 and 3."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8) for k in (2, 3))
        equal = (x == y).reshape(-1, SLOTS).sum(axis=1)
        at = pa.array(np.flatnonzero(equal >= LEAST_EQUAL_SLOTS))
        yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in (0, 1)], names=["a", "b"])


def _block_links(table: pa.Table) -> pa.Table:
    """Links of one pair of blocks of a bucket between different components.

    A pair that shares several buckets is looked at in that of its first common band only.
    """
    rep, found, side = (table[c].to_numpy() for c in ("rep", "component", "block"))
    bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    earlier = np.arange(BANDS) < np.flatnonzero(bands[0] == table["bucket"][0].as_py())[0]
    slots = np.frombuffer(b"".join(table["slots"].to_pylist()), np.uint8).reshape(-1, SLOTS)
    sets = [_set(x) for x in table["shingles"].combine_chunks()]
    size = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    by = np.lexsort((every[:, 1], every[:, 0]))
    other = np.zeros(len(by), np.int64)
    other[1:] = (every[by][1:] != every[by][:-1]).any(axis=1)
    number = np.empty(len(by), np.int64)
    number[by] = np.cumsum(other)
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
    ends = np.concatenate([[0], np.cumsum(size)])
    # Members of the right block by the shingles they hold.
    row = np.repeat(np.arange(len(sets)), size)
    in_right = np.isin(row, right)
    order = np.argsort(number[in_right], kind="stable")
    holders = row[in_right][order]
    first = np.searchsorted(number[in_right][order], np.arange(number.max(initial=0) + 2))
    a, b = [], []
    for i in left:
        js = right[rep[right] > rep[i]] if low == high else right
        js = js[found[js] != found[i]]
        js = js[100 * np.minimum(size[js], size[i]) >= THRESHOLD * np.maximum(size[js], size[i])]
        js = js[~(bands[js][:, earlier] == bands[i][earlier]).any(axis=1)]
        js = js[(slots[js] == slots[i]).sum(axis=1) >= LEAST_EQUAL_SLOTS]
        if len(js):
            own = number[ends[i] : ends[i + 1]]
            at = ragged(first[own], first[own + 1] - first[own])
            both = np.bincount(holders[at], minlength=len(sets))[js]
            js = js[100 * both >= THRESHOLD * (size[js] + size[i] - both)]
            a.append(np.minimum(rep[i], rep[js]))
            b.append(np.maximum(rep[i], rep[js]))
    empty = np.zeros(0, np.int64)
    return pa.table({"a": np.concatenate([empty, *a]), "b": np.concatenate([empty, *b])})


def _numbered(classes: DataFrame) -> DataFrame:
    """``classes`` with ``rep``, a number of their own in the order of ``first_id``.

    It is ``first_id`` itself, unless an id has several texts that are first of their class.
    """
    if classes.groupBy("first_id").count().where("count > 1").isEmpty():
        return classes.withColumn("rep", F.col("first_id"))
    return materialise(with_positions(classes, "first_id", "d1", "d2", name="rep"), "numbered")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Words are what stands between ASCII blanks, with A-Z in lower case. A document's set
    has its distinct shingles of five words; a shorter text is one shingle as a whole; a
    null text or one without words has the empty set and is linked with nothing. Two
    documents are linked if 100 * |intersection| >= 75 * |union|. ``component_id`` is the
    smallest doc_id that links lead to, ``kept`` marks that document. Rows that repeat an
    id and have equal sets are one document to links, with a row each; texts of other sets
    are documents of their own, of which one is kept if links lead from one to the other.
    A null id is linked with nothing and kept. Other columns are ignored; an empty table gives no rows.

    Documents of equal sets become one class, so copies cost one row each. The bands of
    each class's SuperMinHash signature are its buckets. Every member of a bucket is
    verified against the bucket's smallest class: one pair per row, however large the
    bucket. Buckets that then are not one component get more rounds of PIVOTS members
    each, compared with the members of other components only. Rounds go on while the
    pairs left between components are many times the classes and each round halves them. What
    is then left is compared in full: small buckets by a join, larger ones in blocks of
    bounded size inside tasks, which give links only; a member is shuffled once for each
    block of its bucket there. All links are verified on the full sets of 128-bit shingles.

    The stages run when this function is called; each is stored under the checkpoint
    folder.
    """
    return _near(docs).drop("d1", "d2")


def _near(docs: DataFrame) -> DataFrame:
    """:func:`near_duplicates` with the digests d1 and d2 of each row's set."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(
        ids.transform(
            map_batches,
            _sign,
            "doc_id long, n_shingles long, d1 long, d2 long, slots binary, bands array<long>",
        ),
        "signatures",
    )
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(
        full.groupBy("d1", "d2").agg(
            F.min("doc_id").alias("first_id"), F.first("slots").alias("slots"), F.first("bands").alias("bands")
        ),
        "classes",
    )
    classes = _numbered(classes)
    banded = classes.select(F.explode("bands").alias("bucket"), "rep")
    heads = banded.groupBy("bucket").agg(F.min("rep").alias("head"), F.count("*").alias("members"))
    members = materialise(banded.join(heads.where("members > 1"), "bucket"), "buckets")
    slots = classes.select("rep", "slots")

    def checked(pairs: DataFrame, label: str) -> DataFrame:
        with_slots = pairs.join(slots.toDF("a", "x"), "a").join(slots.toDF("b", "y"), "b")
        near = with_slots.select("a", "b", "x", "y").transform(map_batches, _equal_slots, "a long, b long")
        return materialise(near, label)

    sets = _sets_of(ids, classes, members.select("rep").distinct())
    n_classes = classes.count()
    stars = members.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b"))
    links = _verify(sets, checked(stars.distinct(), "stars"))
    left, turn = float("inf"), 0
    while True:
        turn += 1
        found = materialise(components(links), "components")
        placed = members.join(found.toDF("rep", "component"), "rep", "left").select(
            "bucket", "rep", "members", F.coalesce("component", "rep").alias("component")
        )
        # Buckets of several components, with the pairs between these.
        inside = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        between = (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2
        open_ = inside.groupBy("bucket").agg(between.alias("pairs")).where("pairs > 0")
        open_ = materialise(open_, "open-buckets")
        before, left = left, open_.agg(F.sum("pairs")).head()[0] or 0
        if left <= PAIRS_PER_CLASS * n_classes or 2 * left > before:
            break
        rest = placed.join(open_.select("bucket"), "bucket", "left_semi")
        order = Window.partitionBy("bucket").orderBy(F.xxhash64("rep", F.lit(turn)), "rep")
        pivots = rest.withColumn("k", F.row_number().over(order)).where(F.col("k") <= PIVOTS)
        pivots = pivots.select("bucket", F.col("rep").alias("pivot"), F.col("component").alias("own"))
        pairs = rest.join(pivots, "bucket").where("component <> own").select(
            F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")
        )
        links = links.unionByName(_verify(sets, checked(pairs.distinct(), "pivot-pairs")))
    if left:
        rest = materialise(placed.join(open_.select("bucket"), "bucket", "left_semi"), "open-members")
        one, other = (
            rest.where(F.col("members") <= SMALL).select("bucket", F.col("rep").alias(r), F.col("component").alias(c))
            for r, c in (("a", "ca"), ("b", "cb"))
        )
        small = one.join(other, "bucket").where("a < b and ca <> cb").select("a", "b")
        more = _verify(sets, checked(small.distinct(), "open-pairs"))
        blocks = F.ceil(F.col("members") / BLOCK).cast("int")
        large = rest.where(F.col("members") > SMALL).select(
            "*", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block")
        )
        with_sets = large.join(classes.select("rep", "slots", "bands"), "rep").join(sets, "rep")
        dealt = with_sets.withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        ).select(
            "bucket", "rep", "component", "slots", "bands", "shingles", "block",
            F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        )
        in_blocks = dealt.groupBy("bucket", "low", "high").applyInArrow(_block_links, "a long, b long")
        links = links.unionByName(more).unionByName(materialise(in_blocks, "block-links"))
        found = materialise(components(links), "components")

    roots = found.toDF("rep", "component").join(
        classes.select(F.col("rep").alias("component"), F.col("first_id").alias("name")), "component"
    )
    by_digest = classes.join(roots, "rep", "left").select(
        "d1", "d2", "first_id", F.coalesce("name", "first_id").alias("name"),
        F.coalesce(F.col("component") == F.col("rep"), F.lit(True)).alias("root"),
    )
    # One row per class on the right; a digest with many copies can be split on the left.
    joined = signed.select("doc_id", "n_shingles", "d1", "d2").join(by_digest, ["d1", "d2"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.coalesce("name", "doc_id")).otherwise(F.col("doc_id"))
    first = F.col("root") & (F.col("doc_id") == F.col("first_id"))
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.when(linked, F.coalesce(first, F.lit(True))).otherwise(F.lit(True)).alias("kept"),
        "d1",
        "d2",
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of :func:`near_duplicates`.

    The smallest id of each stays, with all its columns. Rows that share an id stay or go
    each by its own text; of those with equal texts one stays. Rows with a null id all stay.
    Columns of any name may be there.
    """
    return apart(docs, ("doc_id", "text"), _drop_near_duplicates)


def _drop_near_duplicates(docs: DataFrame) -> DataFrame:
    found = materialise(_near(docs), "near-duplicates")
    gone = materialise(found.where("not kept").select("doc_id", "d1", "d2").distinct(), "gone")
    often = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    repeated = materialise(often.select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return rows_of(docs, gone.select("doc_id"), "doc_id", "left_anti")
    once = rows_of(docs, repeated, "doc_id", "left_anti")
    once = rows_of(once, gone.select("doc_id"), "doc_id", "left_anti")
    at = docs.columns.index("text")

    def digests(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = [
            set_digests(*shingle_sets(data, offsets))
            for _, _, data, offsets in text_slices(batch.column(at))
        ]
        return [long_column(np.concatenate(x)) for x in zip(*sets)]

    fields = [("__d1", T.LongType()), ("__d2", T.LongType())]
    several = add_columns(rows_of(docs, repeated, "doc_id"), fields, digests)
    gone = gone.toDF("__id", "__d1", "__d2")
    same = (several["doc_id"] == gone["__id"]) & (several["__d1"] == gone["__d1"]) & (several["__d2"] == gone["__d2"])
    several = several.join(gone, same, "left_anti").dropDuplicates(["doc_id", "text"])
    return once.unionByName(several.drop("__d1", "__d2"))
