"""Removal of long repeated passages over a de Bruijn graph of token windows.

Every window of 20 words is an edge. Edges that occur in one document only cannot repeat
another's text and are sifted out first, by the gram of smallest hash inside each window
(its minimizer): equal windows have equal minimizers, and there is one for about six or
seven words. What is left is joined by edge with its first document. Places whose neighbour
lies on the same path of the same source are compacted to spans by joining every place with
its successor: places without one on a side are the ends of a span. Each span is then
compared with its source at the source's coordinates. There is no test for branching nodes:
a path ends where the source's path does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titlesieve.functions.names import column
from titlesieve.llm.batches import add_columns, apart, map_batches
from titlesieve.llm.lookup import BROADCAST_IDS, rows_of
from titlesieve.llm.textscan import (
    Words,
    long_column,
    mix,
    prefix_hash,
    ragged,
    scan_words,
    span_hash,
    text_slices,
    window_starts,
)
from titlesieve.sources.storage import materialise

WINDOW = 20
#: Words of a minimizer: longer ones repeat less often without their window, shorter ones
#: are fewer.
GRAM = 9
_CHECK = np.uint64(0x5851F42D4C957F2D)
_NONE = hashlib.sha256(b"").hexdigest()


def _edges(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """First word, hash, check hash, minimizer and its place for every window of the slice."""
    at = window_starts(words.bounds, window)
    edge = span_hash(prefix_hash(words.hash), at, at + window)
    check = span_hash(prefix_hash(mix(words.hash ^ _CHECK)), at, at + window)
    n = len(words.hash)
    gram = np.arange(max(n - GRAM + 1, 0))
    low = span_hash(prefix_hash(words.hash), gram, gram + GRAM)
    # The leftmost minimum over window - GRAM + 1 grams, by doubling stretches.
    def lower(step: int) -> np.ndarray:
        left, right = where[: max(len(where) - step, 0)], where[step:]
        return np.where(low[right] < low[left], right, left)

    where, reach, size = gram, 1, window - GRAM + 1
    while 2 * reach <= size:
        where, reach = lower(reach), 2 * reach
    if size > reach:
        where = lower(size - reach)
    where = where[at]
    return at, edge, (check >> np.uint64(33)).astype(np.int32), low[where], where


def _row_of(at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, at, "right") - 1


def _joined(words: Words, start: int, stop: int, raw: bytes) -> bytes:
    return b" ".join(
        raw[a:b] for a, b in zip(words.start[start:stop].tolist(), words.stop[start:stop].tolist())
    )


def _summarise(window: int):
    """Per document: words, checksum of all words, minimizers.

    ``grams`` are the distinct minimizers, ``own_grams`` those with several places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, after, data, offsets in text_slices(batch.column(1)):
                words = scan_words(data, offsets)
                # A gram counts once for each place it is the minimizer at: a window that
                # repeats in its own document has a gram with two places there.
                at, _, _, low, where = _edges(words, window)
                row = _row_of(at, words.bounds)
                new = np.ones(len(at), bool)
                new[1:] = where[1:] != where[:-1]
                low, row = low[new], row[new]
                order = np.lexsort((low, row))
                low, row = low[order], row[order]
                again = np.zeros(len(low), bool)
                again[1:] = (low[1:] == low[:-1]) & (row[1:] == row[:-1])
                lists = [
                    pa.ListArray.from_arrays(
                        pa.array(np.searchsorted(row[k], np.arange(after - first + 1)).astype(np.int32)),
                        long_column(low[k]),
                    )
                    for k in (~again, again)
                ]
                begin, end = words.bounds[:-1], words.bounds[1:]
                raw = data.tobytes()
                whole = [
                    hashlib.sha256(_joined(words, a, b, raw)).hexdigest()
                    for a, b in zip(begin.tolist(), end.tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, after - first), pa.array(end - begin),
                     pa.array(whole), *lists],
                    names=["doc_id", "n_words", "whole_sha256", "grams", "own_grams"],
                )

    return run


def _edge_digests(words: Words, at: np.ndarray, window: int) -> np.ndarray:
    """SHA-256 of the words of each window."""
    raw = words.data.tobytes()
    found = [hashlib.sha256(_joined(words, a, a + window, raw)).digest() for a in at.tolist()]
    return np.array(found, dtype="V32")


def _own_repeats(edge: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which windows repeat their document; heads and sizes of runs of them, and their sources.

    The source of a window is the last equal one before it; runs go on while it moves along.
    """
    order = np.lexsort((at, edge, row))
    again, source = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
    same = (edge[order[1:]] == edge[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    again[order[1:]] = same
    source[order[1:][same]] = at[order[:-1][same]]
    start, origin, of = at[again], source[again], row[again]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (origin[1:] != origin[:-1] + 1) | (of[1:] != of[:-1])
    heads = np.flatnonzero(new)
    return again, start[heads], np.diff(np.append(heads, len(start))), origin[heads], of[heads]


def _find_edges(window: int, exact: bool = False):
    """Edges of (doc_id, text, grams) whose minimizer is in grams.

    The first of equal edges of a document has ``size`` 1; later ones repeat the document
    itself and come compacted, as starts and sizes of runs, without an edge. Their words are
    compared here. With ``exact`` edges are SHA-256 digests of the words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            repeated = lists.flatten().to_numpy().view(np.uint64)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            for first, after, data, offsets in text_slices(batch.column(1)):
                words = scan_words(data, offsets)
                at, edge, check, low, _ = _edges(words, window)
                row = _row_of(at, words.bounds)
                own = repeated[ends[first] : ends[after]]
                own_row = np.repeat(np.arange(after - first), np.diff(ends[first : after + 1]))
                # A window and a gram meet if they have the same document and hash.
                keep = np.isin(
                    mix(low ^ mix(row.astype(np.uint64))), mix(own ^ mix(own_row.astype(np.uint64)))
                )
                at, edge, check, row = at[keep], edge[keep], check[keep], row[keep]
                if exact:
                    digest = _edge_digests(words, at, window)
                    edge = np.unique(digest, return_inverse=True)[1]
                again, start, sizes, origin, run_row = _own_repeats(edge, at, row)
                raw = data.tobytes()
                if not exact and any(
                    _joined(words, a, a + n + window - 1, raw) != _joined(words, b, b + n + window - 1, raw)
                    for a, b, n in zip(start.tolist(), origin.tolist(), sizes.tolist())
                ):
                    told = np.unique(_edge_digests(words, at, window), return_inverse=True)[1]
                    again, start, sizes, origin, run_row = _own_repeats(told, at, row)
                place, lone = at - words.bounds[row], ~again
                start = start - words.bounds[run_row]
                n_edges, n_runs = int(lone.sum()), len(start)
                if exact:
                    edges = pa.array([d.tobytes() for d in digest[lone]] + [None] * n_runs, pa.binary())
                else:
                    edges = pa.concat_arrays([long_column(edge[lone]), pa.nulls(n_runs, pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [
                        edges,
                        pa.array(np.concatenate([check[lone], np.zeros(n_runs, np.int32)])),
                        pa.array(ids[first:after][np.concatenate([row[lone], run_row])]),
                        pa.array(np.concatenate([place[lone], start]).astype(np.int32)),
                        pa.array(np.concatenate([np.ones(n_edges), sizes]).astype(np.int32)),
                    ],
                    names=["edge", "check", "doc_id", "at", "size"],
                )

    return run


def _span_digests(window: int):
    """(doc_id, at, size, SHA-256 of the words) of the spans of (doc_id, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            at, size = (lists.flatten().field(i).to_numpy() for i in (0, 1))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            for first, after, data, offsets in text_slices(batch.column(1)):
                words = scan_words(data, offsets, hashed=False)
                raw = data.tobytes()
                lo, hi = ends[first], ends[after]
                row = np.repeat(np.arange(after - first), np.diff(ends[first : after + 1]))
                start = words.bounds[row] + at[lo:hi]
                stop = np.minimum(start + size[lo:hi] + window - 1, words.bounds[row + 1])
                digest = [
                    hashlib.sha256(_joined(words, a, b, raw)).digest()
                    for a, b in zip(start.tolist(), stop.tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first:after][row]), pa.array(at[lo:hi]), pa.array(size[lo:hi]),
                     pa.array(digest, pa.binary())],
                    names=["doc_id", "at", "size", "digest"],
                )

    return run


def _all_as_source(ids: DataFrame, spans: DataFrame, window: int) -> bool:
    """Whether the words of every span are those at its source's coordinates."""
    source = spans.select(F.col("source_id").alias("doc_id"), F.col("source_at").alias("at"), "size")
    wanted = materialise(
        spans.select("doc_id", "at", "size").unionByName(source).groupBy("doc_id").agg(
            F.collect_set(F.struct("at", "size")).alias("places")
        ),
        "compared-places",
    )
    digests = materialise(
        _with(ids, wanted, "places").select("doc_id", "text", "places").transform(
            map_batches,
            _span_digests(window), "doc_id long, at int, size int, digest binary"
        ),
        "span-digests",
    )
    one = spans.join(digests, ["doc_id", "at", "size"], "left").withColumnRenamed("digest", "own")
    two = digests.toDF("source_id", "source_at", "size", "digest")
    both = one.join(two, ["source_id", "source_at", "size"], "left")
    return both.where(F.coalesce(F.col("own") != F.col("digest"), F.lit(True))).isEmpty()


def _keep(texts: pa.Array, spans: pa.Array, window: int) -> Iterator[tuple]:
    """(first row, words of each row, removed words, kept words as UTF-8) of slices."""
    flat = spans.flatten()
    starts, sizes = (flat.field(i).to_numpy() for i in (0, 1))
    ends = np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in spans])])
    for first, after, data, offsets in text_slices(texts):
        words = scan_words(data, offsets, hashed=False)
        lo, hi = ends[first], ends[after]
        row = np.repeat(np.arange(after - first), np.diff(ends[first : after + 1]))
        change = np.zeros(len(words.start) + 1, np.int64)
        begin = words.bounds[row] + starts[lo:hi]
        np.add.at(change, begin, 1)
        np.add.at(change, begin + sizes[lo:hi] + window - 1, -1)
        kept = np.cumsum(change)[:-1] == 0
        count = np.concatenate([[0], np.cumsum(kept)])[words.bounds]
        where = np.flatnonzero(kept)
        left = Words(data, words.start[where], words.stop[where], count, words.hash)
        raw = data.tobytes()
        joined = [_joined(left, a, b, raw) for a, b in zip(count.tolist(), count[1:].tolist())]
        total = np.diff(words.bounds)
        yield first, total, total - np.diff(count), joined


def _digest_kept(window: int):
    """Per document of (doc_id, text, spans): words, removed words, checksum of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, total, removed, kept in _keep(batch.column(1), batch.column(2), window):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(total)), pa.array(total), pa.array(removed),
                     pa.array([hashlib.sha256(t).hexdigest() for t in kept])],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    return run


def _with(docs: DataFrame, side: DataFrame, cells: str, how: str = "inner") -> DataFrame:
    """``docs`` joined with a stored table that has one row per id and an array ``cells``.

    The table is broadcast up to 4 array cells per allowed id; a larger one is joined by
    a shuffle of both sides.
    """
    size = side.agg(F.sum(F.size(cells) + 4)).head()[0] or 0
    return docs.join(F.broadcast(side) if size <= 4 * BROADCAST_IDS else side, "doc_id", how)


def _without(summary: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows of ``summary`` that are not in ``copies``, a stored table of some of them.

    Only rows that share an id with a copy are compared by their words' checksum too, so
    the lists of minimizers of all others stay where they are.
    """
    own = ["doc_id", "whole_sha256"]
    ids = copies.select("doc_id").distinct()
    near = rows_of(summary, ids, "doc_id").join(copies.select(*own), own, "left_anti")
    return rows_of(summary, ids, "doc_id", "left_anti").unionByName(near.select(*summary.columns))


class Repeats:
    """What repeats in a table of documents, stored; see :func:`find_repeats`."""

    def __init__(self, docs: DataFrame, summary: DataFrame, copies: DataFrame, spans: DataFrame):
        self.docs, self.summary, self.copies, self.spans = docs, summary, copies, spans


def find_repeats(docs: DataFrame, window: int = WINDOW) -> Repeats:
    """All windows of ``docs`` (doc_id, text) that also start earlier, as compacted spans.

    Words are what stands between ASCII blanks, unchanged. Earlier is a smaller doc_id, or
    the same document and an earlier place. ``spans`` has doc_id, at (first window, from
    0), size (windows in a row), source_id and source_at of the same text; spans that
    repeat their own document have no source. ``copies`` has the documents whose words all
    equal those of a smaller id, ``first_id``: they have no spans, and a window in them is
    repeated if there is any; they are told by the SHA-256 of their words. Null texts have no words; rows with a null id come before
    all others; rows that share an id are not earlier than each other.

    Windows are found by hashes of 95 bits. The words of each compacted span are then
    compared with those at its source, by SHA-256. If a single one differs, all edges are
    taken again as SHA-256 digests of their words.

    The stages run when this function is called; each is stored under the checkpoint folder.
    """
    ids = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), "text"
    )
    summary = materialise(
        ids.transform(
            map_batches,
            _summarise(window),
            "doc_id long, n_words long, whole_sha256 string,"
            " grams array<long>, own_grams array<long>",
        ),
        "summaries",
    )
    firsts = summary.where(F.col("n_words") >= window).groupBy("whole_sha256").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )
    copies = materialise(
        summary.join(firsts.where("first_id < last_id"), ["whole_sha256"])
        .where("doc_id > first_id")
        .select("doc_id", "whole_sha256", "first_id"),
        "copies",
    )
    originals = _without(summary, copies)

    # Minimizers in more than one place. The ones of several documents are stored before
    # they are looked up, so that a hot one can be split in the join.
    grams = originals.select("doc_id", F.explode("grams").alias("gram"))
    often = materialise(
        grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams"
    )
    repeated = grams.join(often, "gram", "left_semi").unionByName(
        originals.select("doc_id", F.explode("own_grams").alias("gram"))
    )
    wanted = materialise(
        repeated.groupBy("doc_id").agg(F.collect_set("gram").alias("grams")), "repeated-grams"
    )
    spans, own = _compacted(ids, wanted, window, False)
    if not _all_as_source(ids, spans, window):
        spans, own = _compacted(ids, wanted, window, True)
    return Repeats(ids, summary, copies, materialise(spans.unionByName(own), "spans"))


def _compacted(
    ids: DataFrame, wanted: DataFrame, window: int, exact: bool
) -> tuple[DataFrame, DataFrame]:
    """Spans with a source in another document, stored, and those that repeat their own."""
    kind = "binary" if exact else "long"
    # Not stored: the edges of the second pass are larger than computing them again is dear.
    found = (
        _with(ids, wanted, "grams")
        .select("doc_id", "text", "grams")
        .transform(
            map_batches,
            _find_edges(window, exact), f"edge {kind}, check int, doc_id long, at int, size int"
        )
    )
    edges = found.where("edge is not null").select("edge", "check", "doc_id", "at")
    first = edges.groupBy("edge", "check").agg(
        F.min("doc_id").alias("source_id"), F.count("*").alias("n")
    )
    first = materialise(first.where("n > 1").drop("n"), "repeated-edges")
    placed = edges.join(first, ["edge", "check"])
    source = placed.where("doc_id = source_id").select("edge", "check", F.col("at").alias("source_at"))
    # Rows that share the first id may both hold an edge: one of them is the source.
    source = source.groupBy("edge", "check").agg(F.min("source_at").alias("source_at"))
    on = F.col("at") - F.col("source_at")
    repeated = materialise(
        placed.where("doc_id > source_id").join(source, ["edge", "check"]).select(
            "doc_id", "source_id", on.alias("on"), "at"
        ),
        "repeated-places",
    ).distinct()
    # Paths: consecutive windows of a document on consecutive windows of one source. A place
    # without a match is the first of a path, a successor without one comes after the last.
    keys = ["doc_id", "source_id", "on"]
    here = repeated.select(*keys, "at", F.lit(True).alias("here"))
    after = repeated.select(*keys, (F.col("at") + 1).alias("at"), F.lit(True).alias("after"))
    edge_of_path = here.join(after, [*keys, "at"], "full").where("here is null or after is null")
    ends = edge_of_path.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("here"), F.col("at")))).alias("starts"),
        F.sort_array(F.collect_list(F.when(F.col("after"), F.col("at")))).alias("stops"),
    )
    paths = ends.select(
        "doc_id", "source_id", "on", F.explode(F.arrays_zip("starts", "stops")).alias("path")
    ).select(
        "doc_id",
        F.col("path.starts").alias("at"),
        (F.col("path.stops") - F.col("path.starts")).alias("size"),
        "source_id",
        (F.col("path.starts") - F.col("on")).alias("source_at"),
    )
    spans = materialise(paths, "paths")
    own = found.where("edge is null").select(
        "doc_id", "at", "size",
        F.lit(None).cast("long").alias("source_id"), F.lit(None).cast("int").alias("source_at"),
    )
    return spans, own


def _spans_by_document(repeats: Repeats, copies: bool, window: int) -> DataFrame:
    spans = repeats.spans.select("doc_id", "at", "size")
    if copies:
        whole = (F.col("n_words") - (window - 1)).cast("int")
        rows = repeats.summary.join(repeats.copies, ["doc_id", "whole_sha256"], "left_semi")
        spans = spans.unionByName(rows.select("doc_id", F.lit(0).alias("at"), whole.alias("size")))
    return materialise(
        spans.groupBy("doc_id").agg(F.collect_set(F.struct("at", "size")).alias("spans")),
        "document-spans",
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the words that repeat earlier ones, and without texts left empty.

    Rules as for :func:`find_repeats`. A text that loses words becomes its kept words
    joined by one space; others stay as they are. Rows that lose all words go. All columns
    stay, whatever their names; ``n_chars``, if there, is the length of the new text. Rows
    with a null id keep their text.
    """
    return apart(docs, ("doc_id", "text", "n_chars"), lambda plain: _remove_repeats(plain, window))


def _remove_repeats(docs: DataFrame, window: int) -> DataFrame:
    spans = _spans_by_document(find_repeats(docs, window), True, window).withColumnRenamed(
        "spans", "__spans"
    )
    joined = _with(docs, spans, "__spans", "left")
    texts, at = joined.columns.index("text"), joined.columns.index("__spans")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        changed = batch.column(at).is_valid().to_numpy(zero_copy_only=False)
        where = np.flatnonzero(changed)
        part = batch.take(pa.array(where))
        new = [t for _, _, _, kept in _keep(part.column(texts), part.column(at), window) for t in kept]
        old = batch.column(texts).to_pylist()
        for i, text in zip(where.tolist(), new):
            old[i] = text.decode("utf-8", "replace") or None
        return [pa.array(old, pa.string()), pa.array(changed)]

    fields = [("__text", T.StringType()), ("__changed", T.BooleanType())]
    edited = add_columns(joined, fields, compute, ("text", "__spans")).where(
        "not (__changed and __text is null)"
    )
    columns = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("__changed"), F.length("__text").cast(kind)).otherwise(
            F.col("n_chars")
        )
    return edited.select(*(columns.get(c, column(c)).alias(c) for c in docs.columns))


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``.

    Every word that a window of :func:`find_repeats` covers is removed, judged on the
    input; the kept words are joined by one space. An empty text keeps nothing. A document
    is found again by its id, so rows that share an id get the spans of all of them.
    """
    repeats = find_repeats(docs, window)
    per_doc = _spans_by_document(repeats, False, window)
    changed = (
        _with(repeats.docs, per_doc, "spans")
        .select("doc_id", "text", "spans")
        .transform(
            map_batches,
            _digest_kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string"
        )
    )
    rest = repeats.summary.join(repeats.spans.select("doc_id").distinct(), "doc_id", "left_anti")
    copy = repeats.copies.select("doc_id", "whole_sha256", F.lit(True).alias("copy")).distinct()
    whole = rest.join(copy, ["doc_id", "whole_sha256"], "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(0).alias("n_removed"),
        F.when(F.col("copy"), F.lit(_NONE)).otherwise(F.col("whole_sha256")).alias("kept_sha256"),
    )
    result = whole.unionByName(changed)
    return result.withColumn("doc_id", F.when(F.col("doc_id") > -(2**63), F.col("doc_id")))
