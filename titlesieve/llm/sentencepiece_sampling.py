"""SentencePiece encoding and decoding, with segmentations sampled without replacement.

``encode`` and ``decode`` follow the model's own rule. ``segment`` also draws k different
segmentations of each text by Gumbel top-k: every path through the lattice has a Gumbel
number at its log-probability, and an A-star search from the top finds the k largest
without listing paths. A set of paths (all that leave a found path at one place) has the
largest number of its members as its bound; the set with the largest bound is split next.
"""

from __future__ import annotations

import zlib
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titlesieve.llm import textscan
from titlesieve.llm.batches import add_columns, apart, kept
from titlesieve.llm.idstore import IdStore
from titlesieve.llm.lattice import MARK, Lattice, Vocabulary, truncated_gumbel, uniform
from titlesieve.llm.textscan import mix, ragged, span_hash, text_slices

SAMPLES = 2
ALPHA = 1.0
#: See Segmenter.sample.
REACH = 90.0
#: Bytes of text laid out at a time: the more, the fewer words come again in the next layout.
#: ``segment`` shares an executor with what the stages before it left there.
LAYOUT_BYTES, SEGMENT_BYTES = 1 << 21, 1 << 19
#: Words of text that are sampled at a time, whole rows of them.
WALKED_WORDS = 100_000
#: Words whose ids a worker remembers; its lattices need the memory more. Fewer in ``segment``, as above.
MOST_WORDS, SEGMENT_WORDS = 300_000, 100_000


class Sample(NamedTuple):
    ids: np.ndarray
    log_prob: float
    perturbed: float
    log_inclusion: float


class Layout(NamedTuple):
    """Words of a slice of texts; ``bounds`` has the occurrences of each row."""

    words: list[str]  # distinct, without the space before them
    hashes: np.ndarray | None  # of the words, ascending; None if two share one
    spans: tuple[np.ndarray, np.ndarray, np.ndarray] | None  # bytes, begin and end of words
    word: np.ndarray  # the word at each occurrence
    bounds: np.ndarray


class Segmenter:
    """Encodes, samples and decodes slices of texts, for one model."""

    def __init__(self, model: bytes, alpha: float = ALPHA, most: int = SEGMENT_WORDS) -> None:
        from sentencepiece import SentencePieceProcessor

        # Once an array of this size was freed, the C library keeps smaller ones for the next.
        np.empty((32 << 20) - 8_192, np.uint8)
        self.processor = SentencePieceProcessor(model_proto=model)
        self.vocabulary = Vocabulary(self.processor, alpha)
        self.store = IdStore(self._encode, most)
        pieces = [self._spelling(i) for i in range(self.vocabulary.size)]
        self.pieces = pa.array(pieces, pa.large_binary())

    def _encode(self, words: list[str]) -> list[list[int]]:
        mark = [self.processor.piece_to_id(MARK)]
        return [ids or mark for ids in self.processor.encode(words, num_threads=1)]

    def _spelling(self, i: int) -> bytes:
        if self.processor.is_byte(i):
            return bytes([int(self.processor.id_to_piece(i)[3:5], 16)])
        if self.processor.is_control(i):
            return b""
        return self.processor.id_to_piece(i).replace(MARK, " ").encode()

    def layout(self, data: np.ndarray, offsets: np.ndarray) -> Layout:
        """Distinct words of the slice, the word at each occurrence, and rows' bounds.

        A word is what follows a space up to the next word's space; further spaces belong
        to the word after them. The start of a text counts as a space before it, which is
        the model's own rule. ``data`` holds spaces for marks, see :func:`marks_as_spaces`.
        """
        space = data == 0x20
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        begins = offsets[:-1][np.diff(offsets) > 0]
        cut[begins] = True
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], len(data))
        inner = np.ones(len(data), bool)
        inner[begins] = False
        key = start + inner[start]
        hashes = span_hash(textscan.prefix_hash(textscan._BYTES[data]), key, stop)
        order = np.argsort(hashes)
        hashes = hashes.take(order)
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        word = np.empty(len(order), np.int64)
        word[order] = np.cumsum(new) - 1
        first, hashes = order[new], hashes[new]
        raw = data.tobytes()
        words = [
            raw[a:b].decode("utf-8", "replace")
            for a, b in zip(key[first].tolist(), stop[first].tolist())
        ]
        bounds = np.searchsorted(start, offsets)
        size = stop - key
        if not (
            np.array_equal(size, size[first][word])
            and textscan.equal_spans(data, key, data, key[first][word], size).all()
        ):
            every = [raw[a:b].decode("utf-8", "replace") for a, b in zip(key.tolist(), stop.tolist())]
            words = list(dict.fromkeys(every))
            place = {w: i for i, w in enumerate(words)}
            word = np.array([place[w] for w in every], np.int64)
            return Layout(words, None, None, word, bounds)
        return Layout(words, hashes, (data, key[first], stop[first]), word, bounds)

    def encode(self, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows by the model's own rule, and the number of ids of each row."""
        places = np.full(1, -1)
        if layout.hashes is not None:
            places = self.store.find(layout.hashes, layout.words.__getitem__, layout.spans)
        if (places >= 0).all():
            ids, sizes = self.store.ids(places[layout.word])
        else:  # words that share a hash are encoded as they are
            coded = self._encode(layout.words)
            size = np.fromiter(map(len, coded), np.int64, len(coded))
            flat = np.fromiter(chain.from_iterable(coded), np.uint32, int(size.sum()))
            sizes = size[layout.word]
            ids = flat[ragged((np.cumsum(size) - size)[layout.word], sizes)]
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[layout.bounds])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 of each row of ids: the pieces one after the other without the first space."""
        after, flat = self.pieces.take(pa.array(ids)).buffers()[1:]
        flat = flat.to_pybytes() if flat is not None else b""
        ends = np.frombuffer(after, np.int64)[bounds].tolist()
        return [flat[a:b][1:] if flat[a : a + 1] == b" " else flat[a:b] for a, b in zip(ends, ends[1:])]

    def sample(
        self, layout: Layout, keys: np.ndarray, k: int, reach: float = REACH
    ) -> list[list[Sample]]:
        """Up to ``k`` different segmentations of each row, largest perturbed number first.

        Places less likely to be reached than exp(-reach) get no bound at first: it is at
        most 38 above its location, so while all chosen bounds are larger it is not needed.
        Where one is not, its rows are done again with all bounds.
        """
        lattice = Lattice(layout.words, self.vocabulary)
        out, first, bounds = [], 0, layout.bounds
        while first < len(keys):
            after = int(np.searchsorted(bounds, bounds[first] + WALKED_WORDS, "right")) - 1
            after = min(max(after, first + 1), len(keys))
            word = layout.word[bounds[first] : bounds[after]]
            some = bounds[first : after + 1] - bounds[first]
            out += self._sample(lattice, word, some, keys[first:after], k, reach)
            first = after
        return out

    def _sample(
        self, lattice: Lattice, word: np.ndarray, bounds: np.ndarray, keys: np.ndarray, k: int, reach: float
    ) -> list[list[Sample]]:
        row_seed = mix(keys.astype(np.int64).view(np.uint64))
        row = np.repeat(np.arange(len(keys)), np.diff(bounds))
        place = np.arange(len(word)) - bounds[row]
        nodes = lattice.first_node[word]
        edges, counts = lattice.walk(nodes, mix(row_seed[row] + place.astype(np.uint64)))
        top = -np.log(-np.log(uniform(row_seed, 1 << 40)))
        searches = [_Search(lattice, k) for _ in keys]
        ends = np.concatenate([[0], np.cumsum(counts)])
        token_bounds = ends[bounds]
        rests, log_probs = _rests(lattice, edges, token_bounds, top, row_seed, reach)
        for r, search in enumerate(searches):
            a, b = token_bounds[r], token_bounds[r + 1]
            search.add(edges[a:b], rests[a:b], top[r], log_probs[r])
        first_token = ends[:-1]
        for n in range(1, k + 1):
            splits = [
                search.split(r, uniform(row_seed[r : r + 1], (n << 41) + np.arange(2)))
                for r, search in enumerate(searches)
                if not search.done
            ]
            splits = [s for s in splits if s is not None]
            if n == k or not splits:
                break
            # The rest of the split word, then the words after it, for all rows at once.
            starts, seeds, sizes = [], [], []
            for r, path, t, edge, _ in splits:
                occurrence = bounds[r] + searches[r].words_before(path, t)
                later = nodes[occurrence + 1 : bounds[r + 1]]
                starts.append(np.append(lattice.after(edge), later))
                sizes.append(len(later) + 1)
                counter = np.arange(len(later) + 1).astype(np.uint64)
                seeds.append(mix(row_seed[r] + np.uint64(n << 32) + counter))
            walked, lengths = lattice.walk(np.concatenate(starts), np.concatenate(seeds))
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
            paths = [
                np.concatenate([searches[r].paths[path][:t], [edge], walked[a:b]])
                for (r, path, t, edge, _), a, b in zip(splits, ends, ends[1:])
            ]
            cuts = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
            rows, most = np.array([s[0] for s in splits]), np.array([s[4] for s in splits])
            rests, log_probs = _rests(
                lattice, np.concatenate(paths), cuts, most, mix(row_seed[rows] + np.uint64(n)), reach
            )
            for (r, _, t, _, bound), path, a, b, log_prob in zip(splits, paths, cuts, cuts[1:], log_probs):
                rests[a : a + t + 1] = -np.inf
                searches[r].add(path, rests[a:b], bound, log_prob)
        if any(search.needs(reach) for search in searches):
            return self._sample(lattice, word, bounds, keys, k, np.inf)
        return _samples(lattice, searches)


def _samples(lattice: Lattice, searches: list[_Search]) -> list[list[Sample]]:
    paths = [path for search in searches for path in search.paths]
    cuts = np.concatenate([[0], np.cumsum([len(path) for path in paths])]).astype(np.int64)
    edges = np.concatenate([*paths, np.zeros(0, np.int64)])
    ids, sizes = lattice.ids(edges)
    ends = np.concatenate([[0], np.cumsum(sizes)])[cuts]
    out, k = [], 0
    for search in searches:
        row = []
        for perturbed, log_prob in zip(search.perturbed, search.log_probs):
            inside = log_inclusion(log_prob, search.left)
            row.append(Sample(ids[ends[k] : ends[k + 1]], log_prob, perturbed, inside))
            k += 1
        out.append(row)
    return out


def marks_as_spaces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with a space for each mark (U+2581), which the model cannot tell apart."""
    raw, mark = data.tobytes(), MARK.encode()
    if mark not in raw:
        return data, offsets
    rows = [raw[a:b].replace(mark, b" ") for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])


def _rests(lattice, edges, bounds, most, seeds, reach) -> tuple[np.ndarray, np.ndarray]:
    """The bound of all paths that leave a found path at each place; the paths' log-probabilities.

    They share what is before the place and take another edge there; their largest
    Gumbel number is one at the log of their joint probability, at most the path's own.
    """
    counts = np.diff(bounds)
    row = np.repeat(np.arange(len(counts)), counts)
    exact = lattice.log_p(edges)
    # In steps of 2**-32, sums are exact and do not depend on the texts before.
    log_p = np.rint(exact * 2.0**32) / 2.0**32
    running = np.cumsum(log_p) - log_p  # before each place
    filled = counts > 0
    base = np.zeros(len(counts))
    base[filled] = running[bounds[:-1][filled]]
    location = running - base[row]
    near = np.flatnonzero(location >= -reach)
    rests = np.full(len(edges), -np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        other = np.log(-np.expm1(exact[near]))
        u = uniform(seeds[row[near]] ^ np.uint64(0x5DEECE66D), near - bounds[row[near]])
        rests[near] = truncated_gumbel(location[near] + other, most[row[near]], u)
    ends = np.cumsum(log_p)[bounds[1:][filled] - 1]
    log_probs = np.zeros(len(counts))
    log_probs[filled] = ends - base[filled]
    return rests, log_probs


class _Search:
    """The found paths of one text and the bounds of what is left beside them."""

    def __init__(self, lattice: Lattice, k: int) -> None:
        self.lattice, self.k, self.done = lattice, k, False
        self.paths: list[np.ndarray] = []
        self.rests: list[np.ndarray] = []
        self.perturbed: list[float] = []
        self.log_probs: list[float] = []
        self.taken: dict[tuple[int, int], list[int]] = {}
        self.left = -np.inf

    def add(self, path: np.ndarray, rest: np.ndarray, perturbed: float, log_prob: float) -> None:
        self.paths.append(path)
        self.rests.append(rest)
        self.perturbed.append(float(perturbed))
        self.log_probs.append(float(log_prob))

    def needs(self, reach: float) -> bool:
        """Whether a bound that was not computed could have been chosen."""
        chosen = min([self.left, *self.perturbed[1:]])
        return chosen < 38 - reach and min(self.log_probs, default=0.0) < -reach

    def words_before(self, path: int, t: int) -> int:
        """Words of the text that end before token t of a path."""
        return int(self.lattice.is_end(self.lattice.after(self.paths[path][:t])).sum())

    def split(self, row: int, u: np.ndarray):
        """(row, path, place, new edge, bound) of the set with the largest bound."""
        best = [(rest.max(), i) for i, rest in enumerate(self.rests) if len(rest)]
        bound, path = max(best, default=(-np.inf, 0))
        self.left = float(bound)
        if bound == -np.inf or len(self.paths) == self.k:
            self.done = True
            return None
        t = int(self.rests[path].argmax())
        lattice, own = self.lattice, self.paths[path]
        node = int(lattice.node_of(own[t]))
        taken = self.taken.setdefault((path, t), [int(own[t])])
        free = lattice.edges_of(node)
        for one in taken:
            free = free[free != one]
        share = np.exp(lattice.log_p(free))
        edge = int(free[min(np.searchsorted(share.cumsum(), u[0] * share.sum(), "right"), len(free) - 1)])
        taken.append(edge)
        others = share[free != edge].sum()
        if others > 0:
            location = lattice.log_p(own[:t]).sum() + np.log(others)
            self.rests[path][t] = truncated_gumbel(location, bound, u[1])
        else:
            self.rests[path][t] = -np.inf
        return row, path, t, edge, bound


def log_inclusion(log_prob: float, threshold: float) -> float:
    """Log of the probability that a segmentation is among the k, given the (k+1)-th number.

    1 - exp(-exp(log_prob - threshold)); texts of many words have tiny ones, hence the log.
    """
    x = log_prob - threshold
    if x > 5:
        return 0.0
    inside = np.exp(x)
    return float(x if inside < 1e-12 else np.log(-np.expm1(-inside)))


_SAMPLE = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("log_prob", T.DoubleType()),
    T.StructField("perturbed", T.DoubleType()),
    T.StructField("log_inclusion", T.DoubleType()),
])


def _segmenter(docs: DataFrame, model: bytes, alpha: float, most: int = SEGMENT_WORDS):
    """A function that gives each Python worker its own segmenter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = ("segmenter", zlib.crc32(model), alpha, most)

    def get() -> Segmenter:
        return kept(key, lambda: Segmenter(shared.value, alpha, most))

    return get


def _lists(sizes, values: pa.Array) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def decode(rows: DataFrame, model: bytes) -> DataFrame:
    """``rows`` with ``decoded`` (STRING): the text of their ``ids``; empty for null ids.

    Byte pieces that are not UTF-8 together become replacement characters. A mark
    character (U+2581) in the encoded text comes back as a space: the model's alphabet
    has one sign for both.
    """
    get, at = _segmenter(rows, model, ALPHA), rows.columns.index("ids")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        lists = batch.column(at)
        sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
        flat = lists.flatten().to_numpy().astype(np.int64)
        texts = get().decode(flat, np.concatenate([[0], np.cumsum(sizes)]))
        return [pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())]

    return add_columns(rows, [("decoded", T.StringType())], compute)


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` with ``ids`` (ARRAY<INT>): the model's own segmentation of whole texts.

    ``model`` is the content of a SentencePiece model with the usual treatment of spaces
    (a mark before every word and before the text, nothing removed). Null and empty texts
    have no ids. Other columns stay; ``ids`` is replaced.
    """
    return segment(docs, model, k=0)


def segment(
    docs: DataFrame, model: bytes, k: int = SAMPLES, alpha: float = ALPHA, seed: int = 29
) -> DataFrame:
    """``docs`` with ``ids``, see :func:`encode`, and ``samples``.

    ``samples`` are up to ``k`` different segmentations of each whole text. Each has ids,
    log_prob (of the lattice's distribution, see ``lattice.Vocabulary``), the perturbed
    number it was chosen by, in descending order, and log_inclusion, the log of the chance
    to be among the k. The numbers are seeded by ``seed`` and doc_id, so a row has the
    same samples wherever it is computed, and rows of one id and text agree. A text with
    fewer than ``k`` segmentations has all of them; a null or empty one has the empty
    segmentation. With ``k`` 0 there is no column of samples. Other columns stay; those
    of the new names are replaced.
    """
    new = ("ids", "samples")[: 2 if k else 1]
    return apart(docs, ("doc_id", "text"), lambda plain: _segment(plain, model, k, alpha, seed), new)


def _segment(docs: DataFrame, model: bytes, k: int, alpha: float, seed: int) -> DataFrame:
    keyed = docs.withColumn("__seed", F.xxhash64(F.lit(seed), F.col("doc_id")))
    get, at = _segmenter(docs, model, alpha), keyed.columns.index("text")
    key = keyed.columns.index("__seed")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        keys, coded, drawn = batch.column(key).to_numpy(), [], []
        for first, after, data, offsets in text_slices(batch.column(at), SEGMENT_BYTES):
            layout = get().layout(*marks_as_spaces(data, offsets))
            ids, counts = get().encode(layout)
            coded.append(_lists(counts, pa.array(ids.astype(np.int32))))
            if not k:
                continue
            rows = get().sample(layout, keys[first:after], k)
            flat = [s for row in rows for s in row]
            ids = np.concatenate([np.zeros(0, np.int32), *(s.ids.astype(np.int32) for s in flat)])
            numbers = [pa.array([s[i] for s in flat], pa.float64()) for i in (1, 2, 3)]
            each = pa.StructArray.from_arrays(
                [_lists([len(s.ids) for s in flat], pa.array(ids)), *numbers],
                names=["ids", "log_prob", "perturbed", "log_inclusion"],
            )
            drawn.append(_lists([len(row) for row in rows], each))
        return [pa.concat_arrays(x) for x in (coded, drawn) if x]

    fields = [("ids", T.ArrayType(T.IntegerType())), ("samples", T.ArrayType(_SAMPLE))]
    return add_columns(keyed, fields[: 2 if k else 1], compute, ("__seed",))


_DIGESTS = [
    ("n_pieces", T.LongType()), ("ids_crc32", T.LongType()), ("round_trip", T.BooleanType()),
    ("same_text", T.BooleanType()),
    ("samples", T.ArrayType(T.StructType([
        T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        T.StructField("log_prob", T.DoubleType()), T.StructField("perturbed", T.DoubleType()),
        T.StructField("log_inclusion", T.DoubleType()),
    ]))),
]


def digests(
    docs: DataFrame, model: bytes, k: int = SAMPLES, alpha: float = ALPHA, seed: int = 29
) -> DataFrame:
    """doc_id, digests of what ``segment`` gives, and whether all of them decode right.

    Checksums are of the ids as little-endian 32-bit integers. ``round_trip`` says that
    the model's segmentation and every sampled one decode to the text as the model sees
    it, with a space for each mark; ``same_text`` that they decode to the bytes of the text
    itself, which is false for a text with a mark. The ids themselves never leave the task.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64(F.lit(seed), F.col("doc_id")).alias("__seed"))
    get = _segmenter(docs, model, alpha, MOST_WORDS)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        keys = batch.column(2).to_numpy()
        sizes, sums, right, same, drawn = [], [], [], [], []
        for first, after, data, offsets in text_slices(batch.column(1), LAYOUT_BYTES):
            segmenter = get()
            raw = data.tobytes()
            originals = [raw[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            data, offsets = marks_as_spaces(data, offsets)
            layout = segmenter.layout(data, offsets)
            ids, counts = segmenter.encode(layout)
            samples = segmenter.sample(layout, keys[first:after], k)
            ends = np.concatenate([[0], np.cumsum(counts)])
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            fine = [d == t for d, t in zip(segmenter.decode(ids, ends), texts)]
            of = np.concatenate([np.full(len(row), r) for r, row in enumerate(samples)])
            flat = [s for row in samples for s in row]
            lengths = np.concatenate([[0], np.cumsum([len(s.ids) for s in flat])])
            decoded = segmenter.decode(np.concatenate([s.ids for s in flat]), lengths)
            for r, d in zip(of, decoded):
                fine[r] = fine[r] and d == texts[r]
            little = ids.astype("<u4")
            sizes += counts.tolist()
            sums += [zlib.crc32(little[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
            right += fine
            same += [f and t == o for f, t, o in zip(fine, texts, originals)]
            drawn += [
                [{"n_pieces": len(s.ids), "ids_crc32": zlib.crc32(s.ids.astype("<u4")),
                  "log_prob": s.log_prob, "perturbed": s.perturbed, "log_inclusion": s.log_inclusion}
                 for s in row]
                for row in samples
            ]
        kind = pa.list_(pa.struct([
            ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("log_prob", pa.float64()),
            ("perturbed", pa.float64()), ("log_inclusion", pa.float64()),
        ]))
        return [pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(right),
                pa.array(same, pa.bool_()), pa.array(drawn, kind)]

    return add_columns(keyed, _DIGESTS, compute, ("text", "__seed"))
