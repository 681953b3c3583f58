"""Quality scores: histogram gradient-boosted trees over statistics of whole documents."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titlesieve.llm.batches import add_columns
from titlesieve.llm.textscan import scan_words, text_slices

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_std", "longest_word", "upper",
    "digits", "symbols", "exclaims", "bars", "stops", "beyond_ascii", "line_breaks",
    "distinct_words", "repeats_next", "repeats_second", "symbol_ends", "bare_symbols",
    "short_words", "upper_words", "line_repeats",
)

#: Labelled rows that the trees are fitted on (expected number).
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
_FIELD = "__statistics"


def _table(codes) -> np.ndarray:
    marks = np.zeros(256, bool)
    marks[list(codes)] = True
    return marks


_UPPER = _table(range(65, 91))
_DIGIT = _table(range(48, 58))
_MARKS = _table(set(range(33, 127)) - set(range(48, 58)) - set(range(65, 91))
                - set(range(97, 123)) - set(b".,'-"))
_EXCLAIM, _BAR, _STOP, _LINE = _table(b"!"), _table(b"|"), _table(b".,"), _table(b"\n")
_BEYOND = _table(range(128, 256))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over bounds[i]:bounds[i + 1], in double precision."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, dtype=np.float64, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Share of the keys of each row that are equal to an earlier key of the row."""
    counts = np.diff(bounds)
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((keys, row))
    same = np.zeros(len(keys))
    same[1:] = (keys[order][1:] == keys[order][:-1]) & (row[order][1:] == row[order][:-1])
    return _sums(same, bounds) / np.maximum(counts, 1)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text; all 0 for an empty one."""
    words = scan_words(data, offsets)
    size, count = np.diff(offsets), np.diff(words.bounds)
    per_byte, per_word = np.maximum(size, 1), np.maximum(count, 1)
    length = (words.stop - words.start).astype(np.float64)
    mean = _sums(length, words.bounds) / per_word
    square = _sums(length * length, words.bounds) / per_word
    longest = np.zeros(len(size))
    filled = np.flatnonzero(count)
    if len(filled):
        longest[filled] = np.maximum.reduceat(length, words.bounds[:-1][filled])

    def share(marks: np.ndarray) -> np.ndarray:
        return _sums(marks[data], offsets) / per_byte

    def equal_to(step: int) -> np.ndarray:
        same = np.zeros(len(words.hash))
        same[step:] = words.hash[step:] == words.hash[:-step]
        for k in range(step):
            at = words.bounds[:-1] + k
            same[at[at < words.bounds[1:]]] = 0
        return _sums(same, words.bounds) / per_word

    marked = np.concatenate([[0], np.cumsum(_MARKS[data])])
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    marks_in = marked[words.stop] - marked[words.start]
    ends = _MARKS[data[words.stop - 1]] if len(words.stop) else np.zeros(0)
    # Lines are told apart by the bytes between line breaks; a row's own bounds end a line.
    line_end = _LINE[data]
    line_end[(offsets[1:] - 1)[size > 0]] = True
    stops = np.flatnonzero(line_end) + 1
    line_bounds = np.searchsorted(stops, offsets, "right")
    word_of = np.searchsorted(words.start, np.concatenate([[0], stops]))
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash)])
    line_key = running[word_of[1:]] - running[word_of[:-1]]
    columns = [
        np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(square - mean * mean, 0)),
        longest, share(_UPPER), share(_DIGIT), share(_MARKS), share(_EXCLAIM), share(_BAR),
        share(_STOP), share(_BEYOND), share(_LINE), 1 - _repeated(words.hash, words.bounds),
        equal_to(1), equal_to(2), _sums(ends, words.bounds) / per_word,
        _sums(marks_in == length, words.bounds) / per_word,
        _sums(length <= 3, words.bounds) / per_word,
        _sums((upper[words.stop] - upper[words.start]) * 2 > length, words.bounds) / per_word,
        _repeated(line_key, line_bounds),
    ]
    table = np.stack(columns, axis=1)
    table[size == 0] = 0
    return table


def with_statistics(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with an ARRAY<DOUBLE> of STATISTICS; a null text counts as empty."""
    at = docs.columns.index("text")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        tables = [statistics(data, rows) for _, _, data, rows in text_slices(batch.column(at))]
        flat = pa.array(np.concatenate(tables).ravel())
        offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS)
        return [pa.ListArray.from_arrays(pa.array(offsets), flat)]

    fields = [(_FIELD, T.ArrayType(T.DoubleType()))]
    return add_columns(docs, fields, compute, () if keep_text else ("text",))


class Trees(NamedTuple):
    """Complete trees of one depth as flat arrays; inner node n has children 2n+1, 2n+2."""

    depth: int
    start: float  # log odds before the first tree
    feature: np.ndarray  # tree x inner node
    threshold: np.ndarray  # tree x inner node; values above it go to the second child
    leaf: np.ndarray  # tree x leaf, log odds

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.start)
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15,
    bins: int = 64, least_rows: int = 10, ridge: float = 1.0,
) -> Trees:
    """Logistic boosting; splits are sought over histograms of gradients by bin."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    model = Trees(depth, start, np.zeros((trees, inner), np.int64),
                  np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    odds = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-odds))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            gain = np.zeros(nodes)
            key = (node - first) * bins
            for f in range(width):
                at = key + binned[:, f]
                sums = [
                    np.bincount(at, w, nodes * bins).reshape(nodes, bins).cumsum(axis=1)
                    for w in (gradient, weight, None)
                ]
                g, h, c = sums
                left = g[:, :-1] ** 2 / (h[:, :-1] + ridge)
                right = (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + ridge)
                better = left + right - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                better[(c[:, :-1] < least_rows) | (c[:, -1:] - c[:, :-1] < least_rows)] = 0
                cut = better.argmax(axis=1)
                best = better[np.arange(nodes), cut]
                for k in np.flatnonzero((best > gain + 1e-9) & (cut < len(cuts[f]))):
                    gain[k] = best[k]
                    model.feature[t, first + k] = f
                    model.threshold[t, first + k] = cuts[f][cut[k]]
            at = model.feature[t, node]
            node = 2 * node + 1 + (x[np.arange(n), at] > model.threshold[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, weight, inner + 1)
        model.leaf[t] = rate * g / (h + ridge)
        odds += model.leaf[t, leaf]
    return model


def fit(statistics: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Trees:
    """Trees from the rows of ``labels`` (doc_id, quality) that have statistics.

    About ``train_rows`` label rows are used, drawn by a hash of the id, all where there
    are fewer; rows with a null label or id are not. Without any row every score is 1/2.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    share = min(1.0, train_rows / max(known.count(), 1))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) / float(1 << 30) < share
    rows = (
        statistics.select("doc_id", _FIELD)
        .join(known.where(drawn).select("doc_id", "quality"), "doc_id")
        .orderBy("doc_id", "quality")
        .select(_FIELD, "quality")
        .toArrow()
    )
    if not rows.num_rows:
        return Trees(0, 0.0, *(np.zeros((0, k)) for k in (0, 0, 1)))
    values = rows[_FIELD].combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    return fit_trees(values, rows["quality"].to_numpy().astype(np.float64))


def score(statistics: DataFrame, trees: Trees) -> DataFrame:
    """``statistics`` with quality_score (DOUBLE, 0 to 1) instead of its array."""
    shared = statistics.sparkSession.sparkContext.broadcast(trees)
    at = statistics.columns.index(_FIELD)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        values = batch.column(at).flatten().to_numpy().reshape(-1, len(STATISTICS))
        return [pa.array(shared.value.score(values))]

    return add_columns(statistics, [("quality_score", T.DoubleType())], compute, (_FIELD,))


