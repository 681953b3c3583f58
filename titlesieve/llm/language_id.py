"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titlesieve.llm.batches import add_columns, map_batches
from titlesieve.llm.textscan import LOWER, text_slices

UNDETERMINED = "und"
#: Buckets of n-grams; the bucket after them is neutral.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled rows that the model is fitted on, for each language (expected number).
TRAIN_ROWS = 3_000
SMOOTHING = 0.1


class LanguageModel(NamedTuple):
    languages: list[str]
    priors: np.ndarray  # log, by language
    weights: np.ndarray  # log, language x (BUCKETS + 1), 0 in the neutral bucket


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, A-Z in lower case, and offsets of rows in them."""
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text = LOWER[data].tobytes().decode("utf-8", "replace")
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), starts[offsets]


def _grams(points: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram at each code point; neutral where it leaves its text."""
    value = points.astype(np.uint64)
    for k in range(1, order):
        value[:-k] = value[:-k] * np.uint64(0x100000001B3) + points[k:]
    value = (value + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (value >> np.uint64(48)).astype(np.int32)
    for k in range(1, order):
        ends = offsets[1:] - k
        bucket[ends[(ends >= offsets[:-1])]] = BUCKETS
    return bucket


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        languages = np.array(batch.column(0).to_pylist(), object)
        for first, after, data, offsets in text_slices(batch.column(1)):
            points, rows = _code_points(data, offsets)
            own = languages[first:after]
            of_point = np.repeat(np.arange(after - first), np.diff(rows))
            for language in dict.fromkeys(own):
                mine = (own == language)[of_point]
                total = np.zeros(BUCKETS + 1, np.int64)
                for order in ORDERS:
                    total += np.bincount(_grams(points, rows, order)[mine], minlength=BUCKETS + 1)
                at = np.flatnonzero(total[:BUCKETS])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                     pa.array(total[at])],
                    names=["lang", "bucket", "n"],
                )


def fit(docs: DataFrame, learn: Column, train_rows: int = TRAIN_ROWS) -> LanguageModel | None:
    """A model of the non-null ``lang`` of the rows where ``learn`` holds; None without any.

    About ``train_rows`` whole texts of each language are used, all where there are fewer.
    A row is among them by a hash of its text, so the same rows are taken wherever they
    are stored. Driver and executors hold one number per language and bucket.
    """
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.lit(0.0)
    for language, rows in sizes.items():
        share = F.when(F.col("lang") == language, F.lit(min(1.0, train_rows / rows))).otherwise(share)
    drawn = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) / float(1 << 30) < share
    counts = (
        labelled.where(drawn)
        .select("lang", "text")
        .transform(map_batches, _count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    languages = sorted(sizes)
    table = np.full((len(languages), BUCKETS), SMOOTHING)
    order = {name: i for i, name in enumerate(languages)}
    rows = np.array([order[name] for name in counts["lang"].to_pylist()], int)
    table[rows, counts["bucket"].to_numpy()] += counts["n"].to_numpy()
    weights = np.zeros((len(languages), BUCKETS + 1), np.float32)
    weights[:, :BUCKETS] = np.log(table / table.sum(axis=1, keepdims=True))
    total = np.array([sizes[name] for name in languages], float)
    return LanguageModel(languages, np.log(total / total.sum()), weights)


def identify(docs: DataFrame, model: LanguageModel | None, keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred and lang_score (DOUBLE, 0 to 1).

    The prediction is the language of the largest posterior, the first by name of equal
    ones, and the score that posterior. A null text, one without a letter, or the lack of
    a model give ``und`` and 0. Whole texts are scored, whatever their length; a text is
    never joined with its neighbour. Other columns stay; lang_pred and lang_score are
    replaced if they exist. ``keep_text`` False drops the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    letters: list[np.ndarray] = []

    def score(batch: pa.RecordBatch) -> list[pa.Array]:
        model = shared.value
        if not letters:
            letters.append(_letters())
        names, scores = [], []
        for first, after, data, offsets in text_slices(batch.column(at)):
            points, rows = _code_points(data, offsets)
            filled = np.flatnonzero(np.diff(rows) > 0)
            has_letter = np.zeros(after - first, bool)
            total = np.zeros((after - first, len(model.languages) if model else 0))
            if len(filled):
                begins = rows[filled]
                has_letter[filled] = np.logical_or.reduceat(letters[0][points], begins)
                if model:
                    total += model.priors
                    for order in ORDERS:
                        bucket = _grams(points, rows, order)
                        for i, weights in enumerate(model.weights):
                            total[filled, i] += np.add.reduceat(
                                weights[bucket], begins, dtype=np.float64
                            )
            known = has_letter if model else np.zeros(after - first, bool)
            best = total.argmax(axis=1) if model else np.zeros(after - first, int)
            if model:
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                share = odds.max(axis=1) / odds.sum(axis=1)
            else:
                share = np.zeros(after - first)
            names += [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known)]
            scores.append(np.where(known, share, 0.0))
        return [pa.array(names, pa.string()), pa.array(np.concatenate(scores))]

    fields = [("lang_pred", T.StringType()), ("lang_score", T.DoubleType())]
    return add_columns(docs, fields, score, () if keep_text else ("text",))
