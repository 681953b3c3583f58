"""Toxicity by compression distance: windows compressed with a toxic and an ordinary dictionary.

A window is one word (long ones in overlapping pieces). Its gain is the number of bytes
that Zstandard needs for it with the ordinary dictionary, less those with the toxic one.
The largest gain of a document, calibrated on labelled rows, is its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titlesieve.llm.batches import add_columns, kept
from titlesieve.llm.textscan import LOWER, SLICE_BYTES
from titlesieve.sources.storage import materialise

#: Labelled rows of each kind that the model is fitted on (expected number).
TRAIN_ROWS = 10_000
#: Ordinary windows that the ordinary dictionary is trained on (expected number).
ORDINARY_WINDOWS = 200_000
#: Toxic windows that the toxic dictionary is trained on, those of most contexts first.
TOXIC_WINDOWS = 4_096
#: Different words before a window that make it one of the toxic sample, at least, and how
#: many times as frequent it is there as in ordinary texts. Copies of one text give a word
#: one context, however many they are.
LEAST_CONTEXTS, LEAST_RATIO = 8, 10.0
DICTIONARY_BYTES = 32_768
#: Bytes of a window; longer words are cut into pieces, each half over the one before.
WINDOW_BYTES = 64
THRESHOLD = 0.3
#: Gains that are remembered by a Python worker.
MOST_REMEMBERED = 200_000
#: Zstandard seeks no match in the last bytes of a block, and stores a block that saves
#: nothing as it is; a tail of zeros keeps both from hiding a gain.
_TAIL = bytes(40)
_LOWER = LOWER.tobytes()
_NO_WINDOW = -100


class ToxicityModel(NamedTuple):
    toxic: bytes  # dictionary
    ordinary: bytes  # dictionary
    gains: np.ndarray  # first gains of the steps of the calibration, ascending
    scores: np.ndarray  # their scores, ascending

    def score(self, gain: np.ndarray) -> np.ndarray:
        return self.scores[np.maximum(np.searchsorted(self.gains, gain, "right") - 1, 0)]


def windows(text: bytes) -> Iterator[list[bytes]]:
    """The windows of a whole text in order, A-Z in lower case, about 1 MB at a time."""
    at = 0
    while at < len(text):
        stop = at + SLICE_BYTES
        if stop < len(text):
            stop = max(text.rfind(b" ", at, stop), text.rfind(b"\n", at, stop)) + 1 or stop
        found = text[at:stop].translate(_LOWER).split()
        if found and max(map(len, found)) > WINDOW_BYTES:
            found = [piece for word in found for piece in _pieces(word)]
        yield found
        at = stop


def _pieces(word: bytes) -> list[bytes]:
    step = WINDOW_BYTES // 2
    return [word[i : i + WINDOW_BYTES] for i in range(0, max(len(word) - step, 1), step)]


class Gains:
    """Gains of windows under two dictionaries; those met last are remembered."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        parameters = zstandard.ZstdCompressionParameters(
            window_log=16, hash_log=12, chain_log=12, search_log=4, min_match=4,
            target_length=32, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0,
            write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        self.coders = [
            zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(
                    content, dict_type=zstandard.DICT_TYPE_RAWCONTENT
                ),
                compression_params=parameters,
            )
            for content in (ordinary, toxic)
        ]
        self.known: dict[bytes, int] = {}

    def largest(self, text: bytes) -> int:
        """The largest gain of a window of the text; ``_NO_WINDOW`` without any."""
        most = _NO_WINDOW
        for found in windows(text):
            distinct = set(found)
            new = [window for window in distinct if window not in self.known]
            if len(self.known) + len(new) > MOST_REMEMBERED:
                self.known.clear()
                new = list(distinct)
            for window in new:
                frame = b" " + window + b" " + _TAIL
                plain, toxic = (len(coder.compress(frame)) for coder in self.coders)
                self.known[window] = plain - toxic
            most = max(most, max(map(self.known.__getitem__, distinct), default=most))
        return most


def _gains(model: ToxicityModel) -> Gains:
    return kept(
        ("toxicity", crc32(model.toxic), crc32(model.ordinary)),
        lambda: Gains(model.toxic, model.ordinary),
    )


def _texts(column: pa.Array) -> Iterator[bytes]:
    for text in pc.fill_null(column.cast(pa.large_binary()), b""):
        yield text.as_py()


_CONTEXTS = "toxic int, window binary, before long"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, window, hash of the window before it) of the rows (toxic, text), thinned."""

    def out(seen: set) -> pa.RecordBatch:
        toxic, window, before = zip(*seen)
        return pa.RecordBatch.from_arrays(
            [pa.array(toxic, pa.int32()), pa.array(window, pa.binary()),
             pa.array(before, pa.int64())],
            names=["toxic", "window", "before"],
        )

    for batch in batches:
        seen: set[tuple[int, bytes, int]] = set()
        for toxic, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
            before = 0
            for found in windows(text):
                for window in found:
                    seen.add((toxic, window, before))
                    before = crc32(window)
                if len(seen) > MOST_REMEMBERED:
                    yield out(seen)
                    seen = set()
        if seen:
            yield out(seen)


def _train(samples: list[bytes], reach: int) -> bytes:
    """Dictionary content from samples, the most telling last; the trainer's, if it can."""
    try:
        content = zstandard.train_dictionary(DICTIONARY_BYTES, samples, d=6, k=reach).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer
        content = b""
    return content


def _toxic_dictionary(found: list[tuple[bytes, int]]) -> bytes:
    """The trained dictionary and the windows that the trainer lost, as it thins rare ones."""
    framed = [(b" " + window + b" ", n) for window, n in found]
    content = _train([window for window, n in framed for _ in range(min(n, 100))], 16)
    lost = [window for window, _ in reversed(framed) if window not in content]
    return (content + b"".join(lost))[-2 * DICTIONARY_BYTES :]


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """A model from the rows of ``labels`` (doc_id, toxic) and the whole texts of ``docs``.

    About ``train_rows`` rows of each label are used, drawn by a hash of the id, all where
    there are fewer; their ids are broadcast. Rows with a null label, id or text are not
    used; a repeated id counts as often as it occurs. The driver gets the windows of the
    two samples, whose numbers are bounded by parameters, and one count for each gain.
    Without a toxic row every score is 0, without an ordinary one it is 1.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    for kind in (1, 0):
        if kind not in sizes:
            return ToxicityModel(b"", b"", np.array([_NO_WINDOW]), np.array([1.0 - kind]))
    shares = {kind: min(1.0, train_rows / n) for kind, n in sizes.items()}
    share = F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)) / float(1 << 30) < share
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    rows = materialise(
        texts.join(F.broadcast(known.where(drawn)), "doc_id").select("toxic", "text"),
        "toxicity-rows",
    )
    contexts = materialise(rows.mapInArrow(_contexts, _CONTEXTS).distinct(), "toxicity-contexts")
    counts = contexts.groupBy("window").agg(
        F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("ordinary")
    )
    used = {kind: max(sizes[kind] * shares[kind], 1.0) for kind in sizes}
    telling = counts.where(
        (F.col("toxic") >= LEAST_CONTEXTS)
        & (F.col("toxic") / used[1] > LEAST_RATIO * (F.col("ordinary") + 0.5) / used[0])
    )
    top = telling.orderBy(F.desc("toxic"), "window").limit(TOXIC_WINDOWS).collect()
    found = [(bytes(r["window"]), r["toxic"]) for r in top]
    plain = contexts.where("toxic = 0")
    part = min(1.0, ORDINARY_WINDOWS / max(plain.count(), 1))
    taken = F.pmod(F.xxhash64("window", "before", F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    sample = plain.where(taken < part).orderBy("window", "before").select("window").toArrow()
    chosen = {window for window, _ in found}
    samples = [w for w in sample["window"].to_pylist() if w not in chosen]
    order = np.random.Generator(np.random.PCG64(13)).permutation(len(samples))
    ordinary = _train([b" " + samples[i] + b" " for i in order], 32)
    model = ToxicityModel(_toxic_dictionary(found), ordinary, np.zeros(1), np.zeros(1))
    scored = _largest_gains(rows, model, keep_text=False)
    table = scored.groupBy("gain", "toxic").agg(F.count("*").alias("n")).collect()
    return model._replace(**_calibrate([(r["gain"], r["toxic"], r["n"]) for r in table], shares))


def _calibrate(table: list[tuple[int, int, int]], shares: dict[int, float]) -> dict:
    """Shares of toxic rows by largest gain, pooled until they ascend with it."""
    gains = sorted({gain for gain, _, _ in table})
    steps: list[list[float]] = []  # first gain, toxic rows, all rows
    for gain in gains:
        n = {kind: sum(k for g, t, k in table if (g, t) == (gain, kind)) for kind in (0, 1)}
        steps.append([gain, n[1] / shares[1], n[1] / shares[1] + n[0] / shares[0]])
        while len(steps) > 1 and _share(steps[-2]) >= _share(steps[-1]):
            _, toxic, rows = steps.pop()
            steps[-1][1] += toxic
            steps[-1][2] += rows
    if not steps:
        steps = [[_NO_WINDOW, 0, 0]]
    return {
        "gains": np.array([step[0] for step in steps]),
        "scores": np.array([_share(step) for step in steps]),
    }


def _share(step: list[float]) -> float:
    return (step[1] + 0.1) / (step[2] + 1)


def _largest_gains(docs: DataFrame, model: ToxicityModel, keep_text: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        gains = _gains(shared.value)
        return [pa.array([gains.largest(text) for text in _texts(batch.column(at))], pa.int32())]

    return add_columns(docs, [("gain", T.IntegerType())], compute, () if keep_text else ("text",))


def score(docs: DataFrame, model: ToxicityModel, keep_text: bool = True) -> DataFrame:
    """``docs`` with toxicity_score (DOUBLE, 0 to 1, higher: toxic is likelier).

    Every window of every whole text is compressed with both dictionaries; a text without
    a word, or a null one, gets the score of the smallest gain. Equal texts have equal
    scores, rows stay as often as they occur, and an empty table gives none. Other columns
    stay, but a ``toxicity_score`` is replaced. ``keep_text`` False drops the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        gains = _gains(shared.value)
        largest = [gains.largest(text) for text in _texts(batch.column(at))]
        return [pa.array(shared.value.score(np.array(largest, np.int64)), pa.float64())]

    fields = [("toxicity_score", T.DoubleType())]
    return add_columns(docs, fields, compute, () if keep_text else ("text",))
