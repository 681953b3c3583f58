"""Token ids of whole documents in wavelet-matrix shards."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titlesieve.llm import textscan
from titlesieve.llm.batches import kept
from titlesieve.llm.idstore import IdStore
from titlesieve.llm.textscan import text_slices
from titlesieve.llm.wavelet import WaveletFile, pack

END_ID = 2
#: Tokens after which a task closes a shard at the next end of a document.
SHARD_TOKENS = 4_000_000
#: New pieces that are encoded as one text, at most.
JOINED = 64

_SPACE = np.arange(256) == 0x20
_BLANK = np.arange(256) <= 0x20


class PieceEncoder:
    """Ids of whole texts, encoded piece by piece with the tokenizers library.

    A text is cut before a space that follows something other than white space. The
    byte-level pre-tokeniser starts a new word at exactly such a place whatever stands
    around it, so the ids of the pieces together are those of the text; and pieces recur,
    so each is encoded once.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.store = IdStore(self._encode)
        vocabulary_ids = self.tokenizer.get_vocab(with_added_tokens=True)
        added = {token.content for token in self.tokenizer.get_added_tokens_decoder().values()}
        self.added = sorted(added)
        # Bytes that each id stands for: a byte-level token has one letter for each.
        self.id_bytes = np.zeros(max(vocabulary_ids.values(), default=0) + 1, np.int64)
        for token, i in vocabulary_ids.items():
            self.id_bytes[i] = len(token.encode()) if token in added else len(token)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their number for each.

        Texts that begin with a space and end without one are encoded many at a time as
        one text, in which each still begins a new word; the bytes of the ids say where
        its own ids end.
        """
        alone = np.array([t[:1] != " " or t[-1:].isspace() for t in texts], bool)
        for mark in self.added:
            if mark in "".join(texts):
                alone |= np.array([mark in t for t in texts], bool)
        rest = [t for t, one in zip(texts, alone) if not one]
        joined = self._one_by_one(["".join(rest[i : i + JOINED]) for i in range(0, len(rest), JOINED)])
        flat = np.concatenate([np.zeros(0, np.uint32), *joined])
        ends = np.cumsum([len(t.encode()) for t in rest], dtype=np.int64)
        covered = np.concatenate([[0], np.cumsum(self.id_bytes[flat])])
        cuts = np.minimum(np.searchsorted(covered, ends), len(flat))
        if not np.array_equal(covered[cuts], ends) or (len(ends) and ends[-1] != covered[-1]):
            alone[:], flat, cuts = True, flat[:0], cuts[:0]
        single = self._one_by_one([t for t, one in zip(texts, alone) if one])
        sizes = np.zeros(len(texts), np.int64)
        sizes[~alone] = np.diff(cuts, prepend=0)
        sizes[alone] = list(map(len, single))
        at = np.zeros(len(texts), np.int64)
        at[~alone] = np.cumsum(sizes[~alone]) - sizes[~alone]
        at[alone] = len(flat) + np.cumsum(sizes[alone]) - sizes[alone]
        return np.concatenate([flat, *single])[textscan.ragged(at, sizes)], sizes

    def _one_by_one(self, texts: list[str]) -> list[np.ndarray]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in coded]

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        cut = _SPACE[data]
        cut[:1] = False
        cut[1:] &= ~_BLANK[data[:-1]]
        # No cut after a character that may be white space beyond ASCII.
        wide = (data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)
        cut[2:] &= data[:-2] != 0xC2
        cut[3:] &= ~wide[:-3]
        return cut

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows with END_ID after each, and the number of ids of each row."""
        cut = self._cuts(data)
        filled = np.diff(offsets) > 0
        cut[offsets[:-1][filled]] = True
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], len(data))
        sums = textscan.prefix_hash(textscan._BYTES[data])
        hashes = textscan.span_hash(sums, start, stop)
        hashes, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        raw, begin, end = data.tobytes(), start[first], stop[first]
        places = self.store.find(
            hashes, lambda i: raw[begin[i] : end[i]].decode("utf-8", "replace"), (data, begin, end)
        )
        own = stop - start
        alike = own == own[first][inverse]
        if (
            (places >= 0).all()
            and alike.all()
            and textscan.equal_spans(data, start, data, begin[inverse], own).all()
        ):
            ids, sizes = self.store.ids(places[inverse])
        else:  # two pieces share a hash: no piece of this slice is looked up
            pieces = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), stop.tolist())]
            ids, sizes = self._encode(pieces)
        bounds = np.searchsorted(start, offsets)
        total = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        return np.insert(ids, total[1:], END_ID), np.diff(total) + 1


def write_shards(
    docs: DataFrame, vocabulary: str, path: str, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Write the token ids of ``docs`` (doc_id, text) as wavelet-matrix images to ``path``.

    ``vocabulary`` is the JSON text of a byte-level tokenizer. Documents go in ascending
    doc_id, null ids first, equal ids by text; a null text is empty and has the end id
    only. The output is a Parquet table of (shard, tokens, image), written by Spark's
    committer, so a task that is lost and run again leaves no second copy, on any storage
    that Spark can write. Each image is complete in itself, see ``wavelet``. Shard numbers
    ascend with the documents. Other columns are ignored; an empty table writes no image.

    A task streams its range of ids and holds one shard: ``shard_tokens`` and the rest of
    one document.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = shared.value
        encoder = kept(("pieces", zlib.crc32(text.encode())), lambda: PieceEncoder(text))
        part = TaskContext.get().partitionId()
        held: list[list[np.ndarray]] = [[], [], [], []]
        number = 0

        def image() -> pa.RecordBatch:
            tokens, ids, nulls, counts = (np.concatenate(x) for x in held)
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number]), pa.array([len(tokens)]),
                 pa.array([pack(tokens, ids, nulls, counts)], pa.binary())],
                names=["shard", "tokens", "image"],
            )

        size = 0
        for batch in batches:
            all_ids = pc.fill_null(batch.column(0), 0).to_numpy()
            all_nulls = pc.is_null(batch.column(0)).to_numpy(zero_copy_only=False)
            for first, after, data, offsets in text_slices(batch.column(1)):
                tokens, counts = encoder.encode(data, offsets)
                ends, row, token = np.cumsum(counts), 0, 0
                while row < len(counts):
                    # Rows up to the one that fills the shard.
                    stop = int(np.searchsorted(ends, token + shard_tokens - size)) + 1
                    stop = min(stop, len(counts))
                    rows = slice(first + row, first + stop)
                    for x, new in zip(
                        held,
                        (tokens[token : ends[stop - 1]], all_ids[rows], all_nulls[rows], counts[row:stop]),
                    ):
                        x.append(new)
                    size += int(ends[stop - 1]) - token
                    row, token = stop, int(ends[stop - 1])
                    if size >= shard_tokens:
                        yield image()
                        number, size = number + 1, 0
        if held[1]:
            yield image()

    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(build, "shard long, tokens long, image binary").write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (ARRAY<INT>) of every document in the shards."""
    return _read(spark, path, with_ids=True)


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the shards.

    ``start`` counts the ids of all documents before it. Decoded whole from the images.
    """
    return _read(spark, path, with_ids=False)


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    shards = spark.read.parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select(
        F.col("shard").alias("__shard"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("__before"),
    )

    def open_images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, image in zip(batch.column(0).to_pylist(), batch.column(1)):
                file = WaveletFile(image.as_buffer().to_pybytes())
                tokens = file.tokens().astype("<u4")
                ends = np.cumsum(file.counts)
                begins = ends - file.counts
                raw = memoryview(tokens).cast("B")
                if with_ids:
                    last = pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                        pa.array(tokens.view(np.int32)),
                    )
                else:
                    last = pa.array(
                        [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())],
                        pa.int64(),
                    )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(ends), pa.int64()), pa.array(file.doc_ids, mask=file.nulls),
                     pa.array(begins), pa.array(file.counts), last],
                    names=["__shard", "doc_id", "__within", "n_tokens", kind.split()[0]],
                )

    kind = "ids array<int>" if with_ids else "ids_crc32 long"
    found = shards.select("shard", "image").mapInArrow(
        open_images, f"__shard long, doc_id long, __within long, n_tokens long, {kind}"
    )
    # One row per shard on the right: Spark broadcasts it only if it measures it as small.
    return found.join(starts, "__shard").select(
        "doc_id",
        (F.col("__before") + F.col("__within")).alias("start"),
        "n_tokens",
        kind.split()[0],
    )
