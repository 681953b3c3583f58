"""Benchmark decontamination by n-gram windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlesieve.llm.batches import apart
from titlesieve.llm.lookup import BROADCAST_IDS
from titlesieve.sources.storage import materialise

WINDOW = 10
#: The most windows that one broadcast holds: below 100 MB at 10 words of 16 bytes each.
BLOCK_WINDOWS = 200_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised_words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; none for null.

    ``lower`` is the same for texts of ASCII only and much faster than ``translate``.
    """
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(F.coalesce(lowered, F.lit("")), F.lit(_WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct anchor, place, words and item_ids of all windows of the items.

    A window is ``window`` consecutive words, or a whole shorter item that has words. Its
    anchor is its longest word, the first of several; ``place`` counts from 0. Equal
    windows of several items are one row with the sorted ids as strings.
    """
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), normalised_words(F.col("text")).alias("ws")
    ).where(F.size("ws") > 0)
    starts = items.select(
        "item_id",
        "ws",
        F.explode(F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1)))).alias("at"),
    )
    cut = starts.select("item_id", F.slice("ws", F.col("at"), F.lit(window)).alias("words"))
    lengths = F.transform("words", F.length)
    place = F.array_position(lengths, F.array_max(lengths)).cast("int") - 1
    return (
        cut.groupBy("words")
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
        .select(F.get("words", place).alias("anchor"), place.alias("place"), "words", "item_ids")
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """doc_id, text_hash, n_words, hits, items and n_hit of every row of ``docs``.

    ``hits`` are the starts and lengths of the occurring windows, in order; ``items`` the
    sorted ids, as strings, of the items they are from; ``n_hit`` counts words inside any
    of them. Null and empty texts have no words and no hits. Rows equal in id and text
    have equal results and each its own row; rows that share an id only are judged apart,
    by ``text_hash``. A null item id stands for no item, but its windows count as hits.
    Other columns are ignored; an empty benchmark leaves all rows without hits.

    One pass over the texts: words are exploded and joined with the broadcast windows by
    anchor word, and a match is kept where the words around it equal the window's. Only
    hits, and one row per document, are shuffled. The windows are counted first; beyond
    ``block_windows`` they are dealt into blocks, with one pass for each.
    """
    windows = benchmark_windows(benchmark, window)
    blocks = max(1, -(-windows.count() // block_windows))
    # The row after the last word: it holds the number of words of the document.
    end = windows.sparkSession.range(1).select(
        F.lit("").alias("anchor"),
        F.lit(0).alias("place"),
        F.array(F.lit("")).alias("words"),
        F.array().cast("array<string>").alias("item_ids"),
    )
    words = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.array_append(normalised_words(F.col("text")), F.lit("")).alias("ws"),
    ).select("doc_id", "text_hash", "ws", F.posexplode("ws").alias("at", "word"))

    def found(block: int) -> DataFrame:
        part = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block)
        part = part.unionByName(end) if block == 0 else part
        start = F.col("at") - F.col("place")
        same = F.slice("ws", start + 1, F.size("words")) == F.col("words")
        return (
            words.join(F.broadcast(part), F.col("word") == F.col("anchor"))
            .where((start >= 0) & same)
            .select("doc_id", "text_hash", start.alias("start"), F.size("words").alias("length"),
                    (F.col("word") == "").alias("is_end"), "item_ids")
        )

    hits = found(0)
    for block in range(1, blocks):
        hits = hits.unionByName(found(block))
    key = Window.partitionBy("doc_id", "text_hash")
    before = key.orderBy("is_end", "start", "length").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("start") + F.col("length")
    reached = F.coalesce(F.max(F.when(~F.col("is_end"), stop)).over(before), F.lit(0))
    new = F.when(
        ~F.col("is_end"), F.greatest(stop - F.greatest(reached, F.col("start")), F.lit(0))
    )
    hit = ~F.col("is_end")
    result = (
        hits.withColumn("new", new)
        .groupBy("doc_id", "text_hash")
        .agg(
            F.count_if("is_end").cast("int").alias("copies"),
            F.max(F.when(F.col("is_end"), F.col("start"))).cast("long").alias("n_words"),
            F.sort_array(F.collect_set(F.when(hit, F.struct("start", "length")))).alias("hits"),
            F.array_sort(
                F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("item_ids")))))
            ).alias("items"),
            F.coalesce(F.sum("new"), F.lit(0)).cast("long").alias("n_hit"),
        )
    )
    return result.withColumn(
        "__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    ).drop("copies", "__copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows in which a window of ``benchmark`` occurs; all its columns.

    Same rules as :func:`contamination`. The contaminated ids and text hashes are stored;
    they are broadcast while they are few, and joined by a shuffle beyond that. Columns
    of any name may be there.
    """
    return apart(docs, ("doc_id", "text"), lambda plain: _decontaminate(plain, benchmark, window))


def _decontaminate(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    bad = materialise(
        contamination(docs, benchmark, window)
        .where("n_hit > 0")
        .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
        .distinct(),
        "contaminated",
    )
    small = bad.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    return docs.join(F.broadcast(bad) if small else bad, same, "left_anti")
