"""Word frequencies over titles or whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titlesieve.functions.names import column
from titlesieve.functions.stopwords import STOP_WORDS
from titlesieve.functions.text import counted_words

# First occurrences are compared as one DECIMAL(38, 0), row id above and place below:
# any BIGINT and any place fit, and the aggregation keeps fixed-width buffers.
PLACES = 1 << 31


def word_counts(
    df: DataFrame, text: str, stop_words=STOP_WORDS, order: str = "row_id"
) -> DataFrame:
    """word, count and first (occurrence) of every counted word that is no stop word.

    ``stop_words`` is a list, or a DataFrame with a column ``word`` of any length.
    The explode is the widest point, so words are cut by pattern before it and
    counted in the map stage after it: one word making up a third of a corpus still
    leaves each task as one row. ``first`` is row id * 2**31 + place.
    """
    row = F.col(order).cast("bigint")
    places = df.select(row.alias("row"), F.posexplode(counted_words(column(text))).alias("place", "word"))
    if not isinstance(stop_words, DataFrame) and stop_words:
        places = places.where(~F.col("word").isin(*stop_words))
    first = F.expr(f"cast(cast(row as decimal(20, 0)) * {PLACES}BD + place as decimal(38, 0))")
    counts = places.groupBy("word").agg(F.count("*").alias("count"), F.min(first).alias("first"))
    if isinstance(stop_words, DataFrame):
        # After counting, so the join sees the vocabulary and not every occurrence.
        counts = counts.join(stop_words.select("word"), "word", "left_anti")
    return counts


def word_frequencies(
    df: DataFrame,
    text: str,
    top_n: int = 30,
    stop_words=STOP_WORDS,
    order: str = "row_id",
) -> DataFrame:
    """The ``top_n`` most frequent words; ties go to the word that occurs first."""
    ranked = word_counts(df, text, stop_words, order).orderBy(F.col("count").desc(), "first")
    return ranked.limit(max(top_n, 0)).select("word", "count")


def with_relative(frequencies: DataFrame) -> DataFrame:
    """Add ``relative``, the count as a percent of the largest, to a top-n report."""
    # The window has no partition: its input is a report of at most top_n rows.
    return frequencies.withColumn(
        "relative", F.col("count") * 100.0 / F.max("count").over(Window.partitionBy())
    )
