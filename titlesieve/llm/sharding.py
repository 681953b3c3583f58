"""Proportional stratified interleaving into shards, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlesieve.operators.positions import with_positions
from titlesieve.sources.storage import materialise

ROW_OVERHEAD = 8
_KEY = ("doc_id", "text_crc32", "size")


def interleave(
    docs: DataFrame, shards: int = 24, seed: int = 17, stratum: str = "source"
) -> DataFrame:
    """doc_id, source, size, text_crc32, fraction, position, shard and slot of every row.

    Rows of one stratum are put in a seeded random order and ranked; the fraction of a row
    is (rank + 1/2) / rows of its stratum. All rows sorted by fraction are the interleaved
    order, so any stretch of it has the mixture of the whole. It is cut where
    floor(position * shards / rows) changes: shard sizes differ by one row at most.
    ``slot`` counts from 0 inside a shard.

    ``size`` is the UTF-8 bytes of the text plus 8, ``text_crc32`` the unsigned CRC of
    those bytes; a null text has none. Null strata form one stratum, null ids come first.
    Ties of the random order are cut by id, then checksum, then size; rows equal in all of
    them are interchangeable and each keeps its own slot. Other columns are ignored. An
    empty table gives no rows, fewer rows than shards leave shards empty.

    Ranks come from two range sorts of narrow rows, not from a window per stratum: a
    stratum with a third of all rows is cut into many tasks like any other stretch. Both
    sorts run when this function is called.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(
        docs.select(
            "doc_id",
            F.col(stratum).alias("source"),
            (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(F.lit(seed), F.col("doc_id")).alias("__shuffled"),
        ),
        "shard-rows",
    )
    ranked = with_positions(rows, "source", "__shuffled", *_KEY, name="__pos")
    strata = ranked.groupBy(F.col("source").alias("__stratum")).agg(
        F.min("__pos").alias("__first"), F.count("*").alias("__rows")
    )
    fractions = ranked.join(strata, F.col("source").eqNullSafe(F.col("__stratum"))).select(
        "source",
        *_KEY,
        ((F.col("__pos") - F.col("__first") + 0.5) / F.col("__rows")).alias("fraction"),
    )
    total = rows.count()
    placed = with_positions(fractions, "fraction", "source", *_KEY, name="position")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn(
        "shard", F.expr(f"cast(position * {shards} div {max(total, 1)} as int)")
    ).withColumn("slot", F.col("position") - first)
