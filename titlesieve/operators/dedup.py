"""Duplicate removal with a defined survivor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titlesieve.functions.names import column
from titlesieve.operators.columns import find_title_column


def _keys(df: DataFrame, subset) -> list[str]:
    if subset is None:
        return [find_title_column(df)]
    return [subset] if isinstance(subset, str) else list(subset)


def remove_duplicates(df: DataFrame, subset=None, keep="first", order: str = "row_id") -> DataFrame:
    """One row per key: the first or last by ``order``, or with ``keep=False`` none of
    a repeated key. Keys compare exactly and nulls are equal to each other.

    First / last: the rank filter is applied before the shuffle too, so a key that
    holds a third of all rows sends one row per task. None: copies are merged in
    the map stage for the same reason.
    """
    keys = _keys(df, subset)
    quoted = [column(key) for key in keys]
    if keep in ("first", "last"):
        by = F.col(order) if keep == "first" else F.col(order).desc()
        window = Window.partitionBy(*quoted).orderBy(by)
        return df.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")
    if keep is not False:
        raise ValueError("keep must be 'first', 'last' or False")
    row = F.struct(*[column(name) for name in df.columns])
    return (
        df.groupBy(*quoted)
        .agg(F.count("*").alias("__copies"), F.min_by(row, order).alias("__row"))
        .where("__copies = 1")
        .select("__row.*")
    )


def duplicate_report(df: DataFrame, subset=None, keep="first") -> DataFrame:
    """One row: original, removed, remaining. Reads the key columns only."""
    per_key = df.groupBy(*[column(key) for key in _keys(df, subset)]).agg(
        F.count("*").alias("copies")
    )
    kept = F.count_if(F.col("copies") == 1) if keep is False else F.count("*")
    return per_key.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("original"), kept.alias("remaining")
    ).select("original", (F.col("original") - F.col("remaining")).alias("removed"), "remaining")
