"""Running totals over a long series, spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titlesieve.sources.storage import materialise

BLOCK = 4096


def running_totals(df: DataFrame, key: str, values) -> DataFrame:
    """Replace each of ``values`` by its running total in the order of integer ``key``.

    One window over the whole series would be one task. Totals run within blocks of
    4,096 keys in parallel; the window over everything sees one row per block. The
    series is used twice and therefore stored, so that what it is made from, such as a
    count over a large table, runs once.
    """
    values = list(values)
    blocked = materialise(df, "series").withColumn("__block", F.expr(f"`{key}` div {BLOCK}"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocked.groupBy("__block")
        .agg(*[F.sum(value).alias(value) for value in values])
        .select(
            "__block",
            *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__before_{v}") for v in values],
        )
    )
    inside = Window.partitionBy("__block").orderBy(key)
    totals = {v: F.sum(v).over(inside) + F.col(f"__before_{v}") for v in values}
    return (
        blocked.join(carried, "__block")
        .withColumns(totals)
        .drop("__block", *[f"__before_{v}" for v in values])
    )
