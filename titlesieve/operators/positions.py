"""Dense numbering of rows in a total order, spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlesieve.functions.names import column
from titlesieve.sources.storage import materialise, spread


def with_positions(
    df: DataFrame, *order: str | Column, name: str = "pos", cache: bool = False
) -> DataFrame:
    """Add ``name`` = 0, 1, 2, ... in the order given, which must have no ties.

    An unpartitioned ``row_number`` would put all rows in one task. Here the rows
    are range-sorted, so any hot key is cut into several partitions, and stored
    with their partition and place in it. The storage matters: the bounds of a
    range sort come from a sample, so counting partitions in one run and numbering
    rows in another could disagree. What is broadcast has one row per partition.

    A range sort reads its input twice, first for the sample. ``cache`` keeps the input
    for the second time and is worth it for anything dearer than a scan.
    """
    if cache:
        df = df.persist()
    part, at = f"__{name}_part", f"__{name}_at"
    stored = materialise(
        df.orderBy(*order)
        .withColumn(part, F.spark_partition_id())
        .withColumn(at, F.monotonically_increasing_id()),
        "positions",
    )
    if cache:
        df.unpersist()
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        stored.groupBy(part)
        .agg(F.count("*").alias("rows"), F.min(at).alias("first"))
        .select(
            part,
            (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        )
    )
    return (
        stored.join(F.broadcast(starts), part)
        .withColumn(name, F.col(at) + F.col("shift"))
        .drop(part, at, "shift")
    )


def number_scanned_rows(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Add dense ids in file order to rows just read from files.

    Spark packs small files into scan tasks by size, so the task number does not
    follow file order. Rows are counted per file split, which is contiguous in its
    task, and the splits are then put in order of path and offset. ``df`` must hold
    the scan's ``_metadata`` and no filter may have run on it.
    """
    columns = [column(name) for name in df.columns if name != "_metadata"]
    scanned = materialise(
        df.select(
            *columns,
            F.col("_metadata.file_path").alias("__file"),
            F.col("_metadata.file_block_start").alias("__block"),
            F.monotonically_increasing_id().alias("__at"),
        ),
        "scan",
    )
    stored = spread(scanned)
    splits = stored.groupBy("__file", "__block").agg(
        F.count("*").alias("rows"), F.min("__at").alias("first")
    )
    # One row per file split goes through this window, never one per record.
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        "__file",
        "__block",
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
    )
    return stored.join(starts, ["__file", "__block"]).select(
        (F.col("__at") + F.col("shift")).alias(row_id), *columns
    )
