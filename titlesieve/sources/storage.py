"""Shared scratch storage: written tables that cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the session's ``spark.checkpoint.dir``.

    Without that setting it is under the warehouse, which executors share as well.
    """
    base = (
        spark.conf.get(_SETTING, None)
        or spark.sparkContext.getCheckpointDir()
        or spark.conf.get("spark.sql.warehouse.dir")
    )
    return f"{base.rstrip('/')}/titlesieve/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back; everything after starts from the files."""
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a scan of few files over all cores, for work that outweighs moving them.

    A file without splits, such as a CSV with line breaks in cells or a Parquet file of
    one row group, is one task however many cores there are. A scan that has a task for
    every core already, as any large one has, is returned as it is. ``scan`` must be a
    plain read: to count the tasks of anything else, Spark would have to run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
