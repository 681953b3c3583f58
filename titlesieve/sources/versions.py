"""Tables kept as a snapshot and the changes after it, with a published current version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the files and folders that match a path pattern of the shared file system."""
    path, system = _file_system(spark, pattern)
    return sorted(found.getPath().getName() for found in system.globStatus(path) or ())


def holders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that hold the files and folders that match a path pattern."""
    path, system = _file_system(spark, pattern)
    return sorted({str(found.getPath().getParent()) for found in system.globStatus(path) or ()})


def publish(spark: SparkSession, folder: str, version: int) -> None:
    """Make ``version`` the current one of ``folder``, once all that it names is written.

    A marker is created, never changed, so a reader sees the version before or this one.
    """
    path, system = _file_system(spark, f"{folder}/_versions/v{version}")
    system.create(path, True).close()


def published(spark: SparkSession, folder: str) -> int | None:
    """The latest published version of ``folder``, None without any."""
    found = [int(name[1:]) for name in names(spark, f"{folder}/_versions/v*")]
    return max(found, default=None)


class VersionedTable:
    """Batches of rows in order; from time to time all of them are merged to a snapshot.

    ``path/snapshots/upto=5`` holds what batches up to 5 came to, ``path/after=5/batch=6``
    the rows of batch 6. The batches after a snapshot are in a folder of their own, so a
    reader lists and reads one snapshot and at most as many batches as there are between
    two of them, however long the table has been written. A batch that is stored again, as
    streams do after a failure, replaces itself; one that a snapshot holds is not stored.
    One writer at a time, as a streaming query is.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, partition: str | None = None):
        self.spark, self.path, self.schema, self.partition = spark, path, schema, partition

    def _after(self, version: int | None) -> str:
        return f"{self.path}/after={-1 if version is None else version}"

    def holds(self, batch: int) -> bool:
        """Whether the current snapshot has the rows of ``batch``."""
        version = published(self.spark, self.path)
        return version is not None and batch <= version

    def put(self, rows: DataFrame, batch: int) -> None:
        """Store the rows of ``batch``, unless a snapshot holds them."""
        version = published(self.spark, self.path)
        if version is None or batch > version:
            self._write(rows, f"{self._after(version)}/{BATCH}={batch}")

    def _write(self, rows: DataFrame, path: str) -> None:
        writer = rows.write.mode("overwrite")
        if self.partition is not None:
            writer = writer.partitionBy(self.partition)
        writer.parquet(path)

    def read(self, before: int | None = None) -> DataFrame:
        """Rows of the snapshot and of the batches after it (less than ``before``).

        ``batch`` is the number of the batch, for rows of the snapshot that of its last.
        """
        version = published(self.spark, self.path)
        full = f"{self.schema}, {BATCH} bigint"
        parts = []
        if version is not None:
            snapshot = self.spark.read.schema(self.schema).parquet(f"{self.path}/snapshots/upto={version}")
            parts.append(snapshot.withColumn(BATCH, F.lit(version).cast("bigint")))
        base = self._after(version)
        # A batch whose write did not end has no success marker yet.
        whole = [int(name.split("=")[1]) for name in self._whole(base)]
        paths = [f"{base}/{BATCH}={n}" for n in sorted(whole) if before is None or n < before]
        if paths:
            deltas = self.spark.read.schema(full).option("basePath", base).parquet(*paths)
            parts.append(deltas)
        if not parts:
            return self.spark.createDataFrame([], full)
        columns = self.spark.createDataFrame([], full).columns
        rows = parts[0].select(*columns)
        for part in parts[1:]:
            rows = rows.unionByName(part.select(*columns))
        return rows

    def _whole(self, base: str) -> list[str]:
        path, system = _file_system(self.spark, f"{base}/{BATCH}=*/_SUCCESS")
        return [found.getPath().getParent().getName() for found in system.globStatus(path) or ()]

    def compact(self, merged: DataFrame, batch: int) -> None:
        """Make ``merged``, what all batches up to ``batch`` come to, the snapshot."""
        self._write(merged, f"{self.path}/snapshots/upto={batch}")
        publish(self.spark, self.path, batch)

    def due(self, batch: int, every: int) -> bool:
        """Whether ``batch`` ends a stretch of ``every`` batches since the snapshot."""
        version = published(self.spark, self.path)
        return batch - (-1 if version is None else version) >= every
