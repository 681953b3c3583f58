"""Row-wise functions over Arrow batches that keep the rows' other columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from titlesieve.functions.names import column


#: Rows that are computed and handed on at a time, and bytes of them where stages share executors.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1_024, 1 << 19


def give_back() -> None:
    """Return freed memory to the system, which Arrow and the C library keep for later use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def map_batches(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    """``df.mapInArrow(run, schema)``; a worker that waits for its next task holds no freed memory."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def add_columns(
    df: DataFrame,
    fields: list[tuple[str, T.DataType]],
    compute: Callable[[pa.RecordBatch], list[pa.Array]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """``df`` without ``drop`` and with new columns, one array for each of ``fields``.

    ``compute`` gets each batch of ``df`` and returns one array per field, as long as the
    batch. A column of ``df`` that has the name of a new one is replaced.
    """
    names = [name for name, _ in fields]
    kept = [f for f in df.schema.fields if f.name not in names and f.name not in drop]
    schema = T.StructType(kept + [T.StructField(name, kind) for name, kind in fields])
    positions = [df.columns.index(f.name) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                arrays = [batch.column(i) for i in positions] + compute(batch)
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return map_batches(df.select(*map(column, df.columns)), run, schema)


def apart(
    docs: DataFrame, used: tuple[str, ...], work: Callable[[DataFrame], DataFrame], new: tuple[str, ...] = ()
) -> DataFrame:
    """``work(docs)``, in which no column but those ``used`` can clash with a name of its own.

    The others have neutral names meanwhile. Columns of ``docs`` that have the name of a
    ``new`` one are replaced by it; the order of columns stays, new ones come last.
    """
    kept_names = [name for name in docs.columns if name not in new]
    hidden = {name: name if name in used else f"__other{i}" for i, name in enumerate(kept_names)}
    result = work(docs.select(*[column(name).alias(hidden[name]) for name in kept_names]))
    return result.select(*[column(hidden[name]).alias(name) for name in kept_names], *new)


_KEPT: dict = {}


def kept(key, make: Callable):
    """What ``make`` gave for ``key``, kept by this Python worker for its later tasks.

    One thing at a time is kept, so a worker's memory is bounded by the largest of them.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]
