"""Pages of a result in row order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titlesieve.operators.filters import search
from titlesieve.operators.positions import with_positions

# A top-k brings offset + limit whole rows to the driver. Deeper pages first look up
# where they start.
SHALLOW_ROWS = 1000
_STEPS = 1024


def _seek(df: DataFrame, order: str, skip: int, take: int) -> tuple[int, int, int] | None:
    """``(least id, greatest id, rows to skip between them)`` for a page.

    Each round counts rows in 1,024 equal ranges of the ids left and goes on in the
    range where the page starts, until that range is small. Ids are unique, so it
    ends after a few rounds whatever their distribution, and only the id column
    (and what a search needs) is read. Both bounds reach the scan of the page itself.
    """
    low, high = df.agg(F.min(order), F.max(order)).first()
    stop = high
    while low is not None:
        width = (high - low) // _STEPS + 1
        counts = (
            df.where(F.col(order).between(low, high))
            # As decimals: ids may lie more than a BIGINT apart.
            .groupBy(F.expr(f"(cast(`{order}` as decimal(20, 0)) - {low}BD) div {width}BD").alias("step"))
            .agg(F.count("*").alias("rows"))
        )
        start = None
        seen = 0
        # At most 1,024 rows reach the driver, whatever the size of the table.
        for step, rows in sorted((row.step, row.rows) for row in counts.collect()):
            if start is None and skip < seen + rows:
                start, rows_there, before = step, rows, seen
            seen += rows
            if seen >= skip + take:
                stop = min(high, low + (step + 1) * width - 1)
                break
        if start is None:
            return None
        low, high = low + start * width, min(high, low + (start + 1) * width - 1)
        skip -= before
        if rows_there <= SHALLOW_ROWS or width == 1:
            return low, stop, skip
    return None


def page(
    df: DataFrame,
    page: int = 0,
    per_page: int = 50,
    search_for: str = "",
    mode: str = "regex",
    order: str = "row_id",
) -> DataFrame:
    """Rows ``[page * per_page, (page + 1) * per_page)`` by ``order``, after a search.

    Null order values come first, as in any sort. Deep pages by an integer column without
    nulls seek their ids; by any other column the rows are sorted and numbered once. Both
    run jobs when this function is called.
    """
    if page < 0 or per_page < 0:
        raise ValueError("page and per_page must not be negative")
    found, skip = search(df, search_for, mode), page * per_page
    if skip + per_page > SHALLOW_ROWS:
        whole = isinstance(df.schema[order].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        if not whole or not found.where(F.col(order).isNull()).isEmpty():
            numbered = with_positions(found, order, name="__place")
            inside = (F.col("__place") >= skip) & (F.col("__place") < skip + per_page)
            return numbered.where(inside).orderBy("__place").drop("__place")
        bounds = _seek(found, order, skip, per_page)
        if bounds is None:
            return found.limit(0)
        low, high, skip = bounds
        found = found.where(F.col(order).between(low, high))
    return found.orderBy(order).offset(skip).limit(per_page)


def page_info(df: DataFrame, page: int = 0, per_page: int = 50) -> DataFrame:
    """One row: total, page, per_page, total_pages, has_previous, has_next."""
    pages = F.ceil(F.col("total") / F.lit(per_page)).cast("bigint")
    return df.agg(F.count("*").alias("total")).select(
        "total",
        F.lit(page).alias("page"),
        F.lit(per_page).alias("per_page"),
        pages.alias("total_pages"),
        F.lit(page > 0).alias("has_previous"),
        (F.lit(page + 1) < pages).alias("has_next"),
    )
