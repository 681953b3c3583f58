"""Several unique keys at once, as an insert of one row after the other would keep them."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlesieve.sources.storage import materialise

#: Open rows that are decided by a plain walk on the driver, which ends long chains of
#: rows that share one key with the row before and another with the row after.
WALKED_ROWS = 10_000


def accept_in_order(rows: DataFrame, keys: list[str], row: str = "row_id") -> DataFrame:
    """``row`` and ``keys`` of the rows that an insert in the order of ``row`` accepts.

    A row is accepted if no row accepted before it has one of its keys. A refused row
    blocks no later one, so a key cannot be checked after the other: whether a row is
    refused for its second key decides whether its first one stays free. Null keys never
    clash; ``row`` is unique and not null.

    In each round the rows that come first among the open ones by every one of their keys
    are accepted, and the open rows that share a key with them are refused. The least open
    row is always accepted, so rounds end; a key that a third of all rows share is settled
    by its first row. First rows are aggregated before the shuffle and matched by their
    own id, and accepted rows have each key once, so long sides of the joins can be split.
    """
    open_rows = materialise(rows.select(row, *keys), "open-rows")
    accepted = open_rows.limit(0)
    needed = reduce(add, [F.col(key).isNotNull().cast("int") for key in keys])
    while True:
        rest = open_rows.limit(WALKED_ROWS + 1).count()
        if rest <= WALKED_ROWS:
            return accepted.unionByName(_walk(open_rows, keys, row)) if rest else accepted
        firsts = [
            open_rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias(row)).select(row)
            for key in keys
        ]
        wins = reduce(DataFrame.unionByName, firsts).groupBy(row).agg(F.count("*").alias("__wins"))
        first = F.coalesce(F.col("__wins"), F.lit(0)) == needed
        taken = materialise(
            open_rows.join(wins, row, "left").where(first).select(row, *keys), "accepted-rows"
        )
        left = open_rows.join(taken.select(row), row, "left_anti")
        for key in keys:
            used = taken.where(F.col(key).isNotNull()).select(key)
            left = left.join(used, key, "left_anti").select(row, *keys)
        accepted = accepted.unionByName(taken)
        open_rows = materialise(left, "open-rows")


def _walk(open_rows: DataFrame, keys: list[str], row: str) -> DataFrame:
    used: list[set] = [set() for _ in keys]
    taken = []
    for cells in sorted(open_rows.select(row, *keys).collect(), key=lambda cells: cells[0]):
        if not any(cell in seen for cell, seen in zip(cells[1:], used)):
            taken.append(tuple(cells))
            for cell, seen in zip(cells[1:], used):
                if cell is not None:
                    seen.add(cell)
    return open_rows.sparkSession.createDataFrame(taken, open_rows.schema)
