"""Fetching the rows of some ids from a large table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids that are broadcast at most: 16 MB of BIGINT, about 100 MB as a hash table.
BROADCAST_IDS = 2_000_000


def rows_of(table: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows of ``table`` whose ``key`` is in ``ids``, a stored table of that column.

    With ``how`` "left_anti" those whose key is not; a null key is in no table.

    Up to BROADCAST_IDS ids are sent to the tasks that scan the table; more are joined by
    a shuffle of both sides.
    """
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return table.join(F.broadcast(ids) if small else ids, key, how)
