"""Columns by any name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """The column of that name, which may hold dots, spaces and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")
