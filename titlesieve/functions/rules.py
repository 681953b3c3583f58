"""Row rules for table loads. Each gives (reason, condition under which a row is bad)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from titlesieve.functions.text import is_blank


@dataclass(frozen=True)
class Rule:
    """A reason, and a condition that is true for rows to be refused."""

    reason: str
    broken: Column


def not_null(name: str) -> Rule:
    return Rule(f"{name} is null", F.col(name).isNull())


def not_blank(name: str) -> Rule:
    return Rule(f"{name} is blank", is_blank(F.col(name)))


def one_of(name: str, values) -> Rule:
    """Membership check. As in SQL, null passes; add ``not_null`` to refuse it."""
    return Rule(f"{name} not allowed", F.coalesce(~F.col(name).isin(*values), F.lit(False)))


def max_length(name: str, limit: int) -> Rule:
    return Rule(f"{name} too long", F.coalesce(F.char_length(F.col(name)) > limit, F.lit(False)))


def integer_range(name: str, raw: str) -> Rule:
    """A numeric text column ``raw`` whose whole part does not fit the INT ``name``."""
    number = F.when(F.col(raw).rlike(r"[0-9.]\s*$"), F.col(raw).try_cast("double"))
    return Rule(
        f"{name} out of range",
        F.coalesce(number.isNotNull() & ~F.isnan(number) & F.col(name).isNull(), F.lit(False)),
    )
