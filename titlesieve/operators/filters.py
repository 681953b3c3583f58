"""Row filters over the base table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlesieve.functions.names import column
from titlesieve.functions.text import (
    bind, exclude, include_all, include_any, length_between, parse_keywords,
)
from titlesieve.operators.columns import find_title_column


@dataclass(frozen=True)
class FilterSpec:
    """What a screening filter asks for. It always applies to the base table."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    match_all: bool = False
    min_words: int = 0
    max_words: int = 100

    def __post_init__(self):
        if self.min_words is None or self.max_words is None:
            raise ValueError("word bounds must be numbers")

    @classmethod
    def from_text(cls, include: str = "", exclude: str = "", **rest) -> FilterSpec:
        """From keyword boxes with one keyword per line."""
        return cls(parse_keywords(include), parse_keywords(exclude), **rest)

    def predicate(self, text: Column) -> Column:
        """Include and exclude only if given, length always: null text never passes."""

        def passes(title: Column) -> Column:
            tests = [length_between(title, self.min_words, self.max_words)]
            if self.exclude:
                tests.insert(0, exclude(title, self.exclude))
            if self.include:
                tests.insert(0, (include_all if self.match_all else include_any)(title, self.include))
            return reduce(and_, tests)

        # The null test stands apart so that it reaches the scan.
        return text.isNotNull() & bind(text, passes)


def apply_filter(df: DataFrame, spec: FilterSpec, title: str | None = None) -> DataFrame:
    """Rows of the base table ``df`` that pass ``spec``."""
    return df.where(spec.predicate(column(title or find_title_column(df))))


def _checked_pattern(df: DataFrame, term: str) -> str:
    pattern = f"(?iu){term}"
    try:
        df.sparkSession.sql("SELECT rlike('', :pattern)", args={"pattern": pattern}).first()
    except PySparkException as error:
        raise ValueError(f"bad search pattern: {term!r}") from error
    return pattern


def search_predicate(df: DataFrame, term: str, mode: str = "regex", title: str | None = None) -> Column:
    """Case-insensitive search condition; an empty term lets everything through."""
    if mode not in ("regex", "literal"):
        raise ValueError("mode must be 'regex' or 'literal'")
    if not term:
        return F.lit(True)
    text = column(title or find_title_column(df))
    if mode == "literal":
        return include_any(text, [term])
    return text.isNotNull() & text.rlike(_checked_pattern(df, term))


def search(df: DataFrame, term: str, mode: str = "regex", title: str | None = None) -> DataFrame:
    """Rows whose title matches a pattern, or contains a text with ``mode='literal'``."""
    return df.where(search_predicate(df, term, mode, title)) if term else df


def _id_frame(df: DataFrame, ids, key: str) -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids.select(key)
    return df.sparkSession.createDataFrame([(i,) for i in ids], f"{key} {df.schema[key].dataType.simpleString()}")


def remove_rows(df: DataFrame, ids, strict: bool = True, key: str = "row_id") -> DataFrame:
    """``df`` without the rows named. With ``strict`` an unknown id is an error.

    An anti join at every length of the list, whose strategy is left to the sizes that
    Spark sees. A null id names no row, and a row with a null id stays.
    """
    if not isinstance(ids, DataFrame):
        ids = list(ids)
        if not ids:
            return df
    if strict:
        unknown = _id_frame(df, ids, key).join(df.select(key), key, "left_anti").first()
        if unknown is not None:
            raise KeyError(f"no row with {key} {unknown[0]}")
    return df.join(_id_frame(df, ids, key), key, "left_anti")


def removal_report(df: DataFrame, ids: DataFrame, key: str = "row_id") -> DataFrame:
    """One row: ids requested, rows removed, rows remaining."""
    asked = ids.select(key).withColumn("asked", F.lit(1))
    requested = asked.groupBy(key).agg(F.sum("asked").alias("requested"))
    matched = df.select(key, F.lit(1).alias("present")).join(requested, key, "full_outer")
    return matched.agg(
        F.coalesce(F.sum("requested"), F.lit(0)).cast("bigint").alias("requested"),
        F.count_if(F.col("requested").isNotNull() & F.col("present").isNotNull()).alias("removed"),
        F.count_if(F.col("requested").isNull()).alias("remaining"),
    )


def reset_filters(base: DataFrame) -> DataFrame:
    """Filters hold no state: resetting gives the base table itself."""
    return base


def split_by_decision(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept, rejected)``; rows without a verdict are in neither."""
    return df.where(F.col("nlp_decision") == "keep"), df.where(F.col("nlp_decision") == "reject")
