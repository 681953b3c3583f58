"""Counts and shares. Each report is one pass over the columns it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cost and seconds per row, low and high.
COST_PER_ROW = (0.003, 0.01)
SECONDS_PER_ROW = (0.5, 1.0)


def _percent(part: Column, whole: Column) -> Column:
    """Null for an empty whole."""
    return F.try_divide(part * 100.0, whole)


def dataset_stats(original: DataFrame, current: DataFrame) -> DataFrame:
    """One row: original_count, current_count, removed, removal_rate (percent), columns."""
    marks = original.select(F.lit(1).alias("o"), F.lit(0).alias("c")).unionAll(
        current.select(F.lit(0), F.lit(1))
    )
    counts = marks.agg(
        F.coalesce(F.sum("o"), F.lit(0)).cast("bigint").alias("original_count"),
        F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("current_count"),
    )
    removed = F.col("original_count") - F.col("current_count")
    return counts.select(
        "original_count",
        "current_count",
        removed.alias("removed"),
        _percent(removed, F.col("original_count")).alias("removal_rate"),
        F.array(*[F.lit(name) for name in current.columns if name != "row_id"]).alias("columns"),
    )


def filter_stats(df: DataFrame, predicate: Column) -> DataFrame:
    """One row: total, filtered, removed. The filter is evaluated, not applied."""
    return df.agg(F.count("*").alias("total"), F.count_if(predicate).alias("filtered")).select(
        "total", "filtered", (F.col("total") - F.col("filtered")).alias("removed")
    )


def _decision_counts(name: str = "nlp_decision") -> tuple[Column, Column]:
    decision = F.col(name)
    return F.count_if(decision == "keep"), F.count_if(decision == "reject")


def decision_counts(df: DataFrame) -> DataFrame:
    """One row: keep, reject."""
    keep, reject = _decision_counts()
    return df.agg(keep.alias("keep"), reject.alias("reject"))


def decision_shares(df: DataFrame) -> DataFrame:
    """One row: total, keep, reject, and percents of all rows, undecided included."""
    keep, reject = _decision_counts()
    counts = df.agg(F.count("*").alias("total"), keep.alias("keep"), reject.alias("reject"))
    return counts.select(
        "*",
        _percent(F.col("keep"), F.col("total")).alias("keep_percent"),
        _percent(F.col("reject"), F.col("total")).alias("reject_percent"),
    )


def confidence_breakdown(df: DataFrame) -> DataFrame:
    """Confidence counts of kept rows, most frequent first; nulls left out."""
    return (
        df.where((F.col("nlp_decision") == "keep") & F.col("nlp_confidence").isNotNull())
        .groupBy("nlp_confidence")
        .agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), "nlp_confidence")
    )


def workload_estimate(
    todo: DataFrame, cost_per_row=COST_PER_ROW, seconds_per_row=SECONDS_PER_ROW
) -> DataFrame:
    """One row: remaining, cost_low/high, minutes_low/high."""
    remaining = F.col("remaining")
    return todo.agg(F.count("*").alias("remaining")).select(
        remaining,
        (remaining * cost_per_row[0]).alias("cost_low"),
        (remaining * cost_per_row[1]).alias("cost_high"),
        (remaining * seconds_per_row[0] / 60).alias("minutes_low"),
        (remaining * seconds_per_row[1] / 60).alias("minutes_high"),
    )


def import_report(checked: DataFrame) -> DataFrame:
    """One row: imported, skipped. ``checked`` has an ``errors`` array per row."""
    good = F.size("errors") == 0
    return checked.agg(F.count_if(good).alias("imported"), F.count_if(~good).alias("skipped"))


def skip_reasons(checked: DataFrame) -> DataFrame:
    """How many rows each reason applies to, most frequent first."""
    return (
        checked.select(F.explode("errors").alias("reason"))
        .groupBy("reason")
        .agg(F.count("*").alias("rows"))
        .orderBy(F.col("rows").desc(), "reason")
    )


def reviewer_progress(
    decisions: DataFrame, reviewers: DataFrame, kept="keep", rejected="reject"
) -> DataFrame:
    """user_id, current_index, kept, rejected, last_active; zeros for idle reviewers.

    Counts are combined in the map stage, so what is joined has one row per reviewer.
    """
    counts = decisions.groupBy("user_id").agg(
        F.count("*").alias("current_index"),
        F.count_if(F.col("decision") == kept).alias("kept"),
        F.count_if(F.col("decision") == rejected).alias("rejected"),
        F.max("decided_at").alias("last_active"),
    )
    return reviewers.select("user_id").join(counts, "user_id", "left").na.fill(
        0, ["current_index", "kept", "rejected"]
    )
