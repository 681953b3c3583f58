"""Replaying reviewers' decision logs against an ordered queue.

A log has user_id, decided_at, event_id and decision: ``Y`` keeps the paper at the
reviewer's place in the queue, ``N`` rejects it, ``RESET`` starts over, and anything
else moves on without a verdict. A single review is a log with one user_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titlesieve.functions.names import column
from titlesieve.functions.rules import one_of, not_null
from titlesieve.operators.positions import with_positions
from titlesieve.operators.tables import check_rows, check_unique, flag_orphans

# Decision codes of the log and the verdicts they stand for.
KEEP, REJECT, RESET = "Y", "N", "RESET"

#: Seconds of a block. One reviewer's decisions of one block are handled by one task.
STRETCH = 3_600
_EARLIEST = -(1 << 62)


def review_queue(df: DataFrame, order: str = "row_id") -> DataFrame:
    """``df`` with its place in the queue, ``pos`` = 0, 1, 2, ... in row order."""
    return with_positions(df, order, cache=True)


def placed_log(log: DataFrame) -> DataFrame:
    """The log with ``place``, its position over all reviewers' decisions in order.

    The sort is by reviewer and time, so a reviewer's log is one run of places, and
    a reviewer with a third of all decisions is still many partitions.
    """
    return with_positions(
        log.select("user_id", "decided_at", "event_id", "decision"),
        "user_id", "decided_at", "event_id", name="place",
    )


def sessions(placed: DataFrame) -> DataFrame:
    """user_id, start, decisions of each reviewer's last session, after their last reset."""
    bounds = placed.groupBy("user_id").agg(
        F.min("place").alias("first"),
        F.max("place").alias("last"),
        F.max(F.when(F.col("decision") == RESET, F.col("place"))).alias("reset"),
    )
    start = F.coalesce(F.col("reset") + 1, F.col("first"))
    return bounds.select(
        "user_id", start.alias("start"), (F.col("last") - start + 1).alias("decisions")
    )


def verdict(decision: Column) -> Column:
    return F.when(decision == KEEP, "keep").when(decision == REJECT, "reject")


def _seconds(log: DataFrame) -> Column:
    """Seconds of the time of a decision: never fewer for a later one."""
    at = F.col("decided_at")
    if isinstance(log.schema["decided_at"].dataType, T.TimestampNTZType):
        # No time zone may come in: its clock can go back.
        day = F.unix_date(F.to_date(at)).cast("long")
        seconds = ((day * 24 + F.hour(at)) * 60 + F.minute(at)) * 60 + F.second(at)
    else:
        seconds = F.unix_seconds(at.cast("timestamp"))
    return seconds


def last_sessions(log: DataFrame) -> DataFrame:
    """The log with ``pos``, the place within the last session; negative before it.

    A scan in segments: decisions are dealt by reviewer and block of time, which is the
    only exchange of the log. Each block finds its rows, its last reset and the rows after
    it; one row for each block then goes through a window by reviewer that drops blocks
    before the last reset and adds up the rest; and places are put together where the
    decisions already are. A reviewer with a third of all decisions is as many keys as
    there are blocks; only decisions of one block and reviewer are sorted together. Rows
    before the block of the last reset are left out, rows without a reviewer too; a null
    time comes first.
    """
    block = F.coalesce(F.expr(f"__seconds div {STRETCH}"), F.lit(_EARLIEST))
    dealt = (
        log.select("user_id", "decided_at", "event_id", "decision")
        .where(F.col("user_id").isNotNull())
        .withColumn("__seconds", _seconds(log))
        .withColumn("block", block)
        .drop("__seconds")
        .repartition("user_id", "block")
    )
    ordered = Window.partitionBy("user_id", "block").orderBy("decided_at", "event_id")
    numbered = dealt.withColumn("nth", F.row_number().over(ordered).cast("long"))
    reset = F.when(F.col("decision") == RESET, F.col("nth"))
    blocks = numbered.groupBy("user_id", "block").agg(
        F.max("nth").alias("rows"), F.coalesce(F.max(reset), F.lit(0)).alias("reset")
    )
    by_user = Window.partitionBy("user_id").orderBy("block")
    later = by_user.rowsBetween(1, Window.unboundedFollowing)
    earlier = by_user.rowsBetween(Window.unboundedPreceding, -1)
    current = (
        blocks.withColumn("over", F.coalesce(F.max("reset").over(later), F.lit(0)) > 0)
        .where(~F.col("over"))
        .withColumn("before", F.coalesce(F.sum(F.col("rows") - F.col("reset")).over(earlier), F.lit(0)))
        .select("user_id", "block", "reset", "before")
    )
    placed = numbered.join(current, ["user_id", "block"])
    pos = F.when(F.col("nth") > F.col("reset"), F.col("before")).otherwise(0)
    return placed.withColumn("pos", pos + F.col("nth") - F.col("reset") - 1).drop(
        "block", "nth", "reset", "before"
    )


def replay(queue: DataFrame, log: DataFrame) -> DataFrame:
    """Each applied decision of the last session with the queue row it fell on.

    The i-th decision applies to the i-th queue row; decisions after the end of the
    queue fall on nothing and are left out.
    """
    applied = last_sessions(log).where("pos >= 0").join(queue, "pos")
    return applied.withColumn("verdict", verdict(F.col("decision")))


def review_counts(replayed: DataFrame) -> DataFrame:
    """user_id, kept, rejected."""
    return replayed.groupBy("user_id").agg(
        F.count_if(F.col("verdict") == "keep").alias("kept"),
        F.count_if(F.col("verdict") == "reject").alias("rejected"),
    )


def current_item(queue: DataFrame, log: DataFrame, title: str = "title") -> DataFrame:
    """Per reviewer: index, total, done, the row at the cursor, counts and progress.

    Past the end ``done`` is true and there is no row and no progress percent.
    """
    total = queue.agg(F.count("*").alias("total")).scalar()
    pos, decision = F.col("pos"), F.col("decision")
    cards = (
        last_sessions(log)
        .withColumn("counts", (pos >= 0) & (pos < total))
        .groupBy("user_id")
        .agg(
            F.count_if("counts").alias("index"),
            F.count_if(F.col("counts") & (decision == KEEP)).alias("kept"),
            F.count_if(F.col("counts") & (decision == REJECT)).alias("rejected"),
        )
        .withColumn("total", total)
    )
    at = queue.select(F.col("pos").alias("index"), "row_id", column(title).alias("title"))
    index, total = F.col("index"), F.col("total")
    return cards.join(at, "index", "left").select(
        "user_id", "index", "total", (index >= total).alias("done"), "row_id", "title",
        "kept", "rejected", progress_percent(index, total).alias("progress_percent"),
    )


def progress_percent(index: Column, total: Column) -> Column:
    """Share of the queue up to and with the current row; null past the end."""
    return F.when(index < total, (index + 1) * 100.0 / total)


def kept_rows(replayed: DataFrame, papers: DataFrame) -> DataFrame:
    """All columns of the papers kept, in decision order."""
    kept = replayed.where(F.col("verdict") == "keep").select("user_id", "pos", "row_id")
    return kept.join(papers, "row_id").orderBy("user_id", "pos")


def accepted_decisions(decisions: DataFrame, users: DataFrame, papers: DataFrame) -> DataFrame:
    """Decision rows (id, user_id, paper_id, decision, decided_at) with their ``errors``.

    A row is accepted (no errors) if it says keep or reject, its user and paper exist
    and it is the first such decision of that user on that paper.
    """
    coded = check_rows(decisions, [not_null("decision"), one_of("decision", ("keep", "reject"))])
    checked = flag_orphans(coded, users.select(F.col("id").alias("user_id")), "user_id", "unknown user")
    checked = flag_orphans(
        checked, papers.select(F.col("id").alias("paper_id")), "paper_id", "unknown paper"
    )
    # Whether user and paper exist depends on the key alone.
    return check_unique(
        checked, ["user_id", "paper_id"], F.struct("decided_at", "id"), row="id", candidates=coded
    )
