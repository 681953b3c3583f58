"""Decisions as a stream: live counts, first-decision de-duplication, triage batches."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from titlesieve.sources.schemas import decision_rules

PROGRESS_SCHEMA = (
    "user_id bigint, current_index bigint, kept bigint, rejected bigint, "
    "last_active timestamp, batch_id bigint"
)


def live_progress(decisions: DataFrame, kept="keep", rejected="reject") -> DataFrame:
    """Running counts per reviewer over a stream of decisions.

    State is one row of counters per reviewer.
    """
    return decisions.groupBy("user_id").agg(
        F.count("*").alias("current_index"),
        F.count_if(F.col("decision") == kept).alias("kept"),
        F.count_if(F.col("decision") == rejected).alias("rejected"),
        F.max("decided_at").alias("last_active"),
    )


def write_progress(progress: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Store each change of ``live_progress`` as full rows, one folder per batch.

    A batch that is run again after a failure overwrites its own folder, so nothing
    is counted twice.
    """

    def store(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return (
        progress.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_progress(spark: SparkSession, table: str) -> DataFrame:
    """The latest stored row of each reviewer."""
    changes = spark.read.schema(PROGRESS_SCHEMA).parquet(table)
    counters = ("current_index", "kept", "rejected", "last_active")
    return changes.groupBy("user_id").agg(*[F.max_by(c, "batch_id").alias(c) for c in counters])


def dedup_decisions(decisions: DataFrame, delay: str) -> DataFrame:
    """The first valid decision per (user, paper) to arrive; repeats within ``delay`` dropped.

    Decisions that the table would refuse are dropped before, so that they cannot hide a
    later valid one. Which of several decisions in one micro-batch arrives first is up to
    the source. State is kept for ``delay`` only, so repeats further apart pass. The table check
    in ``accepted_decisions`` has the last word.
    """
    broken = [rule.broken for rule in decision_rules()]
    valid = decisions.where(~F.coalesce(reduce(or_, broken), F.lit(False)))
    return valid.withWatermark("decided_at", delay).dropDuplicatesWithinWatermark(
        ["user_id", "paper_id"]
    )


def triage_stream(
    papers: DataFrame, judge, store: str, checkpoint: str, key: str = "row_id", **trigger
) -> StreamingQuery:
    """Judge papers as they arrive; each micro-batch is a batch that survives a stop."""

    def judge_batch(batch: DataFrame, batch_id: int) -> None:
        verdicts = judge(batch).select(key, "nlp_decision", "nlp_confidence")
        verdicts.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")

    return (
        papers.writeStream.foreachBatch(judge_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
