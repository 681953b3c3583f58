"""Results of decision streams kept in tables that survive any number of restarts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from titlesieve.sources.schemas import decision_rules
from titlesieve.sources.storage import materialise
from titlesieve.sources.versions import BATCH, VersionedTable

COUNTERS = ("current_index", "kept", "rejected", "last_active")
_PROGRESS = "user_id bigint, current_index bigint, kept bigint, rejected bigint, last_active timestamp"
#: Batches between two snapshots, and folders that accepted pairs are dealt over.
COMPACT_EVERY, BUCKETS = 10, 64


def _start(stream: DataFrame, mode: str, store, checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def upsert_progress(
    progress: DataFrame, table: str, checkpoint: str, every: int = COMPACT_EVERY, **trigger
) -> StreamingQuery:
    """Keep one row of counters per reviewer up to date from ``live_progress``.

    Each micro-batch stores the rows that changed, whole; every ``every`` batches the
    table is merged to one row per reviewer, and the merged version published.
    """

    def store(changed: DataFrame, batch_id: int) -> None:
        kept = VersionedTable(changed.sparkSession, table, _PROGRESS)
        kept.put(changed.select("user_id", *COUNTERS), batch_id)
        if kept.due(batch_id, every):
            kept.compact(_latest(kept.read()), batch_id)

    return _start(progress, "update", store, checkpoint, trigger)


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(*[F.max_by(c, BATCH).alias(c) for c in COUNTERS])


def current_progress(spark: SparkSession, table: str) -> DataFrame:
    """The counters of each reviewer: one snapshot and the batches after it are read."""
    return _latest(VersionedTable(spark, table, _PROGRESS).read())


_FIRST = "user_id bigint, paper_id bigint, decision string, decided_at timestamp, bucket int"
_PAIR = ("user_id", "paper_id")


def keep_first_decisions(
    decisions: DataFrame,
    store: str,
    checkpoint: str,
    order: tuple[str, ...] = ("decided_at",),
    buckets: int = BUCKETS,
    every: int = COMPACT_EVERY,
    **trigger,
) -> StreamingQuery:
    """Store the first valid decision of each (user, paper), whatever time lies between.

    Decisions that the table would refuse are left out, so they hide no later one. In a
    micro-batch the least by ``order`` is first (it must have no ties to be exact), and a
    decision of an earlier batch always comes before. Accepted pairs are the state: they
    are in ``store``, dealt over ``buckets`` folders, of which a batch reads those that its
    own pairs belong to. Nothing is held in memory between batches and nothing expires. A
    batch that is run again after a failure gives the same rows and replaces its own.
    """
    broken = reduce(or_, [rule.broken for rule in decision_rules()])

    def keep(batch: DataFrame, batch_id: int) -> None:
        accepted = VersionedTable(batch.sparkSession, store, _FIRST, "bucket")
        if accepted.holds(batch_id):
            return
        valid = batch.where(~F.coalesce(broken, F.lit(False)))
        nth = F.row_number().over(Window.partitionBy(*_PAIR).orderBy(*order))
        bucket = F.pmod(F.xxhash64(*_PAIR), F.lit(buckets)).cast("int")
        # The batch is read twice; a source may give it in another order each time.
        first = materialise(
            valid.withColumn("__nth", nth)
            .where("__nth = 1")
            .select(*_PAIR, "decision", "decided_at", bucket.alias("bucket")),
            "first-decisions",
        )
        mine = [row.bucket for row in first.select("bucket").distinct().collect()]
        known = accepted.read(before=batch_id).where(F.col("bucket").isin(mine))
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in _PAIR]
        old = known.select(*[F.col(c).alias(f"__{c}") for c in _PAIR])
        accepted.put(first.join(old, same[0] & same[1], "left_anti"), batch_id)
        if accepted.due(batch_id, every):
            accepted.compact(accepted.read().drop(BATCH), batch_id)

    return _start(decisions, "append", keep, checkpoint, trigger)


def first_decisions(spark: SparkSession, store: str) -> DataFrame:
    """user_id, paper_id, decision, decided_at of all first decisions so far."""
    rows = VersionedTable(spark, store, _FIRST, "bucket").read()
    return rows.select(*_PAIR, "decision", "decided_at")
