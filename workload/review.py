"""Decision logs: replay, current cards, progress, live counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlesieve.operators.filters import apply_filter
from titlesieve.operators.review import (
    accepted_decisions, current_item, kept_rows, placed_log, replay, review_counts, review_queue,
    sessions,
)
from titlesieve.operators.stats import reviewer_progress
from titlesieve.sources.readers import NULL_TOKENS, read_papers
from titlesieve.sources.storage import materialise, scratch_folder
from titlesieve.sources.writers import export_nonempty
from titlesieve.streaming.stores import (
    current_progress, first_decisions, keep_first_decisions, upsert_progress,
)
from titlesieve.streaming.live import dedup_decisions, live_progress, read_progress, write_progress
from workload.registry import query
from workload.screening import SCREENED, SPEC, papers
from workload.views import stream_table, table, view, with_views

SESSION = """resets AS (
      SELECT *, sum(CASE WHEN decision = 'RESET' THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY decided_at, event_id) AS session FROM decisions),
    last_session AS (SELECT * FROM resets QUALIFY session = max(session) OVER (PARTITION BY user_id)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY decided_at, event_id) - 1 AS pos
      FROM last_session WHERE decision <> 'RESET')"""
REPLAY = f"""{with_views('papers', 'decisions')}, {SCREENED},
    queue AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM screened), {SESSION},
    applied AS (SELECT placed.pos, user_id, decided_at, event_id, decision, row_id, title,
      CASE decision WHEN 'Y' THEN 'keep' WHEN 'N' THEN 'reject' END AS verdict
      FROM placed JOIN queue ON placed.pos = queue.pos)"""


def decisions(spark, sf_dir):
    return view(spark, sf_dir, "decisions")


def queue(spark, sf_dir):
    """What screening left over, in order."""
    return review_queue(apply_filter(papers(spark, sf_dir), SPEC, "title").select("row_id", "title"))


@query("review_queue", f"{REPLAY} SELECT pos, row_id, title FROM queue")
def _(spark, sf_dir):
    return queue(spark, sf_dir)


@query("replayed_decisions", f"{REPLAY} SELECT * FROM applied")
def _(spark, sf_dir):
    return replay(queue(spark, sf_dir), decisions(spark, sf_dir))


@query(
    "last_sessions",
    f"""{with_views('decisions')}, {SESSION} SELECT users.user_id, count(placed.event_id) AS decisions
    FROM (SELECT DISTINCT user_id FROM decisions) AS users LEFT JOIN placed ON users.user_id = placed.user_id
    GROUP BY users.user_id""",
)
def _(spark, sf_dir):
    return sessions(placed_log(decisions(spark, sf_dir))).select("user_id", "decisions")


@query(
    "review_counts",
    f"""{REPLAY} SELECT user_id, count(*) FILTER (verdict = 'keep') AS kept,
      count(*) FILTER (verdict = 'reject') AS rejected FROM applied GROUP BY user_id""",
)
def _(spark, sf_dir):
    return review_counts(replay(queue(spark, sf_dir), decisions(spark, sf_dir)))


@query(
    "current_cards",
    f"""{REPLAY}, totals AS (SELECT count(*) AS total FROM queue),
    cursors AS (SELECT users.user_id, least(count(placed.event_id), any_value(total)) AS index, any_value(total) AS total
      FROM (SELECT DISTINCT user_id FROM decisions) AS users CROSS JOIN totals
      LEFT JOIN placed ON users.user_id = placed.user_id GROUP BY users.user_id),
    counts AS (SELECT user_id, count(*) FILTER (verdict = 'keep') AS kept,
      count(*) FILTER (verdict = 'reject') AS rejected FROM applied GROUP BY user_id)
    SELECT cursors.user_id, index, total, index >= total AS done, row_id, title, coalesce(kept, 0) AS kept,
      coalesce(rejected, 0) AS rejected,
      CASE WHEN index < total THEN round(CAST(index + 1 AS DOUBLE) * 100 / total, 6) END AS progress_percent
    FROM cursors LEFT JOIN counts ON cursors.user_id = counts.user_id LEFT JOIN queue ON queue.pos = index""",
)
def _(spark, sf_dir):
    cards = current_item(queue(spark, sf_dir), decisions(spark, sf_dir))
    return cards.withColumn("progress_percent", F.round("progress_percent", 6))


KEPT = f"""{REPLAY} SELECT applied.user_id, applied.pos, papers.row_id, papers.title, authors, year_raw, abstract, doi, source
    FROM applied JOIN papers ON applied.row_id = papers.row_id WHERE verdict = 'keep'"""


def _kept(spark, sf_dir):
    return kept_rows(replay(queue(spark, sf_dir), decisions(spark, sf_dir)), papers(spark, sf_dir)).select(
        "user_id", "pos", "row_id", "title", "authors", "year_raw", "abstract", "doi", "source"
    )


@query("kept_in_review", KEPT)
def _(spark, sf_dir):
    return _kept(spark, sf_dir)


_TOKENS = ", ".join(f"'{token}'" for token in NULL_TOKENS)
_READ = ", ".join(
    f"CASE WHEN {c} IN ({_TOKENS}) THEN NULL ELSE {c} END AS {c}"
    for c in ("title", "authors", "year_raw", "abstract", "doi", "source")
)


@query("kept_in_review_export", f"SELECT user_id, pos, row_id, {_READ} FROM ({KEPT}) AS kept")
def _(spark, sf_dir):
    """Through the CSV export and back."""
    target = scratch_folder(spark, "kept")
    kept = materialise(_kept(spark, sf_dir), "kept-rows")
    export_nonempty(kept, target, order_by=["user_id", "pos"])
    numbers = {c: F.col(c).cast("bigint") for c in ("user_id", "pos", "row_id")}
    return read_papers(spark, target, row_id=False).withColumns(numbers)


@query(
    "accepted_decisions",
    f"""{with_views('decision_rows', 'papers', 'users')} SELECT id, user_id, paper_id, decision FROM decision_rows
    WHERE decision IN ('keep', 'reject') AND user_id IN (SELECT id FROM users WHERE username IS NOT NULL)
      AND paper_id IN (SELECT row_id FROM papers WHERE title IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY user_id, paper_id ORDER BY decided_at, id) = 1""",
)
def _(spark, sf_dir):
    checked = _checked_decisions(spark, sf_dir)
    return checked.where(F.size("errors") == 0).select("id", "user_id", "paper_id", "decision")


def _checked_decisions(spark, sf_dir):
    users = view(spark, sf_dir, "users").where("username IS NOT NULL")
    stored = papers(spark, sf_dir).where("title IS NOT NULL").selectExpr("row_id AS id")
    return accepted_decisions(view(spark, sf_dir, "decision_rows"), users, stored)


@query(
    "refused_decisions",
    f"""{with_views('decision_rows', 'papers', 'users')}, facts AS (SELECT *,
      CASE WHEN decision IS NULL THEN 'decision is null' WHEN decision = 'maybe' THEN 'decision not allowed' END AS code,
      CASE WHEN user_id NOT IN (SELECT id FROM users WHERE username IS NOT NULL) THEN 'unknown user' END AS who,
      CASE WHEN paper_id NOT IN (SELECT row_id FROM papers WHERE title IS NOT NULL) THEN 'unknown paper' END AS what
      FROM decision_rows),
    ranked AS (SELECT *, coalesce(code, who, what) IS NULL AS good,
      row_number() OVER (PARTITION BY user_id, paper_id, coalesce(code, who, what) IS NULL ORDER BY decided_at, id) AS nth
      FROM facts)
    SELECT id, concat_ws('; ', code, who, what, CASE WHEN good THEN 'duplicate user_id, paper_id' END) AS errors
    FROM ranked WHERE NOT good OR nth > 1""",
)
def _(spark, sf_dir):
    bad = _checked_decisions(spark, sf_dir).where(F.size("errors") > 0)
    return bad.select("id", F.array_join("errors", "; ").alias("errors"))


PROGRESS = f"""{with_views('decisions')}, reviewers AS (SELECT c_custkey AS user_id FROM customer),
    counts AS (SELECT user_id, count(*) AS current_index, count(*) FILTER (decision = 'Y') AS kept,
      count(*) FILTER (decision = 'N') AS rejected, max(decided_at) AS last_active FROM decisions GROUP BY user_id)"""


@query(
    "reviewer_progress",
    f"""{PROGRESS} SELECT reviewers.user_id, coalesce(current_index, 0) AS current_index, coalesce(kept, 0) AS kept,
      coalesce(rejected, 0) AS rejected, last_active
    FROM reviewers LEFT JOIN counts ON reviewers.user_id = counts.user_id""",
)
def _(spark, sf_dir):
    reviewers = table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id")
    return reviewer_progress(decisions(spark, sf_dir), reviewers, kept="Y", rejected="N")


@query(
    "live_progress",
    f"{PROGRESS} SELECT * FROM counts",
)
def _(spark, sf_dir):
    """Counts kept up to date by a stream and stored batch by batch."""
    marks = stream_table(spark, sf_dir, "events").selectExpr(
        "user_id",
        "cast(ts AS timestamp) AS decided_at",
        "CASE WHEN event_type IN ('purchase', 'signup') THEN 'Y' WHEN event_type = 'error' THEN 'N'"
        " WHEN event_type = 'view' THEN 'X' WHEN event_id % 29 = 0 THEN 'RESET' ELSE 'N' END AS decision",
    )
    stored = scratch_folder(spark, "live")
    state = scratch_folder(spark, "live-state")
    write_progress(live_progress(marks, kept="Y", rejected="N"), stored, state).awaitTermination()
    return read_progress(spark, stored).withColumn("last_active", F.col("last_active").cast("timestamp_ntz"))


@query(
    "live_first_decisions",
    f"""{with_views('decision_rows')} SELECT DISTINCT user_id, paper_id FROM decision_rows
    WHERE decision IN ('keep', 'reject')""",
)
def _(spark, sf_dir):
    """Pairs let through by the streaming de-duplication; the delay spans the whole log."""
    rows = stream_table(spark, sf_dir, "events").selectExpr(
        "user_id",
        "cast(get_json_object(props, '$.k') AS bigint) AS paper_id",
        "cast(ts AS timestamp) AS decided_at",
        "CASE event_type WHEN 'purchase' THEN 'keep' WHEN 'signup' THEN 'keep' WHEN 'error' THEN 'reject'"
        " WHEN 'view' THEN 'maybe' END AS decision",
    )
    stored, state = scratch_folder(spark, "first"), scratch_folder(spark, "first-state")
    (
        dedup_decisions(rows, "40 days")
        .select("user_id", "paper_id")
        .writeStream.format("parquet")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start(stored)
        .awaitTermination()
    )
    return spark.read.parquet(stored)


SLICES = 4
_SLICE = f"(event_id - low) * {SLICES} // (high - low + 1)"


def _arriving(spark, sf_dir, start):
    """Run a stream over the events as they arrive, in four loads one after the other."""
    events = table(spark, sf_dir, "events")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    folder = scratch_folder(spark, "arriving")
    for part in range(SLICES):
        own = F.expr(f"(event_id - {low}L) * {SLICES} div ({high - low + 1}L)") == part
        events.where(own).write.mode("append").parquet(folder)
        start(spark.readStream.schema(events.schema).parquet(folder)).awaitTermination()


@query("live_progress_upserted", f"{PROGRESS} SELECT * FROM counts")
def _(spark, sf_dir):
    """Counters after four loads, a snapshot after each two."""
    stored, state = scratch_folder(spark, "progress"), scratch_folder(spark, "progress-state")

    def start(events):
        marks = events.selectExpr(
            "user_id",
            "cast(ts AS timestamp) AS decided_at",
            "CASE WHEN event_type IN ('purchase', 'signup') THEN 'Y' WHEN event_type = 'error' THEN 'N'"
            " WHEN event_type = 'view' THEN 'X' WHEN event_id % 29 = 0 THEN 'RESET' ELSE 'N' END AS decision",
        )
        return upsert_progress(live_progress(marks, kept="Y", rejected="N"), stored, state, every=2)

    _arriving(spark, sf_dir, start)
    return current_progress(spark, stored).withColumn("last_active", F.col("last_active").cast("timestamp_ntz"))


@query(
    "first_decisions_kept",
    f"""{with_views('decision_rows')}, bounds AS (SELECT min(event_id) AS low, max(event_id) AS high FROM events)
    SELECT user_id, paper_id, decision, decided_at
    FROM (SELECT *, {_SLICE.replace('event_id', 'id')} AS slice FROM decision_rows, bounds)
    WHERE decision IN ('keep', 'reject')
    QUALIFY row_number() OVER (PARTITION BY user_id, paper_id ORDER BY slice, decided_at, id) = 1""",
)
def _(spark, sf_dir):
    """The first valid decision of each pair, with its value, over four loads."""
    stored, state = scratch_folder(spark, "kept-first"), scratch_folder(spark, "kept-first-state")

    def start(events):
        rows = events.selectExpr(
            "event_id AS id",
            "user_id",
            "cast(get_json_object(props, '$.k') AS bigint) AS paper_id",
            "cast(ts AS timestamp) AS decided_at",
            "CASE event_type WHEN 'purchase' THEN 'keep' WHEN 'signup' THEN 'keep' WHEN 'error' THEN 'reject'"
            " WHEN 'view' THEN 'maybe' END AS decision",
        )
        return keep_first_decisions(rows, stored, state, ("decided_at", "id"), every=3)

    _arriving(spark, sf_dir, start)
    kept = first_decisions(spark, stored)
    return kept.withColumn("decided_at", F.col("decided_at").cast("timestamp_ntz"))
