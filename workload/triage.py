"""Prompts, replies, verdicts, progress and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlesieve.functions.replies import parse_reply, resolve_attempts
from titlesieve.operators.batches import ranked_progress, read_verdicts, run_ranked_batches
from titlesieve.operators.columns import with_verdict_columns
from titlesieve.operators.filters import split_by_decision
from titlesieve.operators.running import running_totals
from titlesieve.operators.stats import confidence_breakdown, decision_shares, workload_estimate
from titlesieve.operators.triage import (
    attach_verdicts, batch_progress, merge_progress, render_prompts, remaining, run_batches,
)
from titlesieve.sources.readers import NULL_TOKENS, read_papers
from titlesieve.sources.storage import scratch_folder
from titlesieve.sources.writers import current_triage, publish_triage, write_triage
from titlesieve.streaming.live import triage_stream
from workload.registry import query
from workload.screening import papers
from workload.views import stream_table, view, with_views

TEMPLATE = "Topic: {topic}\nTitle: {title}\nAbstract: {abstract}\nJSON {{}}?"
BATCH = 64


def _parsed(column: str) -> str:
    """SQL columns ok, decision and confidence of a reply column."""
    space = r"[\s]"
    trimmed = f"regexp_replace({column}, '^{space}+|{space}+$', '', 'g')"
    inside = f"regexp_replace(split_part({trimmed}, '```', 2), '^json', '')"
    body = (
        f"CASE WHEN starts_with({trimmed}, '```')"
        f" THEN regexp_replace({inside}, '^{space}+|{space}+$', '', 'g') ELSE {trimmed} END"
    )
    return body


def _verdict(column: str, prefix: str, source: str) -> str:
    """CTEs that end in <prefix>: row_id, valid, decision, confidence."""
    return f"""
    {prefix}_body AS (SELECT row_id, {_parsed(column)} AS body FROM {source}),
    {prefix}_json AS (SELECT row_id, CASE WHEN json_valid(body) AND starts_with(body, '{{')
        THEN body ELSE '{{}}' END AS body FROM {prefix}_body),
    {prefix}_valid AS (SELECT row_id, body,
        coalesce(json_extract_string(body, '$.decision') IN ('keep', 'reject'), false) AS valid FROM {prefix}_json),
    {prefix} AS (SELECT row_id, valid,
        CASE WHEN valid THEN json_extract_string(body, '$.decision') ELSE 'reject' END AS decision,
        CASE WHEN NOT valid THEN 'low'
             WHEN list_contains(json_keys(body), 'confidence') THEN json_extract_string(body, '$.confidence')
             ELSE 'unknown' END AS confidence FROM {prefix}_valid)"""


FIRST = f"{with_views('papers', 'replies')}, {_verdict('reply', 'one', 'replies')}"
# The first valid one of two attempts.
VERDICTS = f"""{FIRST}, {_verdict('second_reply', 'two', 'replies')},
    verdicts AS (SELECT one.row_id,
      CASE WHEN one.valid THEN one.decision WHEN two.valid THEN two.decision ELSE 'reject' END AS decision,
      CASE WHEN one.valid THEN one.confidence WHEN two.valid THEN two.confidence ELSE 'low' END AS confidence
      FROM one JOIN two ON one.row_id = two.row_id),
    judged AS (SELECT papers.*, decision AS nlp_decision, confidence AS nlp_confidence
      FROM papers LEFT JOIN verdicts ON papers.row_id = verdicts.row_id)"""


def replies(spark, sf_dir):
    return view(spark, sf_dir, "replies")


def verdicts(spark, sf_dir):
    attempts = F.array("reply", "second_reply")
    return replies(spark, sf_dir).select("row_id", resolve_attempts(attempts).alias("verdict"))


def judged(spark, sf_dir):
    return attach_verdicts(papers(spark, sf_dir), verdicts(spark, sf_dir))


@query(
    "prompts",
    f"""{with_views('papers')} SELECT row_id, 'Topic: review' || chr(10) || 'Title: ' || coalesce(title, 'nan')
      || chr(10) || 'Abstract: ' || coalesce(abstract, '') || chr(10) || 'JSON {{}}?' AS prompt FROM papers""",
)
def _(spark, sf_dir):
    return render_prompts(papers(spark, sf_dir), "title", "abstract", TEMPLATE, topic="review")


@query("parsed_replies", f"{FIRST} SELECT * FROM one")
def _(spark, sf_dir):
    parsed = replies(spark, sf_dir).select("row_id", parse_reply(F.col("reply")).alias("reply"))
    return parsed.select("row_id", "reply.*")


@query("resolved_attempts", f"{VERDICTS} SELECT * FROM verdicts")
def _(spark, sf_dir):
    return verdicts(spark, sf_dir).select("row_id", "verdict.*")


@query("judged_papers", f"{VERDICTS} SELECT * FROM judged")
def _(spark, sf_dir):
    return judged(spark, sf_dir)


@query("kept_papers", f"{VERDICTS} SELECT * FROM judged WHERE nlp_decision = 'keep'")
def _(spark, sf_dir):
    return split_by_decision(judged(spark, sf_dir))[0]


@query("rejected_papers", f"{VERDICTS} SELECT * FROM judged WHERE nlp_decision = 'reject'")
def _(spark, sf_dir):
    return split_by_decision(judged(spark, sf_dir))[1]


@query(
    "remaining_papers",
    f"{VERDICTS} SELECT row_id, title FROM judged WHERE nlp_decision IS NULL",
)
def _(spark, sf_dir):
    base = papers(spark, sf_dir).select("row_id", "title")
    return remaining(base, judged(spark, sf_dir))


@query(
    "workload_estimate",
    f"""{VERDICTS}, todo AS (SELECT count(*) AS remaining FROM judged WHERE nlp_decision IS NULL)
    SELECT remaining, round(remaining * 0.003::DOUBLE, 6) AS cost_low, round(remaining * 0.01::DOUBLE, 6) AS cost_high,
      round(remaining * 0.5::DOUBLE / 60, 6) AS minutes_low, round(remaining * 1.0::DOUBLE / 60, 6) AS minutes_high FROM todo""",
)
def _(spark, sf_dir):
    estimate = workload_estimate(remaining(papers(spark, sf_dir), judged(spark, sf_dir)))
    rounded = {c: F.round(c, 6) for c in estimate.columns if c != "remaining"}
    return estimate.withColumns(rounded)


@query(
    "merged_progress",
    f"""{VERDICTS} SELECT papers.row_id, papers.title, papers.source,
      CASE WHEN valid THEN one.decision END AS nlp_decision,
      CASE WHEN valid THEN one.confidence END AS nlp_confidence
    FROM papers LEFT JOIN one ON papers.row_id = one.row_id""",
)
def _(spark, sf_dir):
    parsed = replies(spark, sf_dir).select("row_id", parse_reply(F.col("reply")).alias("reply"))
    saved = parsed.select(
        "row_id",
        F.when(F.col("reply.valid"), F.col("reply.decision")).alias("nlp_decision"),
        F.when(F.col("reply.valid"), F.col("reply.confidence")).alias("nlp_confidence"),
        F.lit("not in the base table").alias("note"),
    )
    base = with_verdict_columns(papers(spark, sf_dir).select("row_id", "title", "source"))
    return merge_progress(base, saved)


@query(
    "decision_shares",
    f"""{VERDICTS} SELECT count(*) AS total, count(*) FILTER (nlp_decision = 'keep') AS keep,
      count(*) FILTER (nlp_decision = 'reject') AS reject,
      round(CAST(count(*) FILTER (nlp_decision = 'keep') AS DOUBLE) * 100 / count(*), 6) AS keep_percent,
      round(CAST(count(*) FILTER (nlp_decision = 'reject') AS DOUBLE) * 100 / count(*), 6) AS reject_percent
    FROM judged""",
)
def _(spark, sf_dir):
    shares = decision_shares(judged(spark, sf_dir))
    return shares.withColumns({c: F.round(c, 6) for c in ("keep_percent", "reject_percent")})


@query(
    "confidence_breakdown",
    f"""{VERDICTS} SELECT nlp_confidence, count(*) AS count FROM judged
    WHERE nlp_decision = 'keep' AND nlp_confidence IS NOT NULL GROUP BY nlp_confidence""",
)
def _(spark, sf_dir):
    return confidence_breakdown(judged(spark, sf_dir))


_BATCHES = f"""batches AS (SELECT row_id // {BATCH} AS batch, count(*) AS rows, count(nlp_decision) AS decided,
      count(*) FILTER (nlp_decision = 'keep') AS keep, count(*) FILTER (nlp_decision = 'reject') AS reject
    FROM judged GROUP BY ALL)"""


@query("batch_progress", f"{VERDICTS}, {_BATCHES} SELECT * FROM batches")
def _(spark, sf_dir):
    return batch_progress(judged(spark, sf_dir), BATCH)


@query(
    "running_decision_counts",
    f"""{VERDICTS}, {_BATCHES} SELECT batch, rows,
      CAST(sum(decided) OVER (ORDER BY batch) AS BIGINT) AS decided,
      CAST(sum(keep) OVER (ORDER BY batch) AS BIGINT) AS keep,
      CAST(sum(reject) OVER (ORDER BY batch) AS BIGINT) AS reject FROM batches""",
)
def _(spark, sf_dir):
    return running_totals(
        batch_progress(judged(spark, sf_dir), BATCH), "batch", ["decided", "keep", "reject"]
    )


@query(
    "triage_output",
    f"{VERDICTS} SELECT * FROM judged",
)
def _(spark, sf_dir):
    """Written in one go as partition folders, and read back from them."""
    target = scratch_folder(spark, "triage")
    verdicts_of_all = judged(spark, sf_dir)
    write_triage(verdicts_of_all, target, format="parquet")
    return spark.read.schema(verdicts_of_all.schema).parquet(target).select(*verdicts_of_all.columns)


def _after_reading(columns) -> str:
    """Cells as a CSV reader takes them back: some texts stand for nulls."""
    tokens = ", ".join(f"'{token}'" for token in NULL_TOKENS)
    return ", ".join(f"CASE WHEN {c} IN ({tokens}) THEN NULL ELSE {c} END AS {c}" for c in columns)


_TEXTS = ("title", "authors", "year_raw", "abstract", "doi", "source", "nlp_decision", "nlp_confidence")


@query("triage_resumed", f"{VERDICTS} SELECT row_id, {_after_reading(_TEXTS)}, nlp_decision IS NULL AS open FROM judged")
def _(spark, sf_dir):
    """All columns through the CSV output, read back and merged; ``open`` is what is left to do."""
    target = scratch_folder(spark, "triage-csv")
    write_triage(judged(spark, sf_dir), target)
    saved = read_papers(spark, target, row_id=False)
    saved = saved.withColumn("row_id", F.col("row_id").cast("bigint"))
    base = papers(spark, sf_dir)
    read = [F.when(~F.col(c).isin(*NULL_TOKENS), F.col(c)).alias(c) for c in base.columns if c != "row_id"]
    merged = merge_progress(with_verdict_columns(base.select("row_id", *read)), saved)
    todo = remaining(base.select("row_id"), saved).withColumn("open", F.lit(True))
    return merged.join(todo, "row_id", "left").withColumn("open", F.coalesce("open", F.lit(False)))


@query(
    "merged_repeats",
    f"""{VERDICTS} SELECT papers.row_id, CASE WHEN valid THEN one.decision END AS nlp_decision,
      CASE WHEN valid THEN one.confidence END AS nlp_confidence
    FROM papers LEFT JOIN one ON papers.row_id = one.row_id""",
)
def _(spark, sf_dir):
    """Every saved row twice, as a redelivered reply would give: papers stay single."""
    parsed = replies(spark, sf_dir).select("row_id", parse_reply(F.col("reply")).alias("reply"))
    saved = parsed.select(
        "row_id",
        F.when(F.col("reply.valid"), F.col("reply.decision")).alias("nlp_decision"),
        F.when(F.col("reply.valid"), F.col("reply.confidence")).alias("nlp_confidence"),
    )
    base = with_verdict_columns(papers(spark, sf_dir).select("row_id"))
    return merge_progress(base, saved.unionByName(saved))


def _judge(spark, sf_dir):
    def judge(batch):
        return attach_verdicts(batch.select("row_id"), verdicts(spark, sf_dir))

    return judge


@query("triage_in_batches", f"{VERDICTS} SELECT row_id, nlp_decision, nlp_confidence FROM judged")
def _(spark, sf_dir):
    """Judged in a few id ranges, each stored before the next starts."""
    store = scratch_folder(spark, "batches")
    base = papers(spark, sf_dir).select("row_id", "title")
    last = base.agg(F.max("row_id")).first()[0]
    run_batches(base, _judge(spark, sf_dir), store, size=last // 3 + 1)
    return spark.read.parquet(store)


@query("triage_stream", "WITH " + VERDICTS.removeprefix("WITH ") + " SELECT row_id, nlp_decision, nlp_confidence FROM judged")
def _(spark, sf_dir):
    """The same over a stream of papers, one stored batch per trigger."""
    store, checkpoint = scratch_folder(spark, "stream"), scratch_folder(spark, "stream-state")
    stream = stream_table(spark, sf_dir, "documents").selectExpr("doc_id AS row_id", "text AS abstract")
    triage_stream(stream, _judge(spark, sf_dir), store, checkpoint).awaitTermination()
    return spark.read.parquet(store).select("row_id", "nlp_decision", "nlp_confidence")


RANKED = 50
# Ids far apart and not evenly so.
_SPARSE = "row_id * row_id + row_id % 7"
_RANKED = f"""sparse AS (SELECT {_SPARSE} AS row_id, nlp_decision, nlp_confidence FROM judged),
    ranked AS (SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // {RANKED} AS batch FROM sparse)"""


@query("triage_ranked_batches", f"{VERDICTS}, {_RANKED} SELECT row_id, nlp_decision, nlp_confidence FROM ranked")
def _(spark, sf_dir):
    """Sparse ids in batches of 50; the first run stops in its third job, the second ends it."""
    base = papers(spark, sf_dir).select(F.expr(_SPARSE).alias("row_id"), "title")
    given = verdicts(spark, sf_dir).withColumn("row_id", F.expr(_SPARSE))
    store, begun = scratch_folder(spark, "ranked"), []

    def judge(batch):
        begun.append(1)
        if len(begun) == 3:
            raise InterruptedError
        return attach_verdicts(batch.select("row_id"), given)

    try:
        run_ranked_batches(base, judge, store, RANKED, jobs=6)
    except InterruptedError:
        pass
    run_ranked_batches(base, judge, store, RANKED, jobs=6)
    return read_verdicts(base, store)


@query(
    "ranked_batch_counts",
    f"""{VERDICTS}, {_RANKED}, batches AS (SELECT batch, count(*) AS rows, count(nlp_decision) AS decided,
      count(*) FILTER (nlp_decision = 'keep') AS keep, count(*) FILTER (nlp_decision = 'reject') AS reject
    FROM ranked GROUP BY batch)
    SELECT batch, rows, CAST(sum(decided) OVER (ORDER BY batch) AS BIGINT) AS decided,
      CAST(sum(keep) OVER (ORDER BY batch) AS BIGINT) AS keep,
      CAST(sum(reject) OVER (ORDER BY batch) AS BIGINT) AS reject FROM batches""",
)
def _(spark, sf_dir):
    """Running counts after each batch of 50 papers, whatever their ids are."""
    sparse = judged(spark, sf_dir).withColumn("row_id", F.expr(_SPARSE))
    return running_totals(ranked_progress(sparse, RANKED), "batch", ["decided", "keep", "reject"])


@query("triage_published", f"{VERDICTS} SELECT * FROM judged")
def _(spark, sf_dir):
    """A later write that stopped before it was published is not read."""
    path = scratch_folder(spark, "published")
    whole = judged(spark, sf_dir)
    publish_triage(whole.limit(0), path, format="parquet")
    publish_triage(whole, path, format="parquet")
    write_triage(whole.where("row_id % 2 = 0"), f"{path}/version=2", format="parquet")
    return spark.read.schema(whole.schema).parquet(current_triage(spark, path)).select(*whole.columns)


@query(
    "merged_versions",
    f"""{VERDICTS} SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 'reject' ELSE nlp_decision END AS nlp_decision,
      CASE WHEN row_id % 3 = 0 THEN NULL ELSE nlp_confidence END AS nlp_confidence,
      CASE WHEN row_id % 3 = 0 THEN 'late ' || title ELSE title END AS title FROM judged""",
)
def _(spark, sf_dir):
    """Verdicts saved twice: a later row counts whole, its missing confidence and text too."""
    first = judged(spark, sf_dir).select("row_id", "title", "nlp_decision", "nlp_confidence")
    later = first.where("row_id % 3 = 0").select(
        "row_id",
        F.concat(F.lit("late "), "title").alias("title"),
        F.lit("reject").alias("nlp_decision"),
        F.lit(None).cast("string").alias("nlp_confidence"),
    )
    saved = later.withColumn("saved_at", F.lit(2)).unionByName(first.withColumn("saved_at", F.lit(1)))
    base = with_verdict_columns(papers(spark, sf_dir).select("row_id", "title"))
    merged = merge_progress(base, saved, version="saved_at")
    return merged.select("row_id", "nlp_decision", "nlp_confidence", "title")
