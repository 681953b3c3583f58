"""The four end-to-end jobs: de-duplicate, screen, triage, load."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlesieve.functions.replies import resolve_attempts
from titlesieve.functions.rules import integer_range
from titlesieve.operators.columns import map_columns, require_columns, to_canonical, with_verdict_columns
from titlesieve.operators.dedup import duplicate_report, remove_duplicates
from titlesieve.operators.filters import FilterSpec, apply_filter
from titlesieve.operators.stats import decision_shares, import_report
from titlesieve.operators.tables import (
    assign_ids, check_rows, load_users, seed_progress, split_checked, user_load_report,
)
from titlesieve.operators.triage import attach_verdicts, merge_progress, render_prompts
from titlesieve.operators.words import word_frequencies
from titlesieve.sources.readers import read_papers
from titlesieve.sources.schemas import PAPERS, PROGRESS, USERS, paper_rules
from titlesieve.sources.storage import materialise
from titlesieve.sources.writers import CSV_OPTIONS, append_papers, write_csv, write_triage


def deduplicate_export(
    spark: SparkSession, source: str, target: str, subset=None, keep="first"
) -> DataFrame:
    """Read, drop duplicates, write in row order; returns the one-row report."""
    papers = read_papers(spark, source)
    unique = remove_duplicates(papers, subset, keep)
    write_csv(unique.orderBy("row_id").drop("row_id"), target)
    return duplicate_report(papers, subset, keep)


def top_words(base: DataFrame, spec: FilterSpec, title: str = "title", top_n: int = 30) -> DataFrame:
    """De-duplicate by title, filter, and count words: the flagship screening query."""
    unique = remove_duplicates(base, title)
    return word_frequencies(apply_filter(unique, spec, title), title, top_n)


@dataclass(frozen=True)
class Triage:
    """A triage in progress: what is decided, what is left, and the prompts to send."""

    papers: DataFrame
    todo: DataFrame
    prompts: DataFrame


def prepare_triage(
    papers: DataFrame, progress: DataFrame | None = None, *, template: str, **texts: str
) -> Triage:
    """Resolve columns, take over saved verdicts, and render prompts for the rest."""
    papers, title, abstract = require_columns(papers)
    papers = with_verdict_columns(papers)
    if progress is not None:
        papers = merge_progress(papers, progress)
    todo = papers.where(F.col("nlp_decision").isNull())
    return Triage(papers, todo, render_prompts(todo, title, abstract, template, **texts))


def finish_triage(
    triage: Triage, replies: DataFrame, target: str, retry_count: int = 3, format: str = "csv"
) -> DataFrame:
    """Turn (row_id, replies) into verdicts and write all outputs; returns the shares.

    The shares come from the files written, so replies are parsed only once.
    """
    verdict = resolve_attempts(F.col("replies"), retry_count).alias("verdict")
    judged = attach_verdicts(triage.todo, replies.select("row_id", verdict))
    write_triage(merge_progress(triage.papers, judged), target, format)
    reader = triage.papers.sparkSession.read.format(format)
    if format == "csv":
        reader = reader.options(**CSV_OPTIONS, multiLine=True)
    return decision_shares(reader.load(target))


#: What makes a paper the same as a stored one: all that a load brings.
PAPER_KEY = ("title", "authors", "year", "abstract", "doi", "source", "nlp_confidence")
_EMPTY_PAPER = [f"cast(null as {field.dataType.simpleString()}) {field.name}" for field in PAPERS]


def _paper_digest():
    cells = [F.col(name).cast("string") for name in PAPER_KEY]
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cells]
    return F.sha2(F.concat(*parts), 256)


def load_papers(source: DataFrame, target: str, policy: str = "first") -> DataFrame:
    """Canonical columns, row rules, append the good rows to the Parquet table ``target``.

    New rows get ids that count on from the stored ones, in the order of ``row_id``, a
    null ``nlp_reason`` and the time of the load. A row whose columns all equal those of a
    stored paper is not added again, so a load can be repeated; rows that repeat within one
    load are all kept. Returns the import report, in which such rows count as imported. The
    outcome is stored once, for the table and the report. Papers are compared by a SHA-256
    of their columns, so no text of the stored ones is shuffled.
    """
    spark = source.sparkSession
    canonical = to_canonical(source, map_columns(source, policy))
    checked = materialise(
        check_rows(canonical, [*paper_rules(), integer_range("year", "year_raw")]), "checked-papers"
    )
    good, _ = split_checked(checked)
    append_papers(good.select("title").limit(0).selectExpr(*_EMPTY_PAPER), target)
    stored = spark.read.schema(PAPERS).parquet(target)
    known = stored.select(_paper_digest().alias("__digest"))
    fresh = good.withColumn("__digest", _paper_digest()).join(known, "__digest", "left_anti")
    new = assign_ids(fresh.drop("__digest"), stored, "row_id")
    stamped = new.withColumns(
        {"nlp_reason": F.lit(None).cast("string"), "created_at": F.current_timestamp()}
    )
    append_papers(materialise(stamped.select(*PAPERS.names), "new-papers"), target)
    return import_report(checked)


def load_user_tables(batch: DataFrame, users: str, progress: str) -> DataFrame:
    """Append new users and their zero progress rows to Parquet tables; returns the report.

    The outcome of each row is stored before the tables change: worked out again
    afterwards, every user would exist.
    """
    spark = batch.sparkSession
    loaded = materialise(load_users(spark.read.schema(USERS).parquet(users), batch), "users")
    created = loaded.where("outcome = 'created'")
    seeded = seed_progress(created, spark.read.schema(PROGRESS).parquet(progress))
    seeded.withColumn("last_active", F.current_timestamp()).write.mode("append").parquet(progress)
    stamped = created.withColumns({"id": F.col("new_id"), "created_at": F.current_timestamp()})
    stamped.select(*USERS.names).write.mode("append").parquet(users)
    return user_load_report(loaded)
