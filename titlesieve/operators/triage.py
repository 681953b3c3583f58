"""Keep / reject triage around a classifier that lives elsewhere: prompts out, replies in."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlesieve.functions.names import column

VERDICT_COLUMNS = ("nlp_decision", "nlp_confidence")

def prompt(title: Column, abstract: Column, template: str, **texts: str) -> Column:
    """Prompt text from a template with ``{title}``, ``{abstract}`` and fixed ``texts``."""
    columns = {"title": title, "abstract": abstract}
    pieces: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            pieces.append(columns[field] if field in columns else F.lit(texts[field]))
    return F.concat(*pieces)


def render_prompts(
    df: DataFrame,
    title: str,
    abstract: str,
    template: str,
    null_title: str = "nan",
    null_abstract: str = "",
    **texts: str,
) -> DataFrame:
    """row_id, prompt for every row."""
    return df.select(
        "row_id",
        prompt(
            F.coalesce(column(title), F.lit(null_title)),
            F.coalesce(column(abstract), F.lit(null_abstract)),
            template,
            **texts,
        ).alias("prompt"),
    )


def attach_verdicts(papers: DataFrame, verdicts: DataFrame, key: str = "row_id") -> DataFrame:
    """Papers with ``nlp_decision`` and ``nlp_confidence`` from (key, verdict struct) rows.

    Of several verdicts of one key the greatest (decision, confidence) counts, nulls last,
    so papers never multiply.
    """
    one = verdicts.groupBy(key).agg(
        F.max(F.struct("verdict.decision", "verdict.confidence")).alias("verdict")
    )
    named = one.select(
        key,
        F.col("verdict.decision").alias("nlp_decision"),
        F.col("verdict.confidence").alias("nlp_confidence"),
    )
    return papers.drop(*VERDICT_COLUMNS).join(named, key, "left")


def remaining(papers: DataFrame, progress: DataFrame, key: str = "row_id") -> DataFrame:
    """Papers that have no verdict in ``progress`` yet, in whatever order they were judged."""
    decided = progress.where(F.col("nlp_decision").isNotNull()).select(key)
    return papers.join(decided, key, "left_anti")


def merge_progress(
    df: DataFrame, saved: DataFrame, key: str = "row_id", version: str | None = None
) -> DataFrame:
    """Saved cells that are not null replace those of ``df``; columns of ``df`` only.

    Of several saved rows of one key one counts, whole: that of the greatest ``version``,
    the number or time of its writing, nulls least. Without versions, and among equal
    ones, it is the row with the greatest (decision, confidence), then the greatest hash
    of its cells. Decision and confidence are taken over together, so a verdict never
    mixes two rows. Rows of ``df`` never multiply. All but one row of a key are dropped
    before the shuffle.
    """
    shared = [name for name in df.columns if name in saved.columns and name != key]
    if not shared:
        return df
    verdict = [name for name in VERDICT_COLUMNS if name in shared]
    newest = [] if version is None else [column(version).desc_nulls_last()]
    newest += [column(name).desc_nulls_last() for name in verdict]
    newest.append(F.xxhash64(*map(column, shared)))
    nth = F.row_number().over(Window.partitionBy(column(key)).orderBy(*newest))
    old = (
        saved.withColumn("__nth", nth)
        .where("__nth = 1")
        .select(column(key), *[column(name).alias(f"__saved_{name}") for name in shared])
    )
    decided = F.col(f"__saved_{verdict[0]}").isNotNull() if len(verdict) == 2 else F.lit(False)

    def cell(name: str) -> Column:
        if name not in shared:
            return column(name)
        kept = F.coalesce(column(f"__saved_{name}"), column(name))
        if name in verdict:
            kept = F.when(decided, column(f"__saved_{name}")).otherwise(kept)
        return kept.alias(name)

    return df.join(old, key, "left").select(*map(cell, df.columns))


def batch_number(size: int, key: str = "row_id") -> Column:
    """Checkpoint batch of a row: rows ``[n * size, (n + 1) * size)`` are batch ``n``."""
    if size < 1:
        raise ValueError("batch size must be positive")
    return F.expr(f"`{key}` div {size}")


def batch_progress(df: DataFrame, size: int, key: str = "row_id") -> DataFrame:
    """Per batch: rows, decided, keep, reject."""
    return df.groupBy(batch_number(size, key).alias("batch")).agg(
        F.count("*").alias("rows"),
        F.count("nlp_decision").alias("decided"),
        F.count_if(F.col("nlp_decision") == "keep").alias("keep"),
        F.count_if(F.col("nlp_decision") == "reject").alias("reject"),
    )


def run_batches(papers: DataFrame, judge, store: str, size: int, key: str = "row_id") -> int:
    """Judge what the Parquet folder ``store`` lacks, and append after each batch.

    ``judge`` maps a DataFrame of papers to (key, nlp_decision, nlp_confidence) rows.
    A batch is a range of ids, which reaches the scan as a pushed-down filter; pick a
    ``size`` that fills the cluster. If a run stops, what it appended stays and the
    next run goes on with the rest. Returns the number of batches judged.
    """
    spark = papers.sparkSession
    schema = f"{key} bigint, nlp_decision string, nlp_confidence string"
    papers.limit(0).selectExpr(
        f"cast({key} as bigint) {key}",
        "cast(null as string) nlp_decision",
        "cast(null as string) nlp_confidence",
    ).write.mode("append").parquet(store)
    open_rows = remaining(papers, spark.read.schema(schema).parquet(store), key)
    batches = open_rows.select(batch_number(size, key).alias("batch")).distinct()
    # One number per batch comes to the driver, which starts one job for each.
    numbers = sorted(row.batch for row in batches.collect())
    for batch in numbers:
        inside = F.col(key).between(batch * size, (batch + 1) * size - 1)
        done = spark.read.schema(schema).parquet(store).where(inside)
        todo = remaining(papers.where(inside), done, key)
        judge(todo).select(key, *VERDICT_COLUMNS).write.mode("append").parquet(store)
    return len(numbers)
