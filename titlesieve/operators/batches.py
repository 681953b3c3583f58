"""Checkpointed batches by rank: equally many rows each, however sparse their ids are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlesieve.operators.positions import with_positions
from titlesieve.operators.triage import VERDICT_COLUMNS
from titlesieve.sources.storage import materialise
from titlesieve.sources.versions import holders, names

#: Jobs that one run starts at most; consecutive batches share a job beyond it.
MOST_JOBS = 64


def with_batches(df: DataFrame, size: int, key: str = "row_id") -> DataFrame:
    """``df`` with ``batch``: rows ``[n * size, (n + 1) * size)`` in the order of ``key``.

    ``key`` is unique. Ranks come from a range sort, which runs when this is called.
    """
    if size < 1:
        raise ValueError("batch size must be positive")
    placed = with_positions(df, key, name="__rank")
    return placed.withColumn("batch", F.expr(f"__rank div {size}")).drop("__rank")


def ranked_progress(df: DataFrame, size: int, key: str = "row_id") -> DataFrame:
    """Per batch by rank: rows, decided, keep, reject."""
    marks = with_batches(df.select(key, "nlp_decision"), size, key)
    return marks.groupBy("batch").agg(
        F.count("*").alias("rows"),
        F.count("nlp_decision").alias("decided"),
        F.count_if(F.col("nlp_decision") == "keep").alias("keep"),
        F.count_if(F.col("nlp_decision") == "reject").alias("reject"),
    )


def run_ranked_batches(
    papers: DataFrame, judge, store: str, size: int, key: str = "row_id", jobs: int = MOST_JOBS
) -> int:
    """Judge what ``store`` lacks, in batches of ``size`` papers by rank of ``key``.

    ``judge`` maps a DataFrame of papers to (key, nlp_decision, nlp_confidence) rows. The
    batches with open papers are taken in order, some consecutive ones in each of at most
    ``jobs`` jobs. Every job writes a folder, in which ``batch`` is a column, so files grow
    with the papers and not with the batches. A folder counts from its job's commit on, so a
    stopped run leaves whole batches and the next run goes on with what is open. The store
    is listed and read once per run. Rank bounds reach the scan of ``papers`` as a
    pushed-down range of ids. Returns the number of batches judged.
    """
    spark = papers.sparkSession
    ranked = materialise(with_batches(papers.select(key), size, key), "ranks")
    runs = [int(name.split("=")[1]) for name in names(spark, f"{store}/run=*")]
    decided = _stored(spark, store, key, papers).where(F.col("nlp_decision").isNotNull())
    todo = materialise(
        ranked.join(materialise(decided.select(key).distinct(), "decided"), key, "left_anti"), "open"
    )
    last = todo.agg(F.max("batch")).first()[0]
    if last is None:
        return 0
    per_job = -(-(last + 1) // jobs)
    work = F.expr(f"batch div {per_job}")
    # One row for each job comes to the driver.
    spans = (
        todo.groupBy(work.alias("job"))
        .agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count_distinct("batch").alias("n"))
        .orderBy("job")
        .collect()
    )
    for span in spans:
        mine = todo.where(work == span.job)
        inside = papers.where(F.col(key).between(span.low, span.high))
        judged = judge(inside.join(mine.select(key), key, "left_semi").select(*papers.columns))
        rows = judged.select(key, *VERDICT_COLUMNS).join(mine, key)
        (
            rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
            .parquet(f"{store}/run={max(runs, default=-1) + 1}/job={span.job}")
        )
    return sum(span.n for span in spans)


def _stored(spark: SparkSession, store: str, key: str, papers: DataFrame) -> DataFrame:
    """What committed jobs wrote, and runs of earlier versions, with a folder for each batch."""
    kind = papers.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, nlp_decision string, nlp_confidence string, run int, batch bigint"
    rows = spark.createDataFrame([], schema)
    for paths in (holders(spark, f"{store}/run=*/job=*/_SUCCESS"), holders(spark, f"{store}/run=*/batch=*")):
        if paths:
            found = spark.read.schema(schema).option("basePath", store).parquet(*paths)
            rows = rows.unionByName(found.select(rows.columns))
    return rows


def read_verdicts(papers: DataFrame, store: str, key: str = "row_id") -> DataFrame:
    """key, nlp_decision, nlp_confidence of ``run_ranked_batches``: one row for each key.

    A verdict counts before none, and that of a later run before an earlier one.
    """
    spark = papers.sparkSession
    rows = _stored(spark, store, key, papers)
    order = F.col("run") + F.when(F.col("nlp_decision").isNotNull(), 1 << 20).otherwise(0)
    return rows.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in VERDICT_COLUMNS])
