import random
import shutil
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from titlesieve.operators.stats import reviewer_progress
from titlesieve.streaming.live import (
    dedup_decisions, live_progress, read_progress, triage_stream, write_progress,
)
from workload.catalog import QUERIES

START = datetime(2024, 1, 1)
SCHEMA = "user_id long, paper_id long, decision string, decided_at timestamp"


def arrive(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def decisions(count, first_minute, seed):
    rng = random.Random(seed)
    return [
        (0 if rng.random() < 0.34 else rng.randrange(1, 8), rng.randrange(6),
         rng.choice(["keep", "reject", None]), START + timedelta(minutes=first_minute + i))
        for i in range(count)
    ]


def test_live_counts_equal_the_batch_at_every_stop(spark, tmp_path):
    folder, table, state = (str(tmp_path / name) for name in ("in", "table", "state"))
    for step in range(3):
        arrive(spark, folder, decisions(150, step * 200, step))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        write_progress(live_progress(stream), table, state).awaitTermination()
        stored = spark.read.schema(SCHEMA).parquet(folder)
        expected = reviewer_progress(stored, stored.select("user_id").distinct())
        got = read_progress(spark, table)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert spark.read.parquet(table).select("batch_id").distinct().count() >= 3


def test_stream_keeps_first_pairs(spark, tmp_path):
    folder, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    arrive(spark, folder, [(1, 1, "keep", START), (1, 2, "keep", START)])
    arrive(spark, folder, [(1, 1, "reject", START + timedelta(minutes=5)), (2, 1, "keep", START)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    (
        dedup_decisions(stream, "1 day").writeStream.format("parquet")
        .option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    )
    rows = spark.read.parquet(out).collect()
    assert sorted((r.user_id, r.paper_id) for r in rows) == [(1, 1), (1, 2), (2, 1)]


def test_triage_as_papers_arrive(spark, tmp_path):
    folder, store, state = (str(tmp_path / name) for name in ("in", "store", "state"))

    def judge(batch):
        verdict = F.when(F.col("row_id") % 2 == 0, "keep").otherwise("reject")
        return batch.select("row_id", verdict.alias("nlp_decision"), F.lit("high").alias("nlp_confidence"))

    for step in range(2):
        arrive(spark, folder, [(i, "t") for i in range(step * 10, step * 10 + 10)], "row_id long, title string")
        stream = spark.readStream.schema("row_id long, title string").parquet(folder)
        triage_stream(stream, judge, store, state).awaitTermination()
    rows = spark.read.parquet(store).collect()
    assert sorted(row.row_id for row in rows) == list(range(20))
    assert all((row.nlp_decision == "keep") == (row.row_id % 2 == 0) for row in rows)


def test_streamed_tables_may_be_folders_of_part_files(spark, tmp_path):
    docs = [(i, f"text {i}") for i in range(20)]
    labels = [(i, i % 2, 0) for i in range(20)]
    events = [
        (i, i % 3, START + timedelta(minutes=i), ["purchase", "error"][i % 2], f'{{"k": {i}}}')
        for i in range(12)
    ]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string"),
        ("labels", labels, "doc_id long, quality long, toxic long"),
        ("events", events, "event_id long, user_id long, ts timestamp_ntz, event_type string, props string"),
    ):
        made = spark.createDataFrame(rows, schema)
        made.repartition(3).write.parquet(str(tmp_path / "folders" / f"{name}.parquet"))
        made.coalesce(1).write.parquet(str(tmp_path / "one" / name))
        (tmp_path / "files").mkdir(exist_ok=True)
        (part,) = (tmp_path / "one" / name).glob("part-*")
        shutil.copy(part, tmp_path / "files" / f"{name}.parquet")
    for name, count in (("triage_stream", 20), ("live_progress", 3), ("live_first_decisions", 12)):
        folders, files = (
            sorted(map(str, QUERIES[name](spark, str(tmp_path / kind)).collect()))
            for kind in ("folders", "files")
        )
        assert folders == files and len(files) == count
