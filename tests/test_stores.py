"""Tables kept by streams and batches, against the same rows taken at once."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from titlesieve.operators import batches
from titlesieve.operators.batches import ranked_progress, read_verdicts, run_ranked_batches, with_batches
from titlesieve.sources.versions import VersionedTable, publish, published
from titlesieve.streaming.live import live_progress
from titlesieve.streaming.stores import (
    current_progress, first_decisions, keep_first_decisions, upsert_progress,
)

START = datetime(2024, 1, 1)
SCHEMA = "id long, user_id long, paper_id long, decision string, decided_at timestamp"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.mode("append").parquet(folder)


def decisions(first, count, seed):
    rng = random.Random(seed)
    return [
        (first + i, rng.choice([0, 0, 0, None, *range(1, 9)]), rng.choice([None, *range(9)]),
         rng.choice(["keep", "reject", "maybe", None]), START + timedelta(minutes=rng.randrange(60)))
        for i in range(count)
    ]


def files(df):
    return {path.split("/table/")[1].rsplit("/", 1)[0] for path in df.inputFiles()}


def test_a_version_is_published_last(spark, tmp_path):
    folder = str(tmp_path / "x")
    assert published(spark, folder) is None
    for version in (3, 11, 7):
        publish(spark, folder, version)
    assert published(spark, folder) == 11


def test_a_reader_sees_one_snapshot_and_the_batches_after_it(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "table"), "k int, v int")
    assert table.read().collect() == [] and table.read().columns == ["k", "v", "batch"]

    def rows(*cells):
        return spark.createDataFrame(cells, "k int, v int")

    table.put(rows((1, 1)), 0)
    table.put(rows((1, 2)), 1)
    table.put(rows((2, 2)), 1)  # the same batch again replaces itself
    assert sorted(map(tuple, table.read().collect())) == [(1, 1, 0), (2, 2, 1)]
    assert table.due(1, 2) and not table.due(0, 2)
    table.compact(table.read().drop("batch"), 1)
    table.put(rows((9, 9)), 1)  # the snapshot holds this batch
    table.put(rows((3, 3)), 2)
    assert sorted(map(tuple, table.read().collect())) == [(1, 1, 1), (2, 2, 1), (3, 3, 2)]
    assert sorted(map(tuple, table.read(before=2).collect())) == [(1, 1, 1), (2, 2, 1)]
    assert files(table.read()) == {"snapshots/upto=1", "after=1/batch=2"}
    # A snapshot that was written but not published, and a batch that was not finished.
    rows((7, 7)).write.parquet(str(tmp_path / "table" / "snapshots" / "upto=2"))
    half = tmp_path / "table" / "after=1" / "batch=3"
    rows((8, 8)).write.parquet(str(half))
    (half / "_SUCCESS").unlink()
    assert files(table.read()) == {"snapshots/upto=1", "after=1/batch=2"}


def test_progress_equals_the_counts_of_all_rows(spark, tmp_path):
    folder, table, state = (str(tmp_path / name) for name in ("in", "table", "state"))
    for step in range(5):
        arrive(spark, folder, decisions(step * 100, 100, step))
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        upsert_progress(live_progress(stream), table, state, every=2).awaitTermination()
        want = live_progress(spark.read.schema(SCHEMA).parquet(folder)).collect()
        assert sorted(current_progress(spark, table).collect(), key=str) == sorted(want, key=str)
    read = VersionedTable(spark, table, "user_id bigint").read()
    assert files(read) == {"snapshots/upto=3", "after=3/batch=4"}


def expected_first(loads):
    first = {}
    for rows in loads:
        for i, user, paper, decision, at in sorted(rows, key=lambda r: (r[4], r[0])):
            if decision in ("keep", "reject"):
                first.setdefault((user, paper), (decision, at))
    return sorted(((*pair, *value) for pair, value in first.items()), key=str)


@pytest.mark.parametrize("every", [2, 100])
def test_first_decisions_over_many_loads(spark, tmp_path, every):
    folder, store, state = (str(tmp_path / name) for name in ("in", "store", "state"))
    loads = []
    for step in range(5):
        loads.append(decisions(step * 60, 60, step))
        arrive(spark, folder, loads[-1])
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        keep_first_decisions(
            stream, store, state, ("decided_at", "id"), buckets=4, every=every
        ).awaitTermination()
        rows = first_decisions(spark, store).collect()
        assert sorted(map(tuple, rows), key=str) == expected_first(loads)


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    """The last commit of the stream is lost, as if the driver died before it."""
    folder, store, state = (tmp_path / name for name in ("in", "store", "state"))
    loads = []
    for step in range(4):
        loads.append(decisions(step * 60, 60, step + 9))
        arrive(spark, str(folder), loads[-1])
        for _ in range(2):
            stream = spark.readStream.schema(SCHEMA).parquet(str(folder))
            keep_first_decisions(
                stream, str(store), str(state), ("decided_at", "id"), buckets=4, every=2
            ).awaitTermination()
            rows = first_decisions(spark, str(store)).collect()
            assert sorted(map(tuple, rows), key=str) == expected_first(loads)
            for commit in (state / "commits").glob(f"*{step}*"):
                commit.unlink()


def judge(papers):
    verdict = F.when(F.col("row_id") % 3 == 0, "keep").when(F.col("row_id") % 3 == 1, "reject")
    return papers.select("row_id", verdict.alias("nlp_decision"), F.lit("high").alias("nlp_confidence"))


def stopping(after):
    begun = []

    def stops(papers):
        begun.append(1)
        if len(begun) > after:
            raise RuntimeError("stopped")
        return judge(papers)

    return stops


IDS = [i * i * 3 + i % 2 for i in range(230)]


@pytest.mark.parametrize("jobs, after", [(64, 2), (3, 1), (1, 0)])
def test_a_stopped_run_is_ended_by_the_next(frame, spark, tmp_path, jobs, after):
    papers, store = frame("row_id long, t string", [(i, "t") for i in IDS]), str(tmp_path / "store")
    with pytest.raises(RuntimeError):
        run_ranked_batches(papers, stopping(after), store, 50, jobs=jobs)
    done = read_verdicts(papers, store).count()
    assert done == min(after * 50 * -(-5 // jobs), 230)
    # Ids of this test are 0 or 1 modulo 3, so what was judged has a verdict.
    assert run_ranked_batches(papers, judge, store, 50, jobs=jobs) == 5 - done // 50
    rows = {r.row_id: r.nlp_decision for r in read_verdicts(papers, store).collect()}
    assert rows == {i: {0: "keep", 1: "reject"}.get(i % 3) for i in IDS}
    folders = spark.read.option("basePath", store).parquet(store)
    by = {r.row_id: r.batch for r in folders.collect()}
    assert by == {i: rank // 50 for rank, i in enumerate(IDS)}


def test_open_papers_are_judged_again_and_verdicts_stay(frame, tmp_path):
    papers, store = frame("row_id long, t string", [(i, "t") for i in range(40)]), str(tmp_path / "store")
    assert run_ranked_batches(papers, judge, store, 10) == 4

    def others(batch):
        assert all(r.row_id % 3 == 2 for r in batch.collect())
        return batch.selectExpr("row_id", "'reject' AS nlp_decision", "'low' AS nlp_confidence")

    late = papers.unionAll(frame("row_id long, t string", [(-7, "late")]))
    assert run_ranked_batches(late, others, store, 10) == 4
    assert run_ranked_batches(late, others, store, 10) == 0
    rows = {r.row_id: r.nlp_decision for r in read_verdicts(late, store).collect()}
    assert rows == {i: "keep" if i % 3 == 0 else "reject" for i in range(40)} | {-7: "reject"}


def test_small_batches_share_folders(frame, tmp_path):
    """Folders are as many as jobs; one whose job did not commit does not count."""
    papers, store = frame("row_id long, t string", [(i, "t") for i in IDS]), tmp_path / "store"
    assert run_ranked_batches(papers, judge, str(store), 2, jobs=5) == 115
    folders = sorted(store.glob("run=*/*"))
    assert len(folders) == 5
    (folders[1] / "_SUCCESS").unlink()
    assert read_verdicts(papers, str(store)).count() == 230 - 2 * 23
    assert run_ranked_batches(papers, judge, str(store), 2, jobs=5) == 23
    rows = {r.row_id: r.nlp_decision for r in read_verdicts(papers, str(store)).collect()}
    assert rows == {i: {0: "keep", 1: "reject"}.get(i % 3) for i in IDS}


def test_a_store_with_a_folder_for_each_batch_is_gone_on_with(frame, tmp_path):
    papers, store = frame("row_id long, t string", [(i, "t") for i in IDS]), str(tmp_path / "store")
    old = with_batches(judge(papers), 10).where("batch < 7")
    old.write.partitionBy("batch").parquet(f"{store}/run=0")
    assert run_ranked_batches(papers, judge, store, 10) == 16
    rows = read_verdicts(papers, store).collect()
    assert len(rows) == 230 and all(r.nlp_decision for r in rows)
    assert run_ranked_batches(papers, judge, store, 10) == 0


def test_batches_have_equal_sizes(frame, spark, tmp_path):
    df = frame("row_id long, nlp_decision string", [(i, ["keep", "reject", None][k % 3]) for k, i in enumerate(IDS)])
    rows = {r.batch: (r.rows, r.decided, r.keep, r.reject) for r in ranked_progress(df, 50).collect()}
    assert {b: r[0] for b, r in rows.items()} == {0: 50, 1: 50, 2: 50, 3: 50, 4: 30}
    assert rows[4] == (30, 20, 10, 10)
    with pytest.raises(ValueError):
        with_batches(df, 0)
    assert run_ranked_batches(df.limit(0), judge, str(tmp_path / "none"), 5) == 0
    assert read_verdicts(df, str(tmp_path / "none")).collect() == []
    assert batches.MOST_JOBS > 1
