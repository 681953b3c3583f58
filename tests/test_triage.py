import pytest
from pyspark.sql import functions as F

from titlesieve.operators.triage import (
    batch_progress, merge_progress, remaining, render_prompts, run_batches,
)
from titlesieve.plans.flows import finish_triage, prepare_triage
from titlesieve.sources.readers import read_papers
from titlesieve.sources.writers import current_triage, publish_triage, write_triage

KEEP = '{"decision":"keep","confidence":"high"}'


def test_prompts(frame):
    df = frame("row_id long, Title string, Abstract string", [(0, "{a}", None), (1, None, "b")])
    prompts = render_prompts(df, "Title", "Abstract", "{{}} {topic}: {title} / {abstract}!", topic="t {x}")
    assert sorted(tuple(row) for row in prompts.collect()) == [(0, "{} t {x}: {a} / !"), (1, "{} t {x}: nan / b!")]
    other = render_prompts(df, "Title", "Abstract", "{abstract}", null_abstract="none")
    assert {row.prompt for row in other.collect()} == {"none", "b"}
    with pytest.raises(KeyError):
        render_prompts(df, "Title", "Abstract", "{unknown}")


def test_progress_merges_and_remains(frame):
    df = frame("row_id long, t string, nlp_decision string", [(0, "a", None), (1, "b", None), (2, "c", "keep")])
    saved = frame("row_id long, t string, nlp_decision string, extra int", [(1, None, "reject", 1), (2, "C", None, 2), (9, "z", "keep", 3)])
    merged = merge_progress(df, saved)
    assert merged.columns == df.columns
    assert sorted(tuple(r) for r in merged.collect()) == [(0, "a", None), (1, "b", "reject"), (2, "C", "keep")]
    # Rows decided out of order do not hide the ones before them.
    assert [row.row_id for row in remaining(df, merged).collect()] == [0]


def judge_all(batch):
    return batch.select("row_id", F.lit("keep").alias("nlp_decision"), F.lit("high").alias("nlp_confidence"))


def test_batches_survive_a_stop(frame, spark, tmp_path):
    papers = frame("row_id long, t string", [(i, "t") for i in range(100) if i % 10 != 3])
    store, seen = str(tmp_path / "store"), []

    def stops_in_third(batch):
        if len(seen) == 2:
            raise RuntimeError("stopped")
        seen.append(batch.count())
        return judge_all(batch)

    with pytest.raises(RuntimeError):
        run_batches(papers, stops_in_third, store, size=20)
    assert seen == [18, 18]
    assert spark.read.parquet(store).count() == 36
    assert run_batches(papers, judge_all, store, size=20) == 3
    assert run_batches(papers, judge_all, store, size=20) == 0
    rows = spark.read.parquet(store)
    assert (rows.count(), rows.select("row_id").distinct().count()) == (90, 90)
    late = papers.unionAll(frame("row_id long, t string", [(53, "late")]))
    assert run_batches(late, judge_all, store, size=20) == 1
    merged = late.join(spark.read.parquet(store), "row_id", "left")
    assert sorted(tuple(r) for r in batch_progress(merged, 50).collect()) == [(0, 45, 45, 45, 0), (1, 46, 46, 46, 0)]


def test_nothing_to_judge(spark, tmp_path):
    empty = spark.createDataFrame([], "row_id long, t string")
    assert run_batches(empty, judge_all, str(tmp_path / "s"), size=5) == 0
    with pytest.raises(ValueError):
        batch_progress(empty, 0)


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_whole_triage(frame, spark, tmp_path, format):
    papers = frame("row_id long, Title string", [(0, "a"), (1, "b"), (2, None), (3, "d")])
    progress = frame("row_id long, nlp_decision string, nlp_confidence string", [(3, "reject", "low")])
    triage = prepare_triage(papers, progress, template="{topic}: {title} {abstract}", topic="t")
    assert sorted(row.row_id for row in triage.prompts.collect()) == [0, 1, 2]
    replies = frame("row_id long, replies array<string>", [(0, ["sorry", KEEP]), (1, ["sorry"])])
    shares = finish_triage(triage, replies, str(tmp_path / "out"), format=format).first()
    assert (shares.total, shares.keep, shares.reject, shares.keep_percent) == (4, 1, 2, 25.0)
    if format == "csv":
        kept = read_papers(spark, str(tmp_path / "out" / "decision=keep"), row_id=False).collect()
        assert [(row.row_id, row.Title, row.nlp_confidence) for row in kept] == [("0", "a", "high")]


def test_a_verdict_never_mixes_two_saved_rows(frame):
    df = frame("row_id long, t string, nlp_decision string, nlp_confidence string", [(i, "a", None, "old") for i in range(4)])
    saved = frame("row_id long, t string, nlp_decision string, nlp_confidence string, n int", [
        (0, "x", "keep", "low", 1), (0, None, "reject", "high", 2), (1, "x", "keep", "low", 2), (1, "y", "reject", "high", 1),
        (2, "x", "keep", None, None), (2, "y", None, "high", 0), (3, "z", None, None, 5),
    ])
    got = {r.row_id: tuple(r)[1:] for r in merge_progress(df, saved, version="n").collect()}
    assert got == {0: ("a", "reject", "high"), 1: ("x", "keep", "low"), 2: ("y", None, "high"), 3: ("z", None, "old")}
    plain = {r.row_id: tuple(r)[1:] for r in merge_progress(df, saved).collect()}
    assert plain == {0: ("a", "reject", "high"), 1: ("y", "reject", "high"), 2: ("x", "keep", None), 3: ("z", None, "old")}


def test_a_decision_column_of_the_papers_is_kept(frame, spark, tmp_path):
    rows = frame("row_id long, Decision string, nlp_decision string, nlp_confidence string", [(0, "mine", "keep", "low")])
    with pytest.raises(ValueError):
        write_triage(rows, str(tmp_path / "a"))
    write_triage(rows, str(tmp_path / "b"), folder="verdict")
    back = read_papers(spark, str(tmp_path / "b"), row_id=False).first()
    assert (back.Decision, back.nlp_decision) == ("mine", "keep")


def test_a_write_that_stops_leaves_the_version_before(frame, spark, tmp_path):
    path = str(tmp_path / "triage")
    rows = frame("row_id long, nlp_decision string, nlp_confidence string", [(0, "keep", "low"), (1, None, None)])
    assert current_triage(spark, path) is None
    publish_triage(rows, path)
    with pytest.raises(Exception):
        broken = F.when(F.col("row_id") == 1, F.raise_error(F.lit("stopped"))).otherwise(F.col("nlp_confidence"))
        publish_triage(rows.withColumn("nlp_confidence", broken.cast("string")), path)
    assert current_triage(spark, path).endswith("version=0")
    assert read_papers(spark, current_triage(spark, path), row_id=False).count() == 2
    publish_triage(rows.where("row_id = 0"), path)
    assert read_papers(spark, current_triage(spark, path), row_id=False).count() == 1
