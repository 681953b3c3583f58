"""The plans that Spark makes of the operators."""

import re

import pytest
from pyspark.sql import functions as F

from titlesieve.operators import paging
from titlesieve.operators.dedup import remove_duplicates
from titlesieve.operators.filters import FilterSpec, apply_filter
from titlesieve.operators.paging import page
from titlesieve.operators.tables import check_rows, check_unique, insert_if_absent
from titlesieve.operators.words import word_frequencies
from workload.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# Windows without partitions whose input has one row per task, split, block or top-n word.
SMALL_WINDOWS = {
    "csv_file_order", "review_queue", "replayed_decisions", "last_sessions", "review_counts",
    "current_cards", "kept_in_review", "running_decision_counts", "word_bars",
    "inserted_users", "seeded_progress", "user_load_report", "user_outcomes", "users_two_keys",
    "ranked_batch_counts",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "papers")
    spark.range(5000).select(
        F.col("id").alias("row_id"),
        F.concat(F.lit("title "), F.col("id") % 100).alias("title"),
        F.repeat(F.lit("text "), 50).alias("abstract"),
    ).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cross_join_no_hidden_single_task(spark, no_broadcast, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for node in ("Python", "Pandas", "CartesianProduct", "NestedLoop"):
        assert node not in plan
    whole_window = re.search(r"Window [^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", plan)
    assert whole_window is None or name in SMALL_WINDOWS
    # Without a size known to be small, only per-task offsets are broadcast.
    assert ("BroadcastHashJoin" not in plan) or name in SMALL_WINDOWS


def test_first_of_each_key_is_cut_before_the_shuffle(stored):
    plan = plan_of(remove_duplicates(stored))
    assert plan.count("Exchange hashpartitioning") == 1
    before_shuffle = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before_shuffle


def test_none_of_repeated_keys_is_one_shuffle(stored):
    plan = plan_of(remove_duplicates(stored, keep=False))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_count" in plan


def test_filter_reads_and_pushes_what_it_needs(stored):
    spec = FilterSpec(("title 1",), ("x",))
    plan = plan_of(apply_filter(stored, spec, "title").select("row_id"))
    assert "IsNotNull(title)" in plan
    assert "ReadSchema: struct<row_id:bigint,title:string>" in plan
    assert "Exchange" not in plan


def test_words_count_before_the_shuffle(stored):
    plan = plan_of(word_frequencies(stored, "title"))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "TakeOrderedAndProject" in plan and "partial_count" in plan
    assert "SortAggregate" not in plan and "abstract" not in plan


def test_pages_are_top_k_and_deep_ones_read_a_range(stored, monkeypatch):
    shallow = plan_of(page(stored, 2, 50))
    assert "TakeOrderedAndProject" in shallow and "Exchange" not in shallow
    monkeypatch.setattr(paging, "SHALLOW_ROWS", 100)
    deep = plan_of(page(stored, 60, 50))
    assert "GreaterThanOrEqual(row_id" in deep and "LessThanOrEqual(row_id" in deep


def test_uniqueness_matches_rows_by_their_id(stored, no_broadcast):
    plan = plan_of(check_unique(check_rows(stored, []), "title"))
    assert "Window" not in plan
    joins = re.findall(r"SortMergeJoin \[([^\]]*)\]", plan)
    assert len(joins) == 1 and joins[0].startswith("row_id")


def test_inserts_shuffle_the_batch_once(stored, no_broadcast):
    plan = plan_of(insert_if_absent(stored.select("title"), stored, "title"))
    assert plan.count("Exchange hashpartitioning") == 2
    assert "WindowGroupLimit" in plan
