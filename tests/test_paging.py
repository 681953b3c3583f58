import random

import pytest

from titlesieve.operators import paging
from titlesieve.operators.paging import page, page_info
from titlesieve.operators.positions import with_positions
from titlesieve.operators.running import running_totals


@pytest.fixture
def scattered(frame):
    """Ids in one dense clump and a few far away, in no order."""
    rng = random.Random(5)
    ids = list(range(1000, 1700)) + [rng.randrange(-(1 << 61), 1 << 61) for _ in range(300)]
    rng.shuffle(ids)
    return frame("row_id long, title string", [(i, f"title {i % 7}") for i in ids]), sorted(ids)


@pytest.mark.parametrize("number", [0, 1, 7, 19, 20, 500])
@pytest.mark.parametrize("bound", [1000, 20])
def test_pages(scattered, monkeypatch, number, bound):
    monkeypatch.setattr(paging, "SHALLOW_ROWS", bound)
    df, ids = scattered
    got = [row.row_id for row in page(df, number, 50).collect()]
    assert got == ids[number * 50 : number * 50 + 50]


def test_pages_of_a_search(scattered, monkeypatch):
    df, ids = scattered
    found = [i for i in ids if i % 7 == 3]
    for bound in (1000, 20):
        monkeypatch.setattr(paging, "SHALLOW_ROWS", bound)
        got = [row.row_id for row in page(df, 3, 20, "TITLE 3").collect()]
        assert got == found[60:80]


@pytest.mark.parametrize("bound", [1000, 20])
def test_pages_by_text_and_with_null_ids(frame, monkeypatch, bound):
    monkeypatch.setattr(paging, "SHALLOW_ROWS", bound)
    names = frame("row_id string, title string", [(f"id {i:04}", "t") for i in range(300)])
    assert [row.row_id for row in page(names, 7, 20).collect()] == [f"id {i:04}" for i in range(140, 160)]
    nulls = frame("row_id long, title string", [(i or None, "t") for i in range(300)])
    assert [row.row_id for row in page(nulls, 0, 3).collect()] == [None, 1, 2]
    assert [row.row_id for row in page(nulls, 7, 20).collect()] == list(range(140, 160))
    far = frame("row_id long, title string", [(i - (1 << 63) if i < 50 else (1 << 62) + i, "t") for i in range(100)])
    assert [row.row_id for row in page(far, 3, 20).collect()] == [(1 << 62) + i for i in range(60, 80)]


def test_odd_pages(scattered, spark):
    df, _ = scattered
    with pytest.raises(ValueError):
        page(df, -1)
    empty = spark.createDataFrame([], "row_id long, title string")
    assert page(empty, 1000, 50).count() == 0


@pytest.mark.parametrize("total, pages", [(0, 0), (1, 1), (50, 1), (51, 2)])
def test_page_info(spark, total, pages):
    info = page_info(spark.range(total), page=0).first()
    assert (info.total, info.total_pages, info.has_previous, info.has_next) == (total, pages, False, pages > 1)


def test_positions_are_dense_and_in_order(scattered):
    df, ids = scattered
    for cache in (False, True):
        rows = with_positions(df, "row_id", cache=cache).collect()
        assert {row.pos: row.row_id for row in rows} == dict(enumerate(ids))
        assert len(rows) == len(ids)


def test_positions_of_nothing(spark):
    assert with_positions(spark.createDataFrame([], "row_id long"), "row_id").count() == 0


def test_running_totals(spark):
    got = running_totals(spark.range(20_000).selectExpr("id AS batch", "id % 5 AS keep"), "batch", ["keep"])
    total = 0
    for row in sorted(got.collect(), key=lambda row: row.batch):
        total += row.batch % 5
        assert row.keep == total
