"""Pages of a stored order, and keywords found by stretches of letters."""

import random

import pytest
from pyspark.sql import functions as F

from titlesieve.functions import text
from titlesieve.functions.text import exclude, include_any, keyword_anchors
from titlesieve.operators.ordered import OrderedTable, store_ordered


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_pages_of_a_stored_order(spark, frame, tmp_path, coalesced):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "b", "a", "Z", "é", "b"]), "x" * i) for i in range(207)]
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        store_ordered(frame("row_id long, title string, note string", rows), path, F.col("title").desc(), "row_id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    table = OrderedTable(spark, path)
    want = sorted((r for r in rows if r[1] is not None), key=lambda r: r[0])
    want.sort(key=lambda r: r[1].encode(), reverse=True)
    want += [r for r in rows if r[1] is None]
    assert table.total == 207 and (coalesced == "true" or len(table.parts) > 1)
    for number, size in [(0, 50), (1, 50), (4, 50), (5, 50), (0, 207), (0, 999), (206, 1), (68, 3), (3, 0)]:
        got = [tuple(r) for r in table.page(number, size).collect()]
        assert got == want[number * size : (number + 1) * size]
    with pytest.raises(ValueError):
        table.page(-1)


def test_a_page_sorts_nothing_again_and_reads_its_parts_only(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20_000).selectExpr("id AS row_id", "md5(cast(id AS string)) AS title")
        table = store_ordered(rows, path, "title", "row_id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    page = table.page(40, 50)
    plan = page._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("], PushedFilters")[0]
    assert "__part" in pruned and "GreaterThanOrEqual(__at" in plan and "Exchange range" in plan
    assert plan.count("Sort [") == 1
    assert page.count() == 50
    own = [p for p in table.parts if p.first < 2050 and 2000 < p.first + p.rows]
    assert len(own) <= 2 < len(table.parts)


def test_an_empty_order(spark, frame, tmp_path):
    table = store_ordered(frame("row_id long", [(1,)]).limit(0), str(tmp_path / "t"), "row_id")
    assert table.total == 0 and table.page(0, 5).collect() == []


def words(rng, n):
    letters = "abcdeéß日İ\U0001f600'\\ .%"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_thousands_of_keywords_equal_the_loop(frame, monkeypatch, seed):
    rng = random.Random(seed)
    keywords = words(rng, 5_000 if seed == 0 else 1_500)
    if seed:
        keywords = [w for w in keywords if len(w) > 3]
    texts = ["".join(words(rng, rng.randint(0, 4))) for _ in range(300)] + [None, "", "ABCDE", "a\U0001f600bc"]
    df = frame("row_id long, t string", list(enumerate(texts)))
    tests = [include_any(F.col("t"), keywords).alias("any"), exclude(F.col("t"), keywords).alias("none")]
    assert len({k.lower() for k in keywords}) > text.ANCHORED_KEYWORDS
    anchored = {r.row_id: (r.any, r.none) for r in df.select("row_id", *tests).collect()}
    monkeypatch.setattr(text, "ANCHORED_KEYWORDS", 10**9)
    tests = [include_any(F.col("t"), keywords).alias("any"), exclude(F.col("t"), keywords).alias("none")]
    assert anchored == {r.row_id: (r.any, r.none) for r in df.select("row_id", *tests).collect()}
    assert len(set(anchored.values())) > 1


def test_anchors_are_rare_stretches():
    index, short = keyword_anchors(["abcd", "abce", "abcf", "ab", "\U0001f600\U0001f600\U0001f600"])
    assert index == {"bcd": ["abcd"], "bce": ["abce"], "bcf": ["abcf"]}
    assert short == ["ab", "\U0001f600\U0001f600\U0001f600"]


def test_any_of_many_keywords_by_one_pattern(frame, monkeypatch):
    rng = random.Random(5)
    letters = ["a", "b", "é", ".", "|", "\\", "[", "^", "\U0001f600", "\n", " "]
    words = ["".join(rng.choices(letters, k=rng.randint(3, 30))) for _ in range(700)]
    words += [words[0][:2] + "�", words[1] + "b", "a" * 40, "a" * 39 + "b"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(300)]
    texts += [f"x{word}y" for word in words[::50]] + ["a" * 39 + "b", "", None, words[0][:2] + "�"]
    df = frame("row_id long, text string", enumerate(texts))
    found = include_any(F.col("text"), words)
    plan = df.where(found)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and "split(" not in plan
    expected = {i: any(w in t for w in words) if t is not None else False for i, t in enumerate(texts)}
    assert {r.row_id: r.found for r in df.select("row_id", found.alias("found")).collect()} == expected
    assert set(expected.values()) == {True, False}
    monkeypatch.setattr("titlesieve.functions.text.PATTERN_LETTERS", 0)
    looked_up = include_any(F.col("text"), words)
    assert {r.row_id: r.found for r in df.select("row_id", looked_up.alias("found")).collect()} == expected
