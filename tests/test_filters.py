import pytest
from pyspark.sql import functions as F

from titlesieve.operators.filters import (
    FilterSpec, apply_filter, remove_rows, removal_report, search, split_by_decision,
)
from titlesieve.operators.stats import confidence_breakdown, dataset_stats, decision_shares, filter_stats

TITLES = [
    "Deep learning for EEG", "A survey of deep learning", None, "  ", "C++ in practice",
    " ".join(["word"] * 101), "Überblick über EEG", "deep  LEARNING\tand sleep",
]


@pytest.fixture
def papers(frame):
    return frame("row_id long, title string", enumerate(TITLES))


def ids(df):
    return sorted(row.row_id for row in df.collect())


@pytest.mark.parametrize(
    "spec, left",
    [
        (FilterSpec(), [0, 1, 3, 4, 6, 7]),
        (FilterSpec(include=("deep", "eeg")), [0, 1, 6, 7]),
        (FilterSpec(include=("deep", "eeg"), match_all=True), [0]),
        (FilterSpec(exclude=("survey",)), [0, 3, 4, 6, 7]),
        (FilterSpec(include=("learning",), exclude=("SURVEY",), min_words=4, max_words=4), [0, 7]),
        (FilterSpec(include=("c++",)), [4]),
        (FilterSpec(min_words=1, max_words=200), [0, 1, 4, 5, 6, 7]),
        (FilterSpec.from_text(" survey \n\n eeg\n", "über"), [0, 1]),
        (FilterSpec(include=("nothing",)), []),
    ],
)
def test_screening(papers, spec, left):
    assert ids(apply_filter(papers, spec)) == left
    stats = filter_stats(papers, spec.predicate(F.col("title"))).first()
    assert tuple(stats) == (len(TITLES), len(left), len(TITLES) - len(left))


def test_bounds_must_be_numbers():
    with pytest.raises(ValueError):
        FilterSpec(min_words=None)


def test_search(papers):
    assert ids(search(papers, "")) == list(range(len(TITLES)))
    assert ids(search(papers, "^deep")) == [0, 7]
    assert ids(search(papers, "ÜBER")) == [6]
    assert ids(search(papers, "C++", mode="literal")) == [4]
    with pytest.raises(ValueError):
        search(papers, "(open")
    with pytest.raises(ValueError):
        search(papers, "x", mode="fuzzy")


def test_remove_rows(papers, frame):
    assert ids(remove_rows(papers, [0, 5])) == [1, 2, 3, 4, 6, 7]
    assert ids(remove_rows(papers, [])) == list(range(8))
    odd = frame("row_id long, title string", [(1, "a"), (None, "b"), (3, "c")])
    for many in ([], list(range(10, 2_000))):
        left = remove_rows(odd, [1, None, *many], strict=False).collect()
        assert {row.title for row in left} == {"b", "c"}
    with pytest.raises(KeyError):
        remove_rows(papers, [0, 99])
    assert ids(remove_rows(papers, [0, 99], strict=False)) == [1, 2, 3, 4, 5, 6, 7]
    assert ids(remove_rows(papers, range(2, 4000), strict=False)) == [0, 1]
    listed = frame("row_id long", [(0,), (0,), (99,)])
    assert ids(remove_rows(papers, listed, strict=False)) == [1, 2, 3, 4, 5, 6, 7]
    assert tuple(removal_report(papers, listed).first()) == (3, 1, 7)


def test_verdict_counts(frame, spark):
    rows = [(0, "keep", "high"), (1, "keep", "low"), (2, "reject", "low"), (3, None, None),
            (4, "keep", None), (5, "keep", "low")]
    df = frame("row_id long, nlp_decision string, nlp_confidence string", rows)
    kept, rejected = split_by_decision(df)
    assert (ids(kept), ids(rejected)) == ([0, 1, 4, 5], [2])
    assert [tuple(row) for row in confidence_breakdown(df).collect()] == [("low", 2), ("high", 1)]
    shares = decision_shares(df).first()
    assert (shares.total, shares.keep, shares.reject) == (6, 4, 1)
    assert shares.keep_percent == pytest.approx(400 / 6)
    empty = decision_shares(df.where("row_id < 0")).first()
    assert (empty.total, empty.keep_percent) == (0, None)


def test_dataset_stats(papers):
    stats = dataset_stats(papers, papers.where("row_id < 6")).first()
    assert (stats.original_count, stats.current_count, stats.removed) == (8, 6, 2)
    assert (stats.removal_rate, stats["columns"]) == (25.0, ["title"])
    empty = papers.where("row_id < 0")
    assert dataset_stats(empty, empty).first().removal_rate is None
