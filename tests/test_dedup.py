import random

import pandas as pd
import pytest

from titlesieve.operators.dedup import duplicate_report, remove_duplicates


def table(count=600, seed=3):
    rng = random.Random(seed)
    # A third of all rows share one title, another part has none.
    titles = ["Editorial"] * 8 + [None] * 4 + ["editorial", " Editorial"] + [f"t{i}" for i in range(10)]
    return [
        (i, rng.choice(titles) if rng.random() < 0.8 else f"only {i}", rng.choice(["ann", "bob", None]))
        for i in range(count)
    ]


@pytest.mark.parametrize("subset", [None, ["title"], ["title", "authors"]])
@pytest.mark.parametrize("keep", ["first", "last", False])
def test_equals_pandas(frame, subset, keep):
    rows = table()
    df = frame("row_id long, title string, authors string", rows)
    got = {row.row_id for row in remove_duplicates(df, subset, keep).collect()}
    pdf = pd.DataFrame(rows, columns=["row_id", "title", "authors"])
    left = pdf.drop_duplicates(subset=subset or ["title"], keep=keep)
    assert got == set(left.row_id)
    report = duplicate_report(df, subset, keep).first()
    assert tuple(report) == (len(pdf), len(pdf) - len(left), len(left))


def test_whole_rows_survive(frame):
    rows = table(50)
    df = frame("row_id long, title string, authors string", rows)
    assert {tuple(row) for row in remove_duplicates(df).collect()} <= set(rows)


def test_empty_and_bad_keep(frame, spark):
    df = spark.createDataFrame([], "row_id long, title string")
    assert remove_duplicates(df).count() == 0
    assert tuple(duplicate_report(df).first()) == (0, 0, 0)
    with pytest.raises(ValueError):
        remove_duplicates(df, keep="any")
