import random
import sys

import pytest
from pyspark.sql import functions as F

from titlesieve.functions.text import (
    exclude, include_all, include_any, is_blank, keyword_array, length_between,
    parse_keywords, parse_year, strip, word_count,
)

ALPHABET = list("abcXYZ019_-'. \t\n\x1c\x85\xa0  　éÉßñ|`{}\"")


def random_texts(count, seed=7):
    rng = random.Random(seed)
    return [None, "", " ", *("".join(rng.choices(ALPHABET, k=rng.randint(1, 25))) for _ in range(count))]


def evaluate(frame, texts, **columns):
    df = frame("id int, t string", enumerate(texts))
    rows = df.select("id", *[c.alias(name) for name, c in columns.items()]).collect()
    return [row.asDict() for row in sorted(rows, key=lambda row: row.id)]


def test_spaces_are_those_of_python(frame):
    points = [chr(p) for p in range(1, sys.maxunicode + 1) if not 0xD800 <= p <= 0xDFFF]
    df = frame("c string", ((c,) for c in points[:0x4000] + points[0xF000:0x10000]))
    found = {row.c for row in df.where(word_count(F.col("c")) == 0).collect()}
    assert found == {c for c in points if c.isspace()}
    assert {row.c for row in df.where(strip(F.col("c")) == "").collect()} == found


def test_word_count_and_strip_equal_python(frame):
    texts = random_texts(3000)
    for text, row in zip(texts, evaluate(
        frame, texts, words=word_count(F.col("t")), bare=strip(F.col("t")), blank=is_blank(F.col("t")),
        short=length_between(F.col("t"), 1, 2),
    )):
        words = None if text is None else len(text.split())
        assert row["words"] == words
        assert row["bare"] == (None if text is None else text.strip())
        assert row["blank"] == (not words)
        assert row["short"] == (words in (1, 2))


@pytest.mark.parametrize(
    "keywords", [(), ("a",), ("C++",), ("ab", "É"), ("x", "y", "z"), tuple(f"k{i}" for i in range(200)) + ("b",)]
)
def test_keyword_tests(frame, keywords):
    texts = random_texts(500) + ["C++ in practice", "c plus", "aB é"]
    column = F.col("t")
    rows = evaluate(
        frame, texts, any_of=include_any(column, keywords), all_of=include_all(column, keywords),
        none_of=exclude(column, keywords),
    )
    for text, row in zip(texts, rows):
        hits = [] if text is None else [kw for kw in keywords if kw.lower() in text.lower()]
        assert row["any_of"] == bool(hits)
        assert row["all_of"] == (text is not None and len(hits) == len(keywords))
        assert row["none_of"] == (not hits)


def test_length_bounds_must_be_numbers():
    with pytest.raises(ValueError):
        length_between(F.col("t"), None, 5)


def test_keyword_lists(frame):
    text = " deep learning \n\n  \nC++\nréseau"
    assert parse_keywords(text) == ("deep learning", "C++", "réseau")
    (row,) = evaluate(frame, [text], words=keyword_array(F.col("t")))
    assert tuple(row["words"]) == parse_keywords(text)


def test_years(frame):
    cases = {
        "2020": 2020, "2020.0": 2020, " 2021 ": 2021, "2020.9": 2020, "-3.7": -3, "1e3": 1000,
        "2020-01-01": None, "nan": None, "inf": None, "0x10": None, "": None, None: None,
        "2020d": None, "2020f": None, "99999999999": None, "year": None,
    }
    rows = evaluate(frame, list(cases), year=parse_year(F.col("t")))
    assert [row["year"] for row in rows] == list(cases.values())
