import random
import re
from collections import Counter

import pytest

from titlesieve.functions.stopwords import STOP_WORDS
from titlesieve.operators.words import with_relative, word_counts, word_frequencies
from tests.test_text import random_texts


def expected(texts, top_n, stop_words):
    """Runs of word characters that are nothing but three or more ASCII letters."""
    counts = Counter()
    for text in texts:
        runs = re.findall(r"\w+", (text or "").lower())
        counts.update(run for run in runs if re.fullmatch("[a-z]{3,}", run) and run not in stop_words)
    return counts.most_common(top_n)


def test_there_are_119_stop_words():
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 119


@pytest.mark.parametrize("top_n", [1, 30, 5000])
def test_frequencies_and_ties(frame, top_n):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "the", "éaea", "don't", "x_yzw", "ab", "Using", "delta2", "UPPER"]
    texts = random_texts(400) + [" ".join(rng.choices(words, k=9)) for _ in range(200)]
    df = frame("row_id long, title string", enumerate(texts))
    got = word_frequencies(df, "title", top_n).collect()
    assert [(row.word, row["count"]) for row in got] == expected(texts, top_n, STOP_WORDS)


def test_stop_words_from_a_table(frame):
    texts = ["alpha beta alpha", "beta gamma the"]
    df = frame("row_id long, title string", enumerate(texts))
    stops = frame("word string", [("alpha",), ("unheard",)])
    got = word_frequencies(df, "title", 10, stops).collect()
    assert [(row.word, row["count"]) for row in got] == expected(texts, 10, {"alpha"})


def test_no_words_asked_for(frame):
    df = frame("row_id long, title string", [(0, "alpha")])
    assert word_frequencies(df, "title", 0).count() == 0
    assert word_frequencies(df, "title", -4).count() == 0


def test_relative_to_the_largest(frame):
    df = frame("row_id long, title string", [(0, "alpha alpha alpha alpha beta gamma gamma")])
    got = with_relative(word_frequencies(df, "title")).collect()
    assert [(row.word, row.relative) for row in got] == [("alpha", 100.0), ("gamma", 50.0), ("beta", 25.0)]


@pytest.mark.parametrize("ids", [(1 << 40, 1 << 41), (-5, 3), (-(1 << 63), (1 << 63) - 1), (64 << 33, 65 << 33)])
def test_any_id_orders_first_occurrences(frame, ids):
    df = frame("row_id long, title string", [(ids[1], "beta alpha"), (ids[0], "gamma beta")])
    assert [row.word for row in word_frequencies(df, "title").collect()] == ["beta", "gamma", "alpha"]
    assert word_counts(df, "title").count() == 3
