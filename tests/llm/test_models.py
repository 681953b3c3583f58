"""Language identification and quality scores."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from titlesieve.llm import language_id, quality
from titlesieve.llm.language_id import UNDETERMINED, fit, identify
from titlesieve.llm.model_queries import op2_language_id, op8_quality
from titlesieve.llm.textscan import text_slices

DOCS = "doc_id long, text string, lang string, lang_pred string, lang_score string"
SF_DIR = "/root/testdata/sf0.01"
LEARN = [(i, f"the cat and the dog {i}", "en", "x", "y") for i in range(8)]
LEARN += [(i + 8, f"der hund und die katze {i}", "de", "x", "y") for i in range(8)]


def brute_scores(rows, text):
    """Naive Bayes over the same buckets, one n-gram at a time."""
    def buckets(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        for order in language_id.ORDERS:
            for k in range(len(t) - order + 1):
                value = 0
                for c in t[k : k + order]:
                    value = value * 0x100000001B3 + ord(c)
                yield ((value + order) * 0x9E3779B97F4A7C15 % 2**64) >> 48

    scores = {}
    langs = sorted({r[2] for r in rows if r[2]})
    for lang in langs:
        own = [r for r in rows if r[2] == lang]
        counts = {}
        for r in own:
            for b in buckets(r[1]):
                counts[b] = counts.get(b, 0) + 1
        total = sum(counts.values()) + language_id.SMOOTHING * language_id.BUCKETS
        scores[lang] = math.log(len(own) / sum(bool(r[2]) for r in rows)) + sum(
            math.log((counts.get(b, 0) + language_id.SMOOTHING) / total) for b in buckets(text)
        )
    most = max(scores.values())
    odds = {k: math.exp(v - most) for k, v in scores.items()}
    return {k: v / sum(odds.values()) for k, v in odds.items()}


def test_language_scores_are_those_of_naive_bayes(frame):
    model = fit(frame(DOCS, LEARN), F.lit(True))
    texts = ["the", "die", "katze and", "Hund", "é", "x" * 50, "a"]
    rows = identify(frame(DOCS, [(i, t, None, "x", "y") for i, t in enumerate(texts)]), model).collect()
    for row in rows:
        expected = brute_scores(LEARN, row.text)
        best = max(expected, key=expected.get)
        assert row.lang_pred == best and row.lang_score == pytest.approx(expected[best], abs=1e-4)


def test_language_of_awkward_rows(frame):
    model = fit(frame(DOCS, LEARN), F.lit(True))
    texts = [None, "", " \n", "123 !?", "the " * 100_000, "日本", "the", "the"]
    rows = identify(frame(DOCS, [(i, t, None, None, None) for i, t in enumerate(texts)]), model)
    assert rows.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score"]
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in rows.collect()}
    assert [got[i] for i in range(4)] == [(UNDETERMINED, 0.0)] * 4
    assert got[4] == ("en", 1.0) and got[5][0] in ("de", "en") and got[6] == got[7]


def test_language_without_labels_or_rows(frame):
    nothing = fit(frame(DOCS, [(1, "the", None, "", ""), (2, None, "en", "", "")]), F.lit(True))
    assert nothing is None
    assert identify(frame(DOCS, LEARN[:1]), nothing).head().lang_pred == UNDETERMINED
    assert identify(frame(DOCS, []), fit(frame(DOCS, LEARN), F.lit(True))).collect() == []


def test_held_out_languages(spark):
    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = op2_language_id(spark, SF_DIR).join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_statistics_do_not_depend_on_neighbours():
    texts = ["", None, "Hello hello HELLO!! a|b", "x", "w w w w\nw w w w\n", "é" * 300, "a b " * 5_000]
    def all_rows(column):
        return np.concatenate([quality.statistics(d, o) for _, _, d, o in text_slices(pa.array(column))])
    together = all_rows(texts)
    alone = np.concatenate([all_rows([t]) for t in texts])
    assert np.allclose(together, alone)
    assert not together[:2].any()
    names = dict(zip(quality.STATISTICS, together[4]))
    assert names["line_repeats"] == 0.5 and names["distinct_words"] == 1 / 8 and names["repeats_next"] == 7 / 8


def test_trees_find_a_known_rule():
    rng = np.random.default_rng(1)
    x = rng.random((2_000, 5))
    y = ((x[:, 1] > 0.6) ^ (x[:, 3] > 0.3)).astype(float)
    trees = quality.fit_trees(x[:1_500], y[:1_500], trees=40)
    assert ((trees.score(x[1_500:]) > 0.5) == y[1_500:]).mean() > 0.97


def test_trees_of_one_class_and_of_no_rows(frame):
    trees = quality.fit_trees(np.ones((30, 3)), np.ones(30), trees=3)
    assert (trees.score(np.zeros((2, 3))) > 0.9).all()
    docs = quality.with_statistics(frame("doc_id long, text string, quality_score string", [(1, None, "x"), (None, "t", "x")]))
    none = quality.fit(docs, frame("doc_id long, quality int", [(1, None), (None, 1), (9, 1)]))
    rows = quality.score(docs, none).collect()
    assert [r.quality_score for r in rows] == [0.5, 0.5]
    assert quality.score(docs.limit(0), none).collect() == []


def test_held_out_quality(spark):
    truth = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = op8_quality(spark, SF_DIR)
    assert rows.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    held = rows.join(truth, "doc_id").where("held_out").collect()
    assert sum(r.quality == r.predicted for r in held) / len(held) > 0.93
