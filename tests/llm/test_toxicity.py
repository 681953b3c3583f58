"""Toxicity against plain compression, held-out labels and awkward rows."""

import numpy as np
import pytest

from titlesieve.llm import toxicity
from titlesieve.llm.model_queries import op13_toxicity

DOCS = "doc_id long, text string, toxicity_score string, gain int"


def test_windows_cover_whole_texts():
    words = [b"ab", b"C" * 300, b"d"] * 50_000
    text = b" \n".join(words)
    found = [w for part in toxicity.windows(text) for w in part]
    assert b"".join(w for w in found if len(w) < 9) == b"abd" * 50_000
    pieces = [w for w in found if len(w) >= 9]
    assert max(map(len, pieces)) == 64 and min(map(len, pieces)) > 32
    assert list(toxicity.windows(b"")) == [] and list(toxicity.windows(b" \n ")) == [[]]


def test_pieces_hold_every_short_stretch():
    word = bytes(range(97, 123)) * 20
    pieces = toxicity._pieces(word)
    for at in range(len(word) - 31):
        assert any(word[at : at + 32] in piece for piece in pieces)


def test_gains_are_differences_of_compressed_lengths():
    gains = toxicity.Gains(b" scoundrel  blockhead ", b" the  morning  meeting  was ")
    assert gains.largest(b"the Scoundrel was") > 2 >= gains.largest(b"the morning meeting")
    frame = b" scoundrel " + toxicity._TAIL
    plain, toxic = (len(c.compress(frame)) for c in gains.coders)
    assert gains.known[b"scoundrel"] == plain - toxic
    assert gains.largest(b" \n") == toxicity._NO_WINDOW


def test_memory_of_gains_is_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_REMEMBERED", 10)
    gains = toxicity.Gains(b"x", b"y")
    for i in range(100):
        gains.largest(b"word%d other%d" % (i, i))
        assert len(gains.known) <= 10


def test_calibration_ascends():
    table = [(-3, 0, 50), (0, 0, 40), (0, 1, 2), (1, 0, 10), (4, 1, 8), (5, 1, 3), (5, 0, 1)]
    model = toxicity.ToxicityModel(b"", b"", **toxicity._calibrate(table, {0: 0.5, 1: 1.0}))
    scores = model.score(np.arange(-9, 9))
    assert (np.diff(scores) >= 0).all() and scores[0] < 0.05 < 0.5 < scores[-1] <= 1


def corpus(n):
    rng = np.random.default_rng(5)
    syllables = ["ba", "ke", "lo", "mi", "nu", "ra", "so", "ti"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables, 3)) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            words[int(rng.integers(60))] = ["scoundrel", "blockhead"][i % 8 // 4]
        docs.append((i, " ".join(words), "x", i))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_documents_are_told(frame):
    docs, labels = corpus(600)
    model = toxicity.fit(frame(DOCS, docs), frame("doc_id long, toxic int", labels[:400]))
    extra = [(600, None, "x", 0), (601, "", "x", 0), (602, "ba " * 400_000 + "blockhead", "x", 0),
             (602, "ba " * 400_000 + "blockhead", "x", 0), (None, " \n", None, None)]
    rows = toxicity.score(frame(DOCS, docs + extra), model).collect()
    assert len(rows) == 605 and set(rows[0].asDict()) == {"doc_id", "text", "toxicity_score", "gain"}
    right = [(r.toxicity_score >= toxicity.THRESHOLD) == (r.doc_id % 4 == 0)
             for r in rows if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert np.mean(right) > 0.95
    by = {r.doc_id: r.toxicity_score for r in rows}
    assert by[602] >= toxicity.THRESHOLD > by[600] == by[601] == by[None]


@pytest.mark.parametrize("labels, score", [([], 0.0), ([(1, 0)], 0.0), ([(1, 1), (None, 0)], 1.0)])
def test_without_one_of_the_labels(frame, labels, score):
    docs = frame(DOCS, [(1, "some words", "x", 0)])
    model = toxicity.fit(docs, frame("doc_id long, toxic int", labels))
    assert [r.toxicity_score for r in toxicity.score(docs, model).collect()] == [score]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_few_rows_do_not_stop_the_trainer(frame):
    docs = frame(DOCS, [(1, "one", "x", 0), (2, None, "x", 0), (3, "", "x", 0)])
    labels = frame("doc_id long, toxic int", [(1, 1), (2, 0), (3, 0), (9, 1)])
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 3


def test_query_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = op13_toxicity(spark, sf_dir).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
