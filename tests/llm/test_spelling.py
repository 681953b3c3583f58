"""Spelling variants against all pairs of words, on small vocabularies."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from titlesieve.llm import spelling
from titlesieve.llm.spelling import variants

DOCS = "doc_id long, text string, n long, word string, near string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def are_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(docs):
    words = counted(docs)
    rows, forms = {}, {}
    for word, n in words.items():
        near = [w for w in words if abs(len(w) - len(word)) < 2 and are_near(w, word)]
        best = min(near, key=lambda w: (-words[w], w), default=None)
        forms[word] = best if best and words[best] >= 10 * n else None
        rows[word] = [forms[word], n, len(near), words[forms[word]] if forms[word] else None]
    for word, row in rows.items():
        root = word
        while forms[root]:
            root = forms[root]
        row.insert(1, root)
    return rows


def found(docs):
    rows = variants(docs).collect()
    out = {r.word: [r.form, r.root, r.n, r.n_near, r.form_n] for r in rows}
    assert len(out) == len(rows)
    return out


def corpus():
    rng = random.Random(9)
    docs = []
    for i in range(400):
        words = []
        for _ in range(60):
            word = rng.choice(["Abcdefg", "abcdefgh", "mnopqrsté", "ÀÁÂÃ×÷ÿ", "aaaaaaaa", "zzzzzzzz"])
            if rng.random() < 0.15:
                at = rng.randrange(len(word))
                word = word[:at] + rng.choice(["", "x", "ÿ", word[at] * 2]) + word[at + 1 :]
            words.append(word)
        docs.append((i, rng.choice([" ", "-", "Ā", "1"]).join(words)))
    long = "q" * 70 + "w" * 5_000
    docs += [(1000 + i, f"{long} {long}") for i in range(12)] + [(2000, long[:-1] + " " + long[1:])] * 2
    docs += [(3000, "abcdefz " * 30_000), (3000, "abcdefz"), (None, "Nullword nullword nullwore nullwore")]
    return docs + [(3001, None), (3002, ""), (3003, "1 2 3 short")]


@pytest.mark.parametrize("filter_bytes", [spelling.FILTER_BYTES, 64])
def test_equal_to_comparing_all_pairs(frame, monkeypatch, filter_bytes):
    monkeypatch.setattr(spelling, "FILTER_BYTES", filter_bytes)
    monkeypatch.setattr(spelling, "CANDIDATES", 5_000)
    monkeypatch.setattr(spelling, "COUNTED", 50)
    docs = corpus()
    rows = found(frame(DOCS, [(*d, 1, "x", "y") for d in docs]))
    want = expected(docs)
    assert rows == want and sum(r[0] is not None for r in rows.values()) > 20


def test_forms_are_followed_to_the_last(frame):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2_000, "aaabbbb": 1_999}
    docs = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())]
    rows = found(frame(DOCS, [(*d, 1, "x", "y") for d in docs]))
    assert rows == expected(docs)
    assert [rows[w][1] for w in list(counts)[:4]] == ["aaaabbb"] * 4


def test_of_equal_counts_the_first_is_taken(frame):
    docs = [(1, "bbbbbbbx " * 2 + "bbbbbbbz " * 40 + "bbbbbbby " * 40)]
    rows = found(frame(DOCS, [(*d, 1, "x", "y") for d in docs]))
    assert rows == expected(docs) and rows["bbbbbbbx"][0] == "bbbbbbby"


def test_nothing(frame):
    assert found(frame(DOCS, [(1, "abcdefgh " * 9, 1, "x", "y")]).limit(0)) == {}
    assert found(frame(DOCS, [(1, None, 1, "x", "y"), (2, "abcdefgh", 1, "x", "y")])) == {}


def test_no_word_is_lost_by_a_filter():
    rng = np.random.default_rng(3)
    words = sorted({bytes(rng.integers(97, 123, 9).astype(np.uint8)) for _ in range(5_000)})
    hashes = spelling.word_hashes(words)
    blocks = np.ones(41, np.int64)
    blocks[9] = 4096
    first = np.cumsum(blocks) - blocks
    bits = np.zeros(blocks.sum(), np.uint64)
    block, mask = spelling._place(hashes, 4096)
    np.bitwise_or.at(bits, block + first[9], mask)
    filters = spelling.Filters(first, blocks, bits)
    assert filters.has(9, hashes).all()
    others = spelling.word_hashes([w[:-1] + b"_" for w in words])
    assert filters.has(9, others).mean() < 0.02
