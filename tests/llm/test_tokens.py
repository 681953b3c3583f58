"""Token output and SentencePiece segmentations."""

import collections
import math
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from titlesieve.llm import sentencepiece_sampling as sps
from titlesieve.llm import token_output
from titlesieve.llm.idstore import IdStore
from titlesieve.llm.lattice import Lattice
from titlesieve.llm.textscan import text_slices
from titlesieve.llm.wavelet import WaveletFile, pack

DOCS = "doc_id long, text string, ids string, samples string"
VOCABULARY = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
MODEL = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
PARTS = [
    " ", " ", "  ", "a", "b", "É", "é", "　", " ", "\u0085", "\n", "\t", "'s", "12", "!", "日本", "😀",
    "<|endoftext|>", "\x1c", "\r", "don't", "the", " ", " ", "Â", "à", "▁", "</s>", "<0x0A>", "ing",
]


def random_texts(seed, n=400, most=25):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_str(VOCABULARY)


@pytest.fixture(scope="module")
def segmenter():
    return sps.Segmenter(MODEL)


@pytest.mark.parametrize("seed", range(3))
def test_pieces_encode_like_whole_texts(tokenizer, seed):
    texts, encoder = random_texts(seed), token_output.PieceEncoder(VOCABULARY)
    for first, after, data, offsets in text_slices(pa.array(texts)):
        ids, counts = encoder.encode(data, offsets)
        for text, got in zip(texts[first:after], np.split(ids, np.cumsum(counts)[:-1])):
            assert [*tokenizer.encode(text, add_special_tokens=False).ids, 2] == list(got), repr(text)


@pytest.mark.parametrize("n", [0, 1, 7, 512, 513, 3_000])
def test_wavelet_matrix(n):
    tokens = np.random.default_rng(n).integers(0, 300, n).astype(np.uint32)
    file = WaveletFile(pack(tokens, np.array([5, 0]), np.array([False, True]), np.array([n, 0])))
    assert (file.tokens() == tokens).all()
    assert [file.access(i) for i in range(0, n, 11)] == tokens[::11].tolist()
    for token in {*tokens[:5].tolist(), 299, 70_000}:
        at = np.flatnonzero(tokens == token)
        assert file.count(token) == len(at)
        assert file.count(token, n // 3, n // 2) == ((at >= n // 3) & (at < n // 2)).sum()
        assert [file.locate(token, k) for k in range(0, len(at), 3)] == at[::3].tolist()
        with pytest.raises(IndexError):
            file.locate(token, len(at))
    assert file.doc_ids.tolist() == [5, 0] and file.nulls.tolist() == [False, True]
    with pytest.raises(ValueError):
        WaveletFile(b"something else")


@pytest.mark.parametrize("shard_tokens", [40, 4_000_000])
def test_shards_give_back_all_ids(spark, frame, tmp_path, tokenizer, shard_tokens):
    rows = [(i * 3 % 101, t) for i, t in enumerate(random_texts(7, 101))]
    rows += [(500, None), (501, ""), (502, "word " * 20_000), (7, "same id"), (7, "same id"), (None, "no id")]
    path = str(tmp_path / "shards")
    token_output.write_shards(frame(DOCS, [(*r, "x", "x") for r in rows]), VOCABULARY, path, shard_tokens)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, expected, all_ids = 0, [], []
    for i, text in ordered:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        all_ids.append(ids)
        start += len(ids)
    got = token_output.document_digests(spark, path).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    read = sorted(token_output.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.ids for r in read] == all_ids
    if shard_tokens == 40:
        assert spark.read.parquet(path).count() > 20


def test_shards_of_nothing(spark, frame, tmp_path):
    path = str(tmp_path / "none")
    token_output.write_shards(frame(DOCS, []), VOCABULARY, path)
    assert token_output.document_digests(spark, path).collect() == []


def test_store_starts_anew(monkeypatch):
    monkeypatch.setattr("titlesieve.llm.idstore.MOST_PIECES", 10)
    store = IdStore(lambda texts: [[ord(c) for c in t] for t in texts])
    for first in range(0, 60, 6):
        hashes = np.arange(first, first + 6, dtype=np.uint64)
        places = store.find(hashes, lambda i, f=first: "ab"[: i % 3] * (f // 6))
        ids, sizes = store.ids(places)
        assert sizes.tolist() == [len("ab"[: i % 3]) * (first // 6) for i in range(6)]
        assert len(ids) == sizes.sum()


def layouts(segmenter, texts):
    for first, after, data, offsets in text_slices(pa.array(texts)):
        yield first, after, segmenter.layout(*sps.marks_as_spaces(data, offsets))


@pytest.mark.parametrize("seed", range(3))
def test_words_encode_like_whole_texts(segmenter, seed):
    texts = random_texts(seed, 1_500)
    for first, after, layout in layouts(segmenter, texts):
        ids, counts = segmenter.encode(layout)
        for text, got in zip(texts[first:after], np.split(ids, np.cumsum(counts)[:-1])):
            assert segmenter.processor.encode(text) == list(got), repr(text)


def test_samples_differ_and_decode(segmenter):
    texts = random_texts(11, 600) + ["", "a" * 3_000]
    for first, after, layout in layouts(segmenter, texts):
        samples = segmenter.sample(layout, np.arange(after - first), 4)
        for text, row in zip(texts[first:after], samples):
            assert len({tuple(s.ids) for s in row}) == len(row) >= 1
            assert sorted((s.perturbed for s in row), reverse=True) == [s.perturbed for s in row]
            for s in row:
                assert s.log_prob <= 0 and s.log_inclusion <= 0
                assert segmenter.decode(s.ids, np.array([0, len(s.ids)]))[0].decode() == text.replace("▁", " ")


def test_samples_follow_the_distribution(segmenter):
    """First and second samples, and the inclusion scores, against listing all paths."""
    text, n = "the ab", 8_000
    pieces = {}
    for i in range(segmenter.vocabulary.size):
        p = segmenter.processor
        if not (p.is_control(i) or p.is_byte(i) or p.is_unknown(i)):
            pieces[p.id_to_piece(i)] = i

    def paths(word):
        if not word:
            return [((), 0.0)]
        return [
            ((pieces[word[:k]], *ids), weight + segmenter.vocabulary.log_weight[pieces[word[:k]]])
            for k in range(1, len(word) + 1) if word[:k] in pieces for ids, weight in paths(word[k:])
        ]

    whole = {a + b: v + w for a, v in paths("▁the") for b, w in paths("▁ab")}
    total = sum(map(math.exp, whole.values()))
    p = {ids: math.exp(w) / total for ids, w in whole.items()}
    (_, _, layout), = layouts(segmenter, [text] * n)
    rows = segmenter.sample(layout, np.arange(n), 3)
    first = collections.Counter(tuple(r[0].ids) for r in rows)
    second = collections.Counter(tuple(r[1].ids) for r in rows)
    for ids, share in p.items():
        assert first[ids] / n == pytest.approx(share, abs=0.025)
        then = sum(p[j] * share / (1 - p[j]) for j in p if j != ids)
        assert second[ids] / n == pytest.approx(then, abs=0.025)
    assert all(s.log_prob == pytest.approx(math.log(p[tuple(s.ids)]), abs=1e-6) for r in rows[:50] for s in r)
    weights = [sum(math.exp(s.log_prob - s.log_inclusion) for s in r) for r in rows]
    assert np.mean(weights) == pytest.approx(1, abs=0.02)


def test_bounds_left_out_do_not_change_samples(segmenter):
    texts = [" ".join(random.Random(i).choices(["the", "thing", "ab", "question"], k=300)) for i in range(20)]
    (_, _, layout), = layouts(segmenter, texts)
    near = segmenter.sample(layout, np.arange(20), 4)
    full = segmenter.sample(layout, np.arange(20), 4, np.inf)
    for x, y in zip(near, full):
        assert [(s.ids.tolist(), s.perturbed) for s in x] == [(s.ids.tolist(), s.perturbed) for s in y]


def test_a_word_has_the_same_numbers_beside_wider_ones(segmenter):
    words = ["andhaheer", "Dieerstpfch", "anderntwher", "beiesch", "", " ", "日本"]
    for word in words:
        numbers = []
        for beside in ([], ["ancellationToken"], ["ancellationToken" * 3, "a"]):
            lattice = Lattice([*beside, word], segmenter.vocabulary)
            edges = lattice.edges_of(int(lattice.first_node[-1]))
            numbers.append((lattice.ids(edges)[0].tolist(), lattice.log_p(edges).tolist()))
        assert numbers[0] == numbers[1] == numbers[2]


def test_many_rows_are_sampled_like_one(segmenter):
    texts = random_texts(5, 700)
    for first, after, layout in layouts(segmenter, texts):
        together = segmenter.sample(layout, np.arange(first, after), 2)
        for i in range(first, after, 7):
            (_, _, alone), = layouts(segmenter, [texts[i]])
            one, = segmenter.sample(alone, np.array([i]), 2)
            assert [(s.ids.tolist(), *s[1:]) for s in one] == [
                (s.ids.tolist(), *s[1:]) for s in together[i - first]
            ]


def test_segmentations_in_spark(frame):
    texts = [None, "", "plain words here", "plain words here", "▁marks ▁", "long " * 20_000, "a"]
    docs = frame(DOCS, [(i, t, "x", "x") for i, t in enumerate(texts)] + [(None, "no id", "x", "x")])
    coded = sps.decode(sps.encode(docs, MODEL), MODEL)
    assert coded.columns == ["doc_id", "text", "samples", "ids", "decoded"]
    for r in coded.collect():
        assert r.decoded == (r.text or "").replace("▁", " ")
    rows = sps.segment(docs, MODEL, k=2).collect()
    digests = {r.doc_id: r for r in sps.digests(docs, MODEL, k=2).collect()}
    for r in rows:
        assert len({tuple(s.ids) for s in r.samples}) == len(r.samples) >= 1
        d = digests[r.doc_id]
        assert d.round_trip and [s.ids_crc32 for s in d.samples] == [
            zlib.crc32(np.array(s.ids, "<u4").tobytes()) for s in r.samples
        ]
    assert sps.digests(docs.limit(0), MODEL).collect() == []


def test_a_lost_mark_is_reported(frame):
    texts = [None, "", "plain words", "▁marks ▁", "a▁", " ▁ spaces", "é 日本"]
    docs = frame(DOCS, [(i, t, "x", "x") for i, t in enumerate(texts)])
    for r in sps.decode(sps.encode(docs, MODEL), MODEL).join(sps.digests(docs, MODEL, k=2), "doc_id").collect():
        assert r.same_text == (r.decoded == (r.text or "")) == ("▁" not in (r.text or ""))
        assert r.round_trip


def test_samples_depend_on_the_key_only(frame):
    docs = [(i, "some words of a text", "x", "x") for i in range(30)]
    one = {r.doc_id: r.samples for r in sps.segment(frame(DOCS, docs), MODEL).collect()}
    other = {r.doc_id: r.samples for r in sps.segment(frame(DOCS, docs[::-1]).repartition(7), MODEL).collect()}
    assert one == other
    assert len({tuple(s[0].ids) for s in one.values()}) >= 5


def thue_morse(n=2_048):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_equal_hash_get_their_own_ids(segmenter):
    """Long words of the Thue-Morse sequence and its complement have equal 64-bit hashes."""
    x, y = thue_morse()
    for texts in ([f"one {x} two", f"one {y} two"], [x, "z " + y], [f"one {y} two {x}"]):
        encoder = token_output.PieceEncoder(VOCABULARY)
        for some in ([texts[0]], texts, texts[::-1]):  # within one slice, and against the store
            data, offsets = column_bytes(some)
            ids, counts = encoder.encode(data, offsets)
            want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in some]
            assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))
            layout = segmenter.layout(data, offsets)
            ids, counts = segmenter.encode(layout)
            want = segmenter.processor.encode(some)
            assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))


def column_bytes(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_texts_encoded_together_keep_their_ids():
    encoder = token_output.PieceEncoder(VOCABULARY)
    mark = encoder.added[0]
    texts = ["a", f"b {mark} c", mark, "d  e", "", f" {mark}{mark}", " x", " y\u00a0", " \u3000z", " don't",
             " 's", " \n", " é\u0301", " 日本", " \u2028", "  q", " a b", " 1.5", " ..."] * 20
    rng = np.random.default_rng(1)
    for _ in range(5):
        some = [texts[i] for i in rng.permutation(len(texts))]
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
        ids, sizes = encoder._encode(some)
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_store_keeps_what_comes_again(monkeypatch):
    monkeypatch.setattr("titlesieve.llm.idstore.MOST_PIECES", 10)
    asked = []

    def encode(texts):
        asked.extend(texts)
        return [[ord(c) for c in t] for t in texts]

    store = IdStore(encode)
    for first in range(3, 60, 6):
        texts = ["the", "of", *[f"rare{i}" for i in range(first, first + 6)]]
        places = store.find(np.array([0, 1, *range(first, first + 6)], np.uint64), texts.__getitem__)
        ids, sizes = store.ids(places)
        assert bytes(ids.tolist()).decode() == "".join(texts) and sizes.tolist() == list(map(len, texts))
    assert asked.count("the") == asked.count("of") == 1


def test_rows_of_a_layout_are_sampled_in_parts(segmenter, monkeypatch):
    texts = random_texts(3, 200)
    (layout,) = [layout for _, _, layout in layouts(segmenter, texts)]
    keys = np.arange(len(texts))
    whole = segmenter.sample(layout, keys, 2)
    monkeypatch.setattr(sps, "WALKED_WORDS", 7)
    parts = segmenter.sample(layout, keys, 2)
    assert [[(s.ids.tolist(), *s[1:]) for s in row] for row in parts] == [
        [(s.ids.tolist(), *s[1:]) for s in row] for row in whole
    ]
