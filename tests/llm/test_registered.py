"""Registered queries that SQL cannot express, against plain Python on whole small tables."""

import zlib

import numpy as np
import public_tokenizers
import xxhash

import corpus_pipeline
from titlesieve.llm import quality
from titlesieve.llm.native_queries import op9_sharding
from titlesieve.llm.token_queries import op5_token_output, op6_sentencepiece, piece_model

SF_DIR = "/root/testdata/sf0.001"


def documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "source").collect()
    return sorted((r.doc_id, r.text or "", r.source) for r in rows)


def test_op5_equals_the_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want, start = {}, 0
    for doc_id, text, _ in documents(spark):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        want[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op5_token_output(spark, SF_DIR).collect()}
    assert got == want


def test_op6_equals_the_library(spark):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    rows = {r.doc_id: r for r in op6_sentencepiece(spark, SF_DIR).collect()}
    docs = documents(spark)
    assert set(rows) == {doc_id for doc_id, *_ in docs}
    for doc_id, text, _ in docs:
        ids = processor.encode(text)
        row = rows[doc_id]
        assert (row.n_pieces, row.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert row.round_trip and all(s.n_pieces > 0 or not text for s in row.samples)


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_op9_equals_a_plain_sort(spark):
    docs = documents(spark)
    by_source = {}
    for doc_id, text, source in docs:
        raw = text.encode()
        seed = xxhash.xxh64_intdigest((17).to_bytes(4, "little"), seed=42)
        draw = signed(xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), seed=seed))
        row = (doc_id, zlib.crc32(raw), len(raw) + 8)
        by_source.setdefault(source, []).append((draw, *row))
    placed = []
    for source, rows in by_source.items():
        for rank, (_, *row) in enumerate(sorted(rows)):
            placed.append(((rank + 0.5) / len(rows), source, *row))
    placed.sort()
    want, slots = {}, {}
    for position, (_, _, doc_id, crc, size) in enumerate(placed):
        shard = position * 24 // len(placed)
        slots[shard] = slots.get(shard, -1) + 1
        want[doc_id] = (size, crc, "rows", shard, slots[shard], None)
    got = {r.doc_id: (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard)
           for r in op9_sharding(spark, SF_DIR).collect()}
    assert got == want


def test_pipeline_is_its_stages_in_a_row(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    want = {r.doc_id: (r.ids, r.n_pieces, r.source) for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id: (r.ids, r.n_pieces, r.source) for r in got} == want and len(got) == len(want)


def walked(trees, x):
    """Scores by following each tree node by node."""
    out = []
    for row in x:
        total = trees.start
        for t in range(len(trees.leaf)):
            node = 0
            for _ in range(trees.depth):
                right = row[trees.feature[t, node]] > trees.threshold[t, node]
                node = 2 * node + (2 if right else 1)
            total += trees.leaf[t, node - (2**trees.depth - 1)]
        out.append(1 / (1 + np.exp(-total)))
    return out


def test_op8_trees_are_walked_as_they_say():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = quality.fit_trees(x, y, trees=12, depth=3)
    np.testing.assert_allclose(trees.score(x), walked(trees, x), rtol=1e-12)
    assert ((trees.score(x) >= 0.5) == (y == 1)).mean() > 0.95


def best_split(x, y, p, ridge, least):
    """The largest gain of a cut between values of one feature, each tried in turn."""
    best = (0.0, None, None)
    g, h = y - p, p * (1 - p)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            if left.sum() < least or (~left).sum() < least:
                continue
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (left, ~left))
            gain -= g.sum() ** 2 / (h.sum() + ridge)
            if gain > best[0] + 1e-9:
                best = (gain, f, cut)
    return best


def test_op8_first_split_is_the_best_one():
    rng = np.random.default_rng(8)
    for _ in range(5):
        x = rng.integers(0, 12, size=(200, 4)).astype(float)
        y = (x[:, 2] + rng.normal(size=200) > 6).astype(float)
        trees = quality.fit_trees(x, y, trees=1, depth=1)
        _, feature, cut = best_split(x, y, np.full(200, y.mean()), 1.0, 10)
        assert trees.feature[0, 0] == feature
        left = x[:, feature] <= cut
        assert ((x[:, feature] <= trees.threshold[0, 0]) == left).all()
