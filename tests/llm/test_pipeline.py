"""The pipeline, each stage against brute force on what it was given."""

from pathlib import Path

import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.test_dedup import brute_near, brute_removal
from tests.llm.test_native import brute_contamination
from titlesieve.llm.batches import BYTES_AT_ONCE, ROWS_AT_ONCE, give_back, map_batches
from titlesieve.sources.storage import materialise

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows that go into each stage, and the last one's result."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = [(9_000 + i, t, None, None, None) for i, t in enumerate([None, "", "1 2 3", "---"])]
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(spark.createDataFrame(extra, DOCS))
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF_DIR), name)
        seen.append(docs.collect())
    return seen


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "minhash_dedup", "substring_dedup", "decontamination", "sentencepiece",
    ]


def test_texts_without_letters_go_and_all_others_stay(stages):
    assert {r.doc_id for r in stages[1]} == {r.doc_id for r in stages[0] if r.doc_id < 9_000}
    assert [r.asDict() for r in stages[1]][0].keys() == stages[0][0].asDict().keys()


def test_one_of_each_group_of_near_copies_stays(stages):
    low = brute_near([(r.doc_id, r.text) for r in stages[1]])
    assert {r.doc_id for r in stages[2]} == set(low.values())


def test_repeated_passages_go(stages):
    expected = brute_removal([(r.doc_id, r.text) for r in stages[2]])
    texts = {r.doc_id: r.text for r in stages[2]}
    want = {i: kept if gone else texts[i] for i, (_, gone, _, kept) in expected.items() if kept or not gone}
    assert {r.doc_id: r.text for r in stages[3]} == want
    assert all(r.n_chars == len(r.text) for r in stages[3])


def test_contaminated_documents_go(stages, spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    found = brute_contamination([(r.doc_id, r.text) for r in stages[3]], items)
    assert {r.doc_id for r in stages[4]} == {i for i, _, hit, _ in found if not hit}
    assert any(hit for _, _, hit, _ in found)


def test_encoded_documents(stages):
    import sentencepiece

    from titlesieve.llm.token_queries import piece_model

    processor = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    texts = {r.doc_id: r.text for r in stages[4]}
    assert {r.doc_id for r in stages[5]} == set(texts)
    for r in stages[5]:
        assert r.ids == processor.encode(texts[r.doc_id]) and r.n_pieces == len(r.ids)
        assert all(processor.decode(s.ids) == texts[r.doc_id] for s in r.samples)


def test_columns_of_any_name_come_through(frame, spark):
    from titlesieve.llm import minhash, sentencepiece_sampling, substring_dedup
    from titlesieve.llm.decontamination import decontaminate
    from titlesieve.llm.token_queries import piece_model

    inner = ["__id", "__hash", "__spans", "__d1", "__d2", "__seed", "__text", "__changed", "__other0", "rep", "spans", "a.b"]
    schema = "doc_id long, text string, n_chars int, " + ", ".join(f"`{c}` string" for c in inner)
    words = " ".join(f"w{i}" for i in range(40))
    texts = {1: words, 2: words + " tail", 3: "other words here", 5: None}
    rows = [(i, t, 7, *[f"{c}{i}" for c in inner]) for i, t in texts.items()] + [(5, "x y z", 7, *inner)]
    docs = frame(schema, rows)
    bench = frame("item_id long, text string", [(1, "other words here")])
    results = [
        decontaminate(docs, bench), substring_dedup.remove_repeats(docs), minhash.drop_near_duplicates(docs),
        sentencepiece_sampling.segment(docs, piece_model()).drop("ids", "samples"),
    ]
    for result in results:
        assert result.columns == docs.columns
        got = result.collect()
        assert got and all(r["a.b"] == (f"a.b{r.doc_id}" if r.text != "x y z" else "a.b") for r in got)
    assert sorted(r.doc_id for r in results[0].collect()) == [1, 2, 5, 5]
    assert {r.doc_id: r.text for r in results[1].collect() if r.doc_id < 5} == {1: words, 2: "tail", 3: "other words here"}
    assert sorted(r.doc_id for r in results[2].collect()) == [1, 3, 5, 5]


def test_without_any_labelled_language_all_stay(frame, spark):
    docs = frame(DOCS, [(1, "some words", None, "x", 10), (2, None, None, "x", 0)])
    assert corpus_pipeline.known_language(spark, docs, SF_DIR).count() == 2


def test_stages_take_rows_in_small_batches(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        corpus_pipeline.ready(spark)
        assert int(spark.conf.get(setting)) == ROWS_AT_ONCE
    finally:
        spark.conf.set(setting, before)


def test_stages_take_few_bytes_of_text_at_a_time(spark):
    settings = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(setting) for setting in settings]

    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64())], ["n"])

    try:
        corpus_pipeline.ready(spark)
        rows = spark.range(0, 600, 1, 1).selectExpr("id", "repeat('0123456789', 400) AS text")
        seen = [r.n for r in map_batches(rows, sizes, "n long").collect()]
    finally:
        for setting, value in zip(settings, before):
            spark.conf.set(setting, value)
    assert sum(seen) == 600 and max(seen) * 4_000 <= 2 * BYTES_AT_ONCE


@pytest.mark.skipif(not Path("/proc/self/statm").exists(), reason="memory is read from /proc")
def test_freed_memory_is_given_back():
    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4_096

    some = [b"x" * (4_000 + i % 2) for i in range(20_000)]
    held = some[::200]  # what stays keeps the heap from shrinking from its end
    full = resident()
    del some
    give_back()
    assert len(held) == 100 and full - resident() > 40_000_000
