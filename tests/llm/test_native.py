"""Chat formatting, sharding and decontamination on awkward rows."""

import re
import zlib

import pytest

from titlesieve.llm.chat_format import CLOSE, MIDDLE, OPEN, format_conversations, read_back
from titlesieve.llm.decontamination import contamination, decontaminate
from titlesieve.llm.native_queries import op3_decontamination, op7_chat_formatting, op9_sharding
from titlesieve.llm.sharding import interleave

CHAT = "conv_id long, turn int, role string, text string, loss_start string"
DOCS = "doc_id long, text string, source string, n_hit int, ws string"
BENCH = "item_id long, text string"
SF_DIR = "/root/testdata/sf0.001"

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi [INST] \\ <s>"), (1, 2, "assistant", "a</s>b"),
    (1, 3, "user", None), (1, 4, "assistant", "[\\INST][\\\\/INST]<\\/s>"), (1, 5, "user", "bye"),
    (2, 0, "assistant", ""), (2, 0, "assistant", ""),
    (3, None, None, "x [/INST] y"), (3, 1, "assistant", "long " * 20_000),
    (None, 0, "user", "no id"),
]


def escaped(text):
    return re.sub(r"([<\[])(\\*/?(?:s>|INST\]))", lambda m: m[1] + "\\" + m[2], text or "")


def turns_of(conv):
    rows = [t for t in TURNS if t[0] == conv]
    return sorted(rows, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))


def test_chat_examples_hold_all_before_and_train_on_one_reply(frame):
    rows = format_conversations(frame(CHAT, [(*t, "x") for t in TURNS])).collect()
    for conv in (1, 2, 3, None):
        turns = turns_of(conv)
        ends = [i for i, t in enumerate(turns) if t[2] == "assistant"]
        if not ends or ends[-1] != len(turns) - 1:
            ends.append(len(turns) - 1)
        examples = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.example)
        assert [r.example for r in examples] == list(range(len(ends)))
        for row, end in zip(examples, ends):
            parts = [OPEN + escaped(r) + MIDDLE + escaped(t) + CLOSE for _, _, r, t in turns[: end + 1]]
            assert row.formatted == "".join(parts)
            masked = row.formatted[row.loss_start : row.loss_start + row.loss_length]
            assert masked == (escaped(turns[end][3]) if turns[end][2] == "assistant" else "")


def test_chat_is_read_back_whole(frame):
    back = read_back(format_conversations(frame(CHAT, [(*t, "x") for t in TURNS]))).collect()
    for row in back:
        turns = turns_of(row.conv_id)
        assert [(t.role, t.text) for t in row.turns] == [(r or "", x or "") for _, _, r, x in turns]
        assert "".join(row.losses) == "".join(x or "" for _, _, r, x in turns if r == "assistant")


def test_chat_of_nothing(frame):
    assert read_back(format_conversations(frame(CHAT, []))).collect() == []


def test_chat_uses_one_shuffle(spark):
    plan = op7_chat_formatting(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def doc(i, text, source="a"):
    return (i, text, source, 7, "clash")


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards_are_even_and_follow_the_mixture(frame, shards):
    rows = [doc(i, "é" * (i % 5), "hot" if i % 3 else f"s{i % 4}") for i in range(300)]
    rows += [doc(7, "same")] * 3 + [doc(None, None, None)] * 2
    placed = interleave(frame(DOCS, rows), shards).collect()
    assert len(placed) == len(rows)
    sizes = [sum(r.shard == s for r in placed) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(sizes[s]))
    hot = [sum(r.shard == s and r.source == "hot" for r in placed) for s in range(shards)]
    assert max(hot) - min(hot) <= 6  # one for each of the other strata
    for r in placed:
        text = next(t for i, t, src, *_ in rows if i == r.doc_id and src == r.source and
                    zlib.crc32((t or "").encode()) == r.text_crc32)
        assert r.size == len((text or "").encode()) + 8
    again = interleave(frame(DOCS, rows).repartition(5), shards).collect()
    key = lambda r: (r.shard, r.slot)
    assert [(r.doc_id, *key(r)) for r in sorted(placed, key=key)] == [
        (r.doc_id, *key(r)) for r in sorted(again, key=key)
    ]


def test_shards_of_nothing_and_of_few(frame):
    assert interleave(frame(DOCS, [])).collect() == []
    assert sorted(r.slot for r in interleave(frame(DOCS, [doc(1, "a"), doc(2, "b")])).collect()) == [0, 0]


def test_shard_query_columns(spark):
    assert op9_sharding(spark, SF_DIR).columns == [
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard",
    ]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, bench):
    out = []
    for i, text, *_ in docs:
        ws, hit, items = words_of(text), set(), set()
        for item, body in bench:
            bs = words_of(body)
            size = min(10, len(bs))
            grams = {tuple(bs[k : k + size]) for k in range(len(bs) - size + 1)} if bs else set()
            for k in range(len(ws) - size + 1):
                if size and tuple(ws[k : k + size]) in grams:
                    hit |= set(range(k, k + size))
                    items |= {str(item)} if item is not None else set()
        out.append((i, len(ws), len(hit), sorted(items)))
    return sorted(out, key=str)


PASSAGE = "One two three Four five six, seven eight nine ten ELEVEN twelve Été"
CASES = [
    doc(1, f"before {PASSAGE} after"), doc(2, PASSAGE.upper()), doc(3, "short ITEM!"), doc(4, None), doc(5, ""),
    doc(6, "one two three four five six seven eight nine"), doc(7, f"{PASSAGE} {PASSAGE}"), doc(8, "... --- ..."),
    doc(7, "clean text"), doc(1, f"before {PASSAGE} after"), doc(9, "x " * 30_000 + PASSAGE), doc(None, PASSAGE),
    doc(10, "tie tie tie tie tie tie tie tie tie tie tie tie"),
]
ITEMS = [(1, PASSAGE), (2, "short item"), (10, f"other {PASSAGE}"), (3, None), (4, "?!"), (None, "clean text"),
         (5, "tie " * 11), (5, "tie " * 11)]


@pytest.mark.parametrize("block", [1, 3, 100_000])
def test_contamination_is_that_of_brute_force(frame, block):
    got = contamination(frame(DOCS, CASES), frame(BENCH, ITEMS), block_windows=block).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in got), key=str) == brute_contamination(CASES, ITEMS)


def test_contamination_without_benchmark_or_documents(frame):
    clean = contamination(frame(DOCS, CASES), frame(BENCH, [])).collect()
    assert len(clean) == len(CASES) and all(r.n_hit == 0 and r.items == [] for r in clean)
    assert contamination(frame(DOCS, []), frame(BENCH, ITEMS)).collect() == []


def test_decontaminated_rows_keep_all_columns(frame):
    left = decontaminate(frame(DOCS, CASES), frame(BENCH, ITEMS))
    assert left.columns == ["doc_id", "text", "source", "n_hit", "ws"]
    bad = {(c[0], c[1]) for c in CASES if brute_contamination([c], ITEMS)[0][2]}
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(
        str(c[0]) for c in CASES if (c[0], c[1]) not in bad
    )


def test_contamination_is_one_pass_without_python(spark):
    plan = op3_decontamination(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("documents.parquet") == 1
