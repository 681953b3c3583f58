"""De-duplication operators against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from titlesieve.llm import embedding_dedup, minhash, substring_dedup
from titlesieve.llm.components import components
from titlesieve.llm.textscan import mix

DOCS = "doc_id long, text string, n_shingles string, component_id string, n_chars int"
VECTORS = "vec_id long, embedding array<float>, label int, n_links string"
LOWER = {i: i + 32 for i in range(65, 91)}


def smallest_reachable(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


@pytest.mark.parametrize("seed", range(4))
def test_components_of_random_links(frame, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)]
    links += [(200, 200 + i) for i in range(1, 30)] + [(5, 5)]
    low = smallest_reachable({n for link in links for n in link}, links)
    got = {r.node: r.component for r in components(frame("a long, b long", links)).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: low[n] for n in linked}


def test_components_of_nothing(frame):
    assert components(frame("a long, b long", [])).collect() == []


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = [i for i in sets if sets[i]]
    links = [
        (a, b) for a in ids for b in ids
        if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return smallest_reachable(sets, links)


def varied_texts(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 200]))] for _ in range(n // 6)]
    texts = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, len(words) // 12])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append((i * 7 % n, rng.choice([" ", "\n", " \t"]).join(words)))
    return texts


AWKWARD = [
    (500, None), (501, ""), (502, " \n\t"), (503, "One Two"), (504, "one two"), (505, "ONE two three"),
    (506, "é é é é é é é"), (507, "É é é é é é é"), (508, "x " * 40_000), (509, "x " * 30_000), (510, "y"),
]


def test_near_duplicates_are_those_of_brute_force(frame):
    rows = varied_texts(1) + AWKWARD
    got = minhash.near_duplicates(frame(DOCS, [(*r, "clash", "clash", 1) for r in rows])).collect()
    low = brute_near(rows)
    assert {r.doc_id: r.component_id for r in got} == low
    for r in got:
        assert r.kept == (low[r.doc_id] == r.doc_id)
        assert r.n_shingles == len(shingles(dict(rows)[r.doc_id]))


@pytest.mark.parametrize("small", [0, 8, 1_000])
def test_large_buckets_that_are_not_one_component(frame, monkeypatch, small):
    """Documents around one long passage: a bucket of many, only some of them similar."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "LEAST_EQUAL_SLOTS", 0)
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "PAIRS_PER_CLASS", small)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = [f"q{rng.randrange(10_000)}" for _ in range(rng.choice([5, 12, 20, 25]))]
        rows.append((i, " ".join(passage + own)))
    rows += [(100 + i, t + " tail") for i, t in rows[:20]]
    got = minhash.near_duplicates(frame(DOCS, [(*r, "", "", 1) for r in rows])).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_near(rows)


def test_near_duplicates_with_repeated_and_null_ids(frame):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, "a b")]
    docs = frame(DOCS, [(*r, "", "", 1) for r in rows])
    got = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True),
    ]
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 3]


def test_a_repeated_id_with_different_texts(frame):
    """Every row stays or goes by its own text; links are not lost to the other text's set."""
    rng = random.Random(8)
    a, b, c, d = ([f"{x}{rng.randrange(10**6)}" for _ in range(60)] for x in "abcd")
    near = lambda words: " ".join(words[:-2] + ["x", "y"])
    a, b, c, d, others = " ".join(a), " ".join(b), " ".join(c), " ".join(d), (near(b), near(c), near(d))
    rows = [(3, a), (5, a), (5, b), (6, others[0]), (7, c), (7, d), (8, others[1]), (9, others[2]), (7, others[1])]
    docs = frame(DOCS, [(i, t, "", "", 1) for i, t in rows])
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert [g[:2] for g in got] == [
        (3, 3), (5, 3), (5, 5), (6, 5), (7, 7), (7, 7), (7, 7), (8, 7), (9, 7),
    ]
    assert sum(k for i, _, k in got if i == 7) == 2
    assert [k for i, _, k in got if i != 7] == [True, False, True, False, False, False]
    left = [(r.doc_id, r.text) for r in minhash.drop_near_duplicates(docs).collect()]
    assert len(left) == 4 and {(3, a), (5, b), (7, d)} < set(left)
    assert set(left) - {(3, a), (5, b), (7, d)} < {(7, c), (7, others[1])}


def test_near_duplicates_of_nothing(frame):
    assert minhash.near_duplicates(frame(DOCS, [])).collect() == []
    assert minhash.drop_near_duplicates(frame(DOCS, [])).collect() == []


def test_super_minhash_follows_its_definition():
    """One element at a time, with a permutation of its own."""
    rng = np.random.default_rng(5)
    sizes = [0, 1, 2, 10, 100, 700]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    hashes = rng.integers(0, 2**63, bounds[-1], dtype=np.uint64)
    got = minhash.super_minhash(hashes, bounds, 24)
    for row, (a, b) in enumerate(zip(bounds, bounds[1:])):
        expected = [2**64 - 1] * 24
        for h in hashes[a:b]:
            order = list(range(24))
            for j in range(24):
                step = (j + 1) * 0x9E3779B97F4A7C15
                draw = int(mix(np.array([(int(h) + step) % 2**64], np.uint64))[0])
                k = j + ((draw & 0xFFFFFFFF) * (24 - j) >> 32)
                order[j], order[k] = order[k], order[j]
                expected[order[j]] = min(expected[order[j]], j << 32 | draw >> 32)
        assert [int(x) for x in got[row]] == expected


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(7)
    errors = []
    for _ in range(60):
        both, own = rng.integers(0, 2**63, 150, dtype=np.uint64), rng.integers(0, 2**63, 100, dtype=np.uint64)
        x, y = np.concatenate([both, own[:50]]), np.concatenate([both, own[50:]])
        s = minhash.super_minhash(np.concatenate([x, y]), np.array([0, 200, 400]))
        errors.append((s[0] == s[1]).mean() - 150 / 250)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.075


def brute_removal(rows, window=20):
    seen, out = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, text in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if key in seen:
                gone |= set(range(p, p + window))
            seen.setdefault(key, i)
        kept = [w for p, w in enumerate(words) if p not in gone]
        out[i] = (len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept))
    return out


def passages(seed):
    rng = random.Random(seed)
    word = lambda n: [f"w{rng.randrange(n)}" for _ in range(rng.randrange(5, 90))]
    shared = [word(50) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [word(3_000)]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(shared)[rng.randrange(10) :], word(3_000)]
        rows.append((i * 11 % 60, " ".join(w for part in parts for w in part)))
    rows += [(100 + i, text) for i, text in rows[:8]]
    return rows


LONG = [
    (200, None), (201, ""), (202, "a b " * 30), (203, "c " * 19), (204, "c " * 20), (205, "c " * 21),
    (206, "d e f g h " * 4_000), (207, "Ünï cödé " * 15), (208, "ünï cödé " * 15), (209, "a b " * 30),
]


@pytest.mark.parametrize("seed", range(3))
def test_removed_words_are_those_of_brute_force(frame, seed):
    rows = passages(seed) + LONG
    docs = frame(DOCS, [(*r, "", "", 1) for r in rows])
    expected = brute_removal(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removal_digests(docs).collect()}
    assert got == {i: e[:3] for i, e in expected.items()}


def test_texts_without_repeats(frame):
    rows = passages(9) + LONG
    docs = frame(DOCS, [(*r, "", "", 1) for r in rows])
    left = substring_dedup.remove_repeats(docs)
    assert left.columns == docs.columns
    expected = brute_removal(rows)
    texts = dict(rows)
    want = {
        i: (texts[i] if not removed else kept, 1 if not removed else len(kept))
        for i, (n, removed, _, kept) in expected.items()
        if not removed or kept
    }
    assert {r.doc_id: (r.text, r.n_chars) for r in left.collect()} == want


def test_removal_with_repeated_ids_and_of_nothing(frame):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (None, text), (2, text + " more")]
    got = substring_dedup.removal_digests(frame(DOCS, [(*r, "", "", 1) for r in rows])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 40), (1, 40), (2, 40)]
    assert substring_dedup.removal_digests(frame(DOCS, [])).collect() == []
    assert substring_dedup.remove_repeats(frame(DOCS, [])).collect() == []


def test_spans_carry_their_source(frame):
    text = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(text)), (2, "x y " + " ".join(text[10:50]))]
    spans = substring_dedup.find_repeats(frame(DOCS, [(*r, "", "", 1) for r in rows])).spans.collect()
    assert [(s.doc_id, s.at, s.size, s.source_id, s.source_at) for s in spans] == [(2, 2, 21, 1, 10)]


@pytest.mark.parametrize("batch", ["alone", "after a short text"])
def test_every_number_of_words_in_a_slice(batch):
    from titlesieve.llm.textscan import scan_words

    for n in range(2 * substring_dedup.WINDOW + 1):
        texts = [b"" if batch == "alone" else b"a b c ", b" ".join(b"w%d" % i for i in range(n))]
        data = np.frombuffer(b"".join(texts), np.uint8)
        words = scan_words(data, np.cumsum([0, *map(len, texts)]))
        at, edge, check, low, where = substring_dedup._edges(words, substring_dedup.WINDOW)
        count = max(n - substring_dedup.WINDOW + 1, 0)
        assert {len(x) for x in (at, edge, check, low, where)} == {count}
        last = where + substring_dedup.GRAM
        assert (where >= at).all() and (last <= at + substring_dedup.WINDOW).all()


@pytest.mark.parametrize("n", [14, 18])
def test_a_short_document_alone(frame, n):
    text = " ".join(f"w{i}" for i in range(n))
    docs = frame(DOCS, [(1, text, "", "", 1)])
    kept = hashlib.sha256(text.encode()).hexdigest()
    got = substring_dedup.removal_digests(docs).collect()
    assert [tuple(r) for r in got] == [(1, n, 0, kept)]
    assert [r.text for r in substring_dedup.remove_repeats(docs).collect()] == [text]


def test_words_of_equal_hash_are_not_repeats(frame):
    """Long words of the Thue-Morse sequence and its complement have equal hashes."""
    bits = [bin(i).count("1") % 2 for i in range(4_096)]
    x, y = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    words = [f"w{i}" for i in range(30)]
    one, other = (" ".join(words[:15] + [w] + words[15:]) for w in (x, y))
    rows = [
        (1, one), (2, other), (3, "front " + other), (4, "front of " + one), (5, f"{one} {other}"),
        (6, " ".join(x)), (7, " ".join(y)),
    ]
    docs = frame(DOCS, [(*r, "", "", 1) for r in rows])
    expected = brute_removal(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removal_digests(docs).collect()}
    assert got == {i: e[:3] for i, e in expected.items()}


def vectors(seed, width=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(150):
        rows.append((i, rng.normal(size=width), int(i % 4 == 0)))
    for i in range(150, 260):
        base = rows[int(rng.integers(0, 12))]
        rows.append((i, base[1] * rng.uniform(0.5, 2) + rng.normal(size=width) * rng.choice([0.01, 0.05, 0.1]), base[2]))
    return [(i, [float(x) for x in np.float32(v)], label) for i, v, label in rows]


def brute_vectors(rows, threshold=0.98):
    links, ids = [], [r[0] for r in rows]
    for i, a, la in rows:
        for j, b, lb in rows:
            if i < j and la == lb:
                x, y = np.float64(a), np.float64(b)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links.append((i, j))
    low = smallest_reachable(ids, links)
    return {i: (sum(i in link for link in links), low[i]) for i in ids}


@pytest.mark.parametrize("blocks", [(1_024, 4_096), (3, 5)])
@pytest.mark.parametrize("recall", [1.0, embedding_dedup.TARGET_RECALL])
def test_vector_links_are_those_of_brute_force(frame, monkeypatch, blocks, recall):
    monkeypatch.setattr(embedding_dedup, "STORED_BLOCK", blocks[0])
    monkeypatch.setattr(embedding_dedup, "QUERY_BLOCK", blocks[1])
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 4)
    rows = vectors(2)
    got = embedding_dedup.near_duplicates(frame(VECTORS, [(*r, "x") for r in rows]), recall=recall).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_vectors(rows)


def test_awkward_vectors(frame):
    v = [1.0, 2.0, 3.0]
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0] * 3, 0),
        (8, [1.0, None, 3.0], 0), (9, [1.0, nan, 3.0], 0), (10, [1.0, inf, 3.0], 0), (None, v, 0),
        (11, [2.0, 4.0, 6.0], 0), (12, [1.0, 2.0], 0), (13, v, 0), (13, v, 0),
    ]
    got = embedding_dedup.near_duplicates(frame(VECTORS, [(*r, "x") for r in rows])).collect()
    linked = {1: 4, 2: 4, 11: 4, 13: 4}
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == sorted(
        (i or 0, linked.get(i, 0), 1 if i in linked else i or 0, i == 1 or i not in linked) for i, _, _ in rows
    )


def test_vectors_of_equal_hash_are_not_copies(frame):
    """xxhash64 of a list of doubles chains one bijection, so collisions can be solved for."""
    import struct

    p1, p2, p3, p4, p5 = (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
    )
    full = 2**64
    turn = lambda x, n: (x << n | x >> (64 - n)) % full
    bits = lambda x: struct.unpack("<Q", struct.pack("<d", x))[0]
    key = lambda x: turn(x * p2 % full, 31) * p1 % full

    def step(x, seed):
        h = turn((seed + p5 + 8 ^ key(x)) % full, 27) * p1 + p4
        h = (h ^ h % full >> 33) % full * p2 % full
        h = (h ^ h >> 29) * p3 % full
        return h ^ h >> 32

    one, other = step(bits(1.0), 42), step(bits(-3.0), 42)
    k = key(bits(1.0)) ^ (one + p5 + 8) % full ^ (other + p5 + 8) % full
    second = turn(k * pow(p1, -1, full) % full, 33) * pow(p2, -1, full) % full
    y = struct.unpack("<d", struct.pack("<Q", second))[0]
    kind = VECTORS.replace("float", "double")
    rows = frame(kind, [(1, [1.0, 1.0], 0, "x"), (2, [-3.0, y], 0, "x")])
    assert len({r[0] for r in rows.selectExpr("xxhash64(embedding)").collect()}) == 1
    got = embedding_dedup.near_duplicates(rows).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 0, 1), (2, 0, 2)]


def test_vectors_of_nothing(frame):
    assert embedding_dedup.near_duplicates(frame(VECTORS, [])).collect() == []
    assert embedding_dedup.near_duplicates(frame(VECTORS, [(1, [0.0], 1, "")])).head().kept


def test_cells_are_visited_nearest_first():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b, reach = rng.random(7), rng.random(9), rng.random() * 1.5
        cells = embedding_dedup.multi_sequence(a, b, reach)
        sums = (a[:, None] + b[None, :]).ravel()
        assert sorted(cells) == [c for c in range(63) if sums[c] <= reach]
        assert (np.diff(sums[cells]) >= 0).all()


def test_documents_of_words_with_equal_sums_are_not_linked(frame):
    """Long words of the Thue-Morse sequence and its complement have equal 64-bit sums."""
    bits = [bin(i).count("1") % 2 for i in range(2_048)]
    x, y = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rows = [(1, x), (2, y), (3, f"{x} w"), (4, f"{y} w"), (5, x.upper()), (6, f" {y}\t")]
    rows += [(10 + i, " ".join([f"u{k}" for k in range(9)] + [w])) for i, w in enumerate((x, y, x))]
    docs = frame(DOCS, [(*r, "", "", 1) for r in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (1, 1), 6: (1, 2),
                   10: (6, 10), 11: (6, 11), 12: (6, 10)}


def test_word_digests_of_long_texts():
    words = ["Ab", "c" * 3_000_000, "dé"] + ["e"] * 1_500_000 + ["f"]
    rows = [" ".join(words), "", " \n", "x", "\tc  d\n"]
    raw = [r.encode() for r in rows]
    data = np.frombuffer(b"".join(raw), np.uint8)
    lanes, bounds = minhash.word_digests(data, np.cumsum([0, *map(len, raw)]))
    want = [w.encode() for r in rows for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r))]
    assert bounds.tolist() == [0, len(words), len(words), len(words), len(words) + 1, len(words) + 3]
    digests = [hashlib.blake2b(w, digest_size=16).digest() for w in want]
    assert lanes.tobytes() == b"".join(digests)


def test_vectors_of_every_length_and_size_are_compared(frame):
    big, small = 1e200, 1e-200
    rows = [
        (1, [1.0, 2.0, 3.0], 0), (2, [1.0, 2.0, 3.0], 0), (3, [2.0, 4.0, 6.1], 0), (4, [1.0, 2.0], 0), (5, [2.0, 4.0], 0),
        (6, [1.0, 2.0, 0.0], 0), (7, [big, 2 * big, 3 * big], 0), (8, [small, 2 * small, 3 * small], 0),
        (9, [5.0], 0), (10, [7.0], 0), (11, [-7.0], 0), (12, [5e-324, 1e-323], 0), (13, [1.7e308, 1.7e308], 1), (14, [1.0, 1.0], 1),
    ]
    got = embedding_dedup.near_duplicates(frame(VECTORS.replace("float", "double"), [(*r, "x") for r in rows])).collect()
    want = {i: (4, 1) for i in (1, 2, 3, 7, 8)} | {4: (2, 4), 5: (2, 4), 12: (2, 4), 6: (0, 6)}
    want |= {9: (1, 9), 10: (1, 9), 11: (0, 11), 13: (1, 13), 14: (1, 13)}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_copies_leave_the_other_summaries_in_place(spark, frame, tmp_path):
    rows = [(i, f"sha{i}", [i, i + 1]) for i in range(30)] + [(3, "other", [7]), (-(2**63), "sha0", [1])]
    path = str(tmp_path / "summary")
    frame("doc_id long, whole_sha256 string, grams array<long>", rows).write.parquet(path)
    summary = spark.read.parquet(path)
    copies = summary.where("whole_sha256 in ('sha3', 'sha9')").select(
        "doc_id", "whole_sha256", F.lit(0).alias("first_id")
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = substring_dedup._without(summary, copies)
        plan = left._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, left.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted(r for r in rows if r[1] not in ("sha3", "sha9"))
    assert plan.count("BroadcastHashJoin") == 2 and "LeftAnti, BuildRight" in plan
