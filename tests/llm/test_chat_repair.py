"""Repair of conversations against a plain dynamic program."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from titlesieve.llm import chat_repair
from titlesieve.llm.chat_queries import damaged, op11_conversation_repair
from titlesieve.llm.chat_repair import repair
from titlesieve.llm.edit_tables import tables

CHAT = "conv_id long, turn int, role string, text string, part int, symbol string"
PUT = {0: "user", 1: "user", 2: "assistant", 3: "user"}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def put_in(best):
    for _ in range(3):
        for q, (cost, audit, out) in list(best.items()):
            new = cost + 5, audit + "I", out + [PUT[q] + ":"]
            if NEXT[q] not in best or new[:2] < best[NEXT[q]][:2]:
                best[NEXT[q]] = new
    return best


def cheapest(rows):
    """(cost, audit, repaired lines) of rows (role, text, fault), all edits tried."""
    best = {0: (0, "", [])}
    for role, text, fault in rows:
        after = {}
        for q, (cost, audit, out) in put_in(best).items():
            options = [("D", 2, q, None)]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                stays = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {})
                if q in stays:
                    options.append(("K", more, stays[q], f"{role}:{text}"))
                options.append(("R", 1 + more, NEXT[q], f"{PUT[q]}:{text}"))
            for letter, more, to, line in options:
                new = cost + more, audit + letter, out + ([line] if line is not None else [])
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        best = after
    best = put_in(best)
    return min((best[q] for q in (0, 3) if q in best), key=lambda b: b[:2])


def expected(rows):
    """What is known of one conversation of (turn, role, text)."""
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:64], r[2][:64],
                             hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    seen, marked = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not end else "duplicate" if (role, text) in seen else ""
        seen.add((role, text))
        marked.append((role, text, fault or ("" if end[-1] in ".!?" else "truncated")))
    counts = Counter(fault for *_, fault in marked)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
    turns = [t for t, *_ in rows if t is not None]
    cost, audit, lines = cheapest(marked)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": counts["blank"], "duplicate": counts["duplicate"], "truncated": counts["truncated"],
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }, lines


def conversations():
    rng = random.Random(4)
    rows = [
        (1, 0, "system", "s."), (1, 1, "assistant", "a!"),
        (2, 0, "user", "u"), (2, 1, "assistant", "a."),
        (3, None, None, None), (3, 5, "user", "same?"), (3, 9, "user", "same?"), (3, 9, "user", "same?"),
        (4, 1, "", "x."), (4, 1, "", "x."), (4, 1, "User", "x. \n"),
        (5, 0, "user", "long " * 50_000 + "."), (5, 1, "assistant", "."),
        (None, 0, "user", "hi."), (None, None, "assistant", "ho."),
        (6, 0, "assistant", " "), (7, -9, "u", "?"), (7, 2_000_000_000, "a", "!"),
    ]
    texts = ["Yes.", "No", " ", "Why?", "", "Go!"]
    for conv in range(10, 60):
        for _ in range(rng.randint(0, 14)):
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool"])
            text = rng.choice(texts) if rng.random() < 0.5 else f"t{rng.random()}{rng.choice('.?x')}"
            rows.append((conv, rng.choice([None, *range(20)]), role, text))
    return rows


def check(repaired, rows):
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(row)
    plans = {r.conv_id: r.asDict() for r in repaired.plans().collect()}
    digests = {r.conv_id: r.repaired_sha256 for r in repaired.digests().collect()}
    kept = {}
    for r in sorted(repaired.rows().collect(), key=lambda r: (r.part, r.seq, r.place)):
        kept.setdefault(r.conv_id, []).append(r)
    assert set(plans) == set(by) == set(digests) == set(kept)
    for conv, own in by.items():
        want, lines = expected(own)
        assert plans[conv] | {"repaired_sha256": digests[conv]} == want | {"conv_id": conv}
        assert "".join(r.edit for r in kept[conv]) == want["audit"]
        assert [f"{r.role}:{r.text}" for r in kept[conv] if r.edit != "D"] == lines


@pytest.mark.parametrize("stretch", [1024, 3])
def test_equal_to_trying_all_edits(frame, monkeypatch, stretch):
    monkeypatch.setattr(chat_repair, "STRETCH_ROWS", stretch)
    rows = conversations()
    check(repair(frame(CHAT, [(*r, 1, "x") for r in rows])), rows)


def test_a_hot_conversation_lies_in_many_stretches(spark, frame, monkeypatch):
    monkeypatch.setattr(chat_repair, "STRETCH_ROWS", 50)
    monkeypatch.setattr(chat_repair, "STRETCH_CHARS", 200)
    rows = [(1, t // 2, "user" if t % 3 else "assistant", f"line {t}{'.x'[t % 7 == 0]}") for t in range(900)]
    rows += [(1, 5, "user", "again.")] * 700 + [(2, 0, "user", "u."), (2, 1, "assistant", "a.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        repaired = repair(frame(CHAT, [(*r, 1, "x") for r in rows]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert repaired._stretches.select("part").distinct().count() > 1
    check(repaired, rows)


def test_nothing(frame):
    repaired = repair(frame(CHAT, [(1, 0, "user", "x", 1, "x")]).limit(0))
    assert not repaired.plans().collect() and not repaired.digests().collect()
    assert not repaired.rows().collect()


def test_tables_equal_trying_all_edits():
    kinds = [("s", ""), ("u", ""), ("a", ""), ("o", ""), ("s", "truncated"), ("u", "truncated"),
             ("a", "truncated"), ("o", "truncated"), ("s", "blank")]
    rng = random.Random(2)
    some = [p for n in range(4) for p in itertools.product(range(9), repeat=n)]
    some += [[rng.choice([0, 1, 1, 2, 2, 3, 5, 6, 8]) for _ in range(rng.randint(4, 30))] for _ in range(500)]
    for symbols in some:
        cost, letters, tail = tables().solve(np.array(symbols, np.uint8))
        want = cheapest([(kinds[s][0], "", kinds[s][1]) for s in symbols])
        assert (cost, "".join(letters) + tail) == want[:2]
        assert len(letters) == len(symbols) and all(re.fullmatch("I*[DKR]", x) for x in letters)


def test_damage(frame):
    from zlib import crc32

    rows = [(c, t, r, x) for c in (1, None, -3) for t in (None, *range(40))
            for r, x in (("assistant", "a.b!c?"), (None, None))]
    want = []
    for conv, turn, role, text in rows:
        role, text = role or " ", text or " "
        k = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(k, text)
        want += [(conv, turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    plain = frame("conv_id long, turn int, role string, text string", rows)
    assert Counter(map(tuple, damaged(plain).collect())) == Counter(want)


def test_query_equals_trying_all_edits(spark):
    sf_dir = "/root/testdata/sf0.001"
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    by = {}
    for row in damaged(chats.select("conv_id", "turn", "role", "text")).collect():
        by.setdefault(row[0], []).append(tuple(row[1:]))
    rows = {r.conv_id: r.asDict() for r in op11_conversation_repair(spark, sf_dir).collect()}
    assert set(rows) == {r[0] for r in chats.select("conv_id").collect()}
    for conv, row in rows.items():
        assert row == expected(by.get(conv, []))[0] | {"conv_id": conv}
