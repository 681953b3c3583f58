import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from titlesieve.operators import review
from titlesieve.operators.review import (
    accepted_decisions, current_item, kept_rows, replay, review_counts, review_queue,
)
from titlesieve.operators.stats import reviewer_progress

START = datetime(2024, 1, 1)
LOG = "event_id long, user_id long, decided_at timestamp_ntz, decision string"


def random_log(events=3000, reviewers=9, seed=11):
    """One reviewer makes a third of all decisions; many share a time stamp."""
    rng = random.Random(seed)
    codes = ["Y"] * 8 + ["N"] * 8 + ["X", None] + ["RESET"]
    return [
        (i, 0 if rng.random() < 1 / 3 else rng.randrange(1, reviewers),
         START + timedelta(minutes=rng.randrange(200)), rng.choice(codes))
        for i in range(events)
    ]


def walk(log, queue):
    """A cursor per reviewer, moved decision by decision."""
    state = {}
    for event_id, user, at, decision in sorted(log, key=lambda e: (e[2], e[0])):
        cursor, done = state.setdefault(user, (0, []))
        if decision == "RESET":
            state[user] = (0, [])
        elif cursor < len(queue):
            verdict = {"Y": "keep", "N": "reject"}.get(decision)
            state[user] = (cursor + 1, [*done, (cursor, queue[cursor], event_id, verdict)])
    return state


@pytest.fixture(params=[0, 1, 5, 90, 2000], ids=lambda n: f"queue{n}")
def case(request, frame, monkeypatch):
    monkeypatch.setattr(review, "STRETCH", 40)
    ids = [i * 3 for i in range(request.param)]
    rows = [(i, f"title {i}", "x" * 5) for i in random.Random(2).sample(ids, len(ids))]
    papers = frame("row_id long, title string, note string", rows)
    log = random_log() + [(9001, 77, START, "RESET")]
    return papers, frame(LOG, log), walk(log, ids), len(ids)


def test_replay_equals_a_walk(case):
    papers, log, state, total = case
    replayed = replay(review_queue(papers.drop("note")), log)
    got = sorted((r.user_id, r.pos, r.row_id, r.event_id, r.verdict or "") for r in replayed.collect())
    assert got == sorted((u, c, q, e, v or "") for u, (_, done) in state.items() for c, q, e, v in done)
    counts = {r.user_id: (r.kept, r.rejected) for r in review_counts(replayed).collect()}
    verdicts = {u: [v for *_, v in done] for u, (_, done) in state.items() if done}
    assert counts == {u: (vs.count("keep"), vs.count("reject")) for u, vs in verdicts.items()}
    kept = [(r.user_id, r.row_id, r.note) for r in kept_rows(replayed, papers).collect()]
    assert kept == [(u, q, "x" * 5) for u in sorted(state) for _, q, _, v in state[u][1] if v == "keep"]


def test_current_cards(case):
    papers, log, state, total = case
    cards = {r.user_id: r for r in current_item(review_queue(papers), log).collect()}
    assert set(cards) == set(state)
    for user, (cursor, done) in state.items():
        card = cards[user]
        assert (card["index"], card.total, card.done) == (cursor, total, cursor >= total)
        verdicts = [v for *_, v in done]
        assert (card.kept, card.rejected) == (verdicts.count("keep"), verdicts.count("reject"))
        if card.done:
            assert (card.row_id, card.title, card.progress_percent) == (None, None, None)
        else:
            assert (card.row_id, card.title) == (cursor * 3, f"title {cursor * 3}")
            assert card.progress_percent == pytest.approx((cursor + 1) / total * 100)


def test_progress_of_idle_reviewers(frame):
    log = frame("user_id long, decision string, decided_at timestamp", [(1, "keep", START), (1, "reject", START), (1, None, START + timedelta(days=1))])
    got = reviewer_progress(log, frame("user_id long", [(1,), (2,)]))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, 1, 1, START + timedelta(days=1)), (2, 0, 0, 0, None)]


def test_decision_table(frame):
    later = START + timedelta(hours=1)
    rows = [
        (1, 1, 10, "keep", later), (2, 1, 10, "reject", START), (3, 1, 11, "maybe", START),
        (4, 1, 11, "keep", later), (5, 9, 10, "keep", START), (6, 2, 99, "keep", START),
        (7, 2, 10, None, START), (8, 2, 10, "reject", START), (9, 2, 10, "reject", START),
        (10, None, 10, "keep", START), (11, None, 10, "keep", START),
    ]
    df = frame("id long, user_id long, paper_id long, decision string, decided_at timestamp", rows)
    users, papers = frame("id long", [(1,), (2,)]), frame("id long", [(10,), (11,)])
    got = {r.id: list(r.errors) for r in accepted_decisions(df, users, papers).collect()}
    assert got == {
        1: ["duplicate user_id, paper_id"], 2: [], 3: ["decision not allowed"], 4: [],
        5: ["unknown user"], 6: ["unknown paper"], 7: ["decision is null"], 8: [],
        9: ["duplicate user_id, paper_id"], 10: [], 11: [],
    }


def test_the_log_is_exchanged_once(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame(random_log(), LOG).write.parquet(path)
    queue = review_queue(spark.range(40).selectExpr("id AS row_id", "'t' AS title"))
    done = replay(queue, spark.read.parquet(path))
    done.collect()
    plan = done._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.find("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    assert sum("ReusedExchange" not in line for line in dealt) == 1 and "Python" not in plan


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_blocks_of_time_follow_the_log(spark, frame, monkeypatch, zone, kind):
    """Nights in which clocks go back and forth, times before 1970 and none at all."""
    monkeypatch.setattr(review, "STRETCH", 600)
    rng = random.Random(6)
    times = [datetime(2023, 11, 5, 0) + timedelta(minutes=5 * i) for i in range(48)]
    times += [datetime(2023, 3, 12, 0) + timedelta(minutes=7 * i) for i in range(40)]
    times += [datetime(1965, 1, 1) + timedelta(seconds=400 * i) for i in range(20)] + [None]
    rows = [(i, rng.randrange(2), rng.choice(times), rng.choice(["Y"] * 9 + ["N"] * 9 + ["RESET"])) for i in range(400)]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        log = frame(LOG.replace("timestamp_ntz", "timestamp"), rows).withColumn("decided_at", F.col("decided_at").cast(kind))
        got = {}
        for r in review.last_sessions(log).where("pos >= 0").collect():
            got.setdefault(r.user_id, []).append((r.pos, r.event_id))
        nth = Window.partitionBy("user_id").orderBy("decided_at", "event_id")
        ordered = log.withColumn("n", F.row_number().over(nth)).orderBy("user_id", "n").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = {0: [], 1: []}
    for r in ordered:
        want[r.user_id] = [] if r.decision == "RESET" else [*want[r.user_id], r.event_id]
    assert {u: sorted(g) for u, g in got.items()} == {u: list(enumerate(w)) for u, w in want.items() if w}
