import random

import pytest

from titlesieve.functions.rules import integer_range, max_length, not_blank, not_null, one_of
from titlesieve.operators.stats import import_report, skip_reasons
from titlesieve.operators.tables import (
    cascade_delete, check_rows, check_unique, flag_orphans, insert_if_absent, load_users, orphans,
    seed_progress,
    validate,
)
from titlesieve.operators import uniqueness
from titlesieve.plans.flows import load_papers, load_user_tables
from titlesieve.sources.schemas import PAPERS, PROGRESS, USERS
from titlesieve.sources.writers import append_to_table

USER = "id long, username string, password_hash string, display_name string, role string, invite_code string"


def errors(checked, key="id"):
    return {row[key]: list(row.errors) for row in checked.collect()}


def test_row_rules(frame):
    df = frame("id int, a string, b string, y int, raw string", [
        (1, None, "keep", None, "99999999999"), (2, " ", "other", None, "soon"),
        (3, "é" * 5, None, 7, "7.5"), (4, "é" * 6, "keep", None, None), (5, "ok", "keep", None, "1e400"),
    ])
    rules = [not_null("a"), not_blank("a"), max_length("a", 5), one_of("b", ("keep", "reject")), integer_range("y", "raw")]
    assert errors(check_rows(df, rules)) == {
        1: ["a is null", "a is blank", "y out of range"], 2: ["a is blank", "b not allowed"], 3: [],
        4: ["a too long"], 5: ["y out of range"],
    }
    good, bad = validate(df, rules)
    assert good.columns == df.columns and [row.id for row in good.collect()] == [3]
    assert bad.count() == 4


def test_reports(frame):
    checked = check_rows(frame("a string", [(None,), ("x",), ("toolong",), ("x",)]), [not_null("a"), max_length("a", 3)])
    assert tuple(import_report(checked).first()) == (2, 2)
    assert [tuple(r) for r in skip_reasons(checked).collect()] == [("a is null", 1), ("a too long", 1)]


def test_unique(frame):
    rows = [(1, "u", "c"), (2, "u", "d"), (3, "v", "c"), (4, None, "e"), (5, None, None), (6, "w", None), (0, "w", "f")]
    checked = check_rows(frame("id int, name string, code string", rows), [max_length("code", 1)])
    once = check_unique(checked, "name", "id", "id")
    assert {i for i, e in errors(once).items() if e} == {2, 6}
    # Row 2 is refused already and so does not count against any other.
    twice = check_unique(once, "code", "id", "id")
    assert {i: e for i, e in errors(twice).items() if e} == {
        2: ["duplicate name"], 3: ["duplicate code"], 6: ["duplicate name"],
    }
    both = check_unique(checked, ["name", "code"], "id", "id")
    assert not any(errors(both).values())


def test_keys(frame):
    parents = frame("id int", [(1,), (2,)])
    children = frame("fk int, n int", [(1, 0), (2, 1), (3, 2), (None, 3)])
    assert [row.n for row in orphans(children, parents, "fk").collect()] == [2]
    assert sorted(row.n for row in cascade_delete(children, parents, "fk").collect()) == [2, 3]
    assert [tuple(row) for row in insert_if_absent(
        frame("id int", [(1,)]), frame("row_id int, id int", [(5, 1), (4, 2), (3, 2), (6, 7)]), "id"
    ).orderBy("id").collect()] == [(3, 2), (6, 7)]


BATCH = [
    (1, "ann", "h", None, "groupmate", None), (2, "bob", "h", "Bob", "supervisor", None),
    (3, "ann", "h", "Ann again", "groupmate", None), (4, "cid", None, "Cid", "groupmate", None),
    (5, "cid", "h", "Cid", "guest", None), (6, "cid", "h", "Cid", "groupmate", None),
    (7, "old", "h", "Old", "groupmate", None), (8, "x" * 51, "h", None, "groupmate", None),
]


def test_user_outcomes(frame):
    loaded = load_users(frame("username string", [("old",)]), frame(USER, BATCH))
    got = {row.id: (row.outcome, row.display_name) for row in loaded.collect()}
    assert got == {
        1: ("created", "ann"), 2: ("created", "Bob"), 3: ("exists", "Ann again"), 4: ("error", "Cid"),
        5: ("error", "Cid"), 6: ("created", "Cid"), 7: ("exists", "Old"), 8: ("error", "x" * 51),
    }
    seeded = seed_progress(loaded.where("outcome = 'created'"), frame("user_id long", [(3,)]))
    assert [tuple(row) for row in seeded.collect()] == [(1, 0, 0, 0)]


def test_user_tables_twice(spark, frame, tmp_path):
    users, progress = str(tmp_path / "users"), str(tmp_path / "progress")
    spark.createDataFrame([], USERS).write.parquet(users)
    spark.createDataFrame([], PROGRESS).write.parquet(progress)
    for expected in [(4, 4), (0, 8)]:
        assert tuple(load_user_tables(frame(USER, BATCH), users, progress).first()) == expected
        stored = spark.read.schema(USERS).parquet(users)
        assert sorted((row.id, row.username) for row in stored.collect()) == [
            (1, "ann"), (2, "bob"), (3, "cid"), (4, "old"),
        ]
        assert stored.where("created_at IS NULL").count() == 0
        rows = spark.read.schema(PROGRESS).parquet(progress).collect()
        assert sorted((row.user_id, row.total_kept) for row in rows) == [(1, 0), (3, 0), (4, 0)]


def test_invite_codes_of_new_users(frame):
    batch = [
        (5, "a", "h", None, "admin", "x"), (6, "b", "h", None, "admin", "x"), (7, "c", "h", None, "admin", "y"),
        (8, "d", "h", None, "admin", None), (9, "e", "h", None, "admin", None), (4, "old", "h", None, "admin", "y"),
    ]
    loaded = load_users(frame("id long, username string, invite_code string", [(40, "old", "y")]), frame(USER, batch))
    assert sorted((r.id, r.outcome, r.new_id, r.errors) for r in loaded.collect()) == [
        (4, "exists", None, []), (5, "created", 41, []), (6, "error", None, ["duplicate invite_code"]),
        (7, "error", None, ["duplicate invite_code"]), (8, "created", 42, []), (9, "created", 43, []),
    ]


def test_repeated_parents_do_not_multiply_children(frame):
    checked = check_rows(frame("n int, fk int", [(1, 1), (2, 2), (3, None)]), [])
    flagged = flag_orphans(checked, frame("fk int", [(1,), (1,)]), "fk", "unknown")
    assert sorted((r.n, r.errors) for r in flagged.collect()) == [(1, []), (2, ["unknown"]), (3, [])]


def test_load_papers(spark, frame, tmp_path):
    rows = [
        (0, "A title", "2020.9", "x"), (1, None, "2020", "x"), (2, " ", "2020", "x"),
        (3, "Far future", "99999999999", "x"), (4, "No year", "n.d.", "x" * 256), (5, "Plain", None, None),
    ]
    source = frame("row_id long, Title string, Year string, DOI string", rows)
    for _ in range(2):
        report = load_papers(source, str(tmp_path / "papers"))
        assert tuple(report.first()) == (2, 4)
        stored = spark.read.parquet(str(tmp_path / "papers"))
        assert stored.columns == PAPERS.names
        assert sorted((row.id, row.title, row.year) for row in stored.collect()) == [
            (1, "A title", 2020), (2, "Plain", None),
        ]
        assert stored.where("created_at IS NULL").count() == 0
    with pytest.raises(ValueError):
        load_papers(source.drop("Title"), str(tmp_path / "other"))


def test_append_to_a_catalog_table(spark, frame):
    rows = frame("title string, year int", [("a", 2020), ("b", None)])
    for times in (1, 2):
        append_to_table(rows, "stored_papers")
        assert spark.table("stored_papers").count() == 2 * times
    spark.sql("DROP TABLE stored_papers")


def walked(rows, names=(), codes=()):
    """Outcomes of inserting (id, username, code) one after the other."""
    names, codes, out = set(names), set(codes), {}
    for i, name, code in sorted(rows):
        out[i] = "exists" if name in names else "error" if code in codes and code else "created"
        if out[i] == "created":
            names.add(name)
            codes.add(code)
    return out


def test_a_user_refused_for_its_code_leaves_its_name_free(frame):
    rows = [(1, "u1", "c1"), (2, "u2", "c1"), (3, "u2", "c2"), (4, "u2", "c3"), (5, "u1", "c2")]
    batch = [(i, u, "h", None, "admin", c) for i, u, c in rows]
    loaded = load_users(frame("id long, username string, invite_code string", []), frame(USER, batch))
    got = {r.id: (r.outcome, r.new_id) for r in loaded.collect()}
    assert got == {1: ("created", 1), 2: ("error", None), 3: ("created", 2), 4: ("exists", None), 5: ("exists", None)}


@pytest.mark.parametrize("rest, size, seed", [(0, 60, 1), (10_000, 400, 2), (7, 250, 3), (0, 30, 4)])
def test_two_unique_keys_equal_a_walk(frame, monkeypatch, rest, size, seed):
    monkeypatch.setattr(uniqueness, "WALKED_ROWS", rest)
    rng = random.Random(seed)
    rows = [(i * 3, f"u{min(rng.randrange(40), rng.randrange(40))}", rng.choice([None, f"c{rng.randrange(30)}"]))
            for i in range(size)]
    stored = [(900, "u1", "c1"), (901, "u2", None), (902, "u3", "c1")]
    batch = [(i, u, "h", None, "admin", c) for i, u, c in rows]
    loaded = load_users(frame("id long, username string, invite_code string", stored), frame(USER, batch)).collect()
    want = walked(rows, ["u1", "u2", "u3"], ["c1"])
    assert {r.id: r.outcome for r in loaded} == want and len(loaded) == size
    created = sorted(i for i, outcome in want.items() if outcome == "created")
    assert {r.id: r.new_id for r in loaded if r.new_id} == {i: 903 + k for k, i in enumerate(created)}


def test_three_keys_and_chains(frame, monkeypatch):
    monkeypatch.setattr(uniqueness, "WALKED_ROWS", 0)
    rows = [(i, i // 2, (i + 1) // 2, None if i % 5 else 1) for i in range(24)]
    taken = uniqueness.accept_in_order(frame("row_id int, a int, b int, c int", rows), ["a", "b", "c"])
    used, want = [set(), set(), set()], []
    for i, *keys in rows:
        if not any(k in s for k, s in zip(keys, used) if k is not None):
            want.append(i)
            for k, s in zip(keys, used):
                s.add(k)
    assert sorted(r.row_id for r in taken.collect()) == want


def test_papers_that_differ_in_the_abstract_only(spark, frame, tmp_path):
    target = str(tmp_path / "papers")
    for abstract in ("one", "two", None, "one"):
        load_papers(frame("row_id long, Title string, Abstract string", [(0, "Editorial", abstract)]), target)
    stored = spark.read.parquet(target).collect()
    assert sorted((r.id, r.abstract) for r in stored) == [(1, "one"), (2, "two"), (3, None)]
