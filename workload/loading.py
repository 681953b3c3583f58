"""Table loads: checks, quarantine, users, cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlesieve.functions.rules import integer_range
from titlesieve.operators.columns import map_columns, to_canonical
from titlesieve.operators.stats import import_report, skip_reasons
from titlesieve.operators.tables import (
    assign_ids, cascade_delete, check_rows, check_unique, insert_if_absent, load_users, orphans, seed_progress,
    split_checked, user_load_report, validate,
)
from titlesieve.plans.flows import load_papers
from titlesieve.sources.schemas import paper_rules, user_rules
from titlesieve.sources.storage import scratch_folder
from workload.registry import WORD, query
from workload.screening import PAPERS, papers
from workload.sources import YEAR
from workload.views import table, view, with_views

GOOD_TITLE = f"coalesce(regexp_matches(title, '{WORD}'), false)"


def users(spark, sf_dir):
    return view(spark, sf_dir, "users")


def _checked_papers(spark, sf_dir):
    base = papers(spark, sf_dir).withColumnRenamed("year_raw", "year")
    rules = [*paper_rules(), integer_range("year", "year_raw")]
    return check_rows(to_canonical(base, map_columns(base)), rules)


@query(
    "accepted_papers",
    f"""{PAPERS} SELECT row_id, title, authors, {YEAR.format('year_raw')} AS year, doi, source FROM papers
    WHERE {GOOD_TITLE}""",
)
def _(spark, sf_dir):
    good, _ = split_checked(_checked_papers(spark, sf_dir))
    return good.select("row_id", "title", "authors", "year", "doi", "source")


@query(
    "quarantined_papers",
    f"""{PAPERS} SELECT row_id, title,
      'title is blank' AS errors FROM papers
    WHERE NOT {GOOD_TITLE}""",
)
def _(spark, sf_dir):
    _, bad = split_checked(_checked_papers(spark, sf_dir))
    return bad.select("row_id", "title", F.array_join("errors", "; ").alias("errors"))


@query(
    "import_report",
    f"""{PAPERS} SELECT count(*) FILTER ({GOOD_TITLE}) AS imported,
      count(*) FILTER (NOT {GOOD_TITLE}) AS skipped FROM papers""",
)
def _(spark, sf_dir):
    return import_report(_checked_papers(spark, sf_dir))


@query(
    "skip_reasons",
    f"""{PAPERS}, reasons AS (SELECT CASE WHEN NOT {GOOD_TITLE} THEN 'title is blank' END AS reason FROM papers)
    SELECT reason, count(*) AS rows FROM reasons WHERE reason IS NOT NULL GROUP BY reason""",
)
def _(spark, sf_dir):
    return skip_reasons(_checked_papers(spark, sf_dir))


LOADED = f"""{PAPERS} SELECT row_number() OVER (ORDER BY row_id) AS id, title, authors,
      {YEAR.format('year_raw')} AS year, abstract, doi, source,
      CAST(NULL AS STRING) AS nlp_confidence, CAST(NULL AS STRING) AS nlp_reason FROM papers WHERE {GOOD_TITLE}"""


@query(
    "loaded_papers",
    LOADED,
)
def _(spark, sf_dir):
    """Appended to a Parquet table and read back."""
    target = scratch_folder(spark, "papers")
    load_papers(papers(spark, sf_dir).withColumnRenamed("year_raw", "year"), target)
    return spark.read.parquet(target).drop("created_at")


@query("papers_loaded_twice", LOADED)
def _(spark, sf_dir):
    """A load that is repeated adds nothing."""
    target = scratch_folder(spark, "papers")
    for _ in range(2):
        load_papers(papers(spark, sf_dir).withColumnRenamed("year_raw", "year"), target)
    return spark.read.parquet(target).drop("created_at")


BAD_USER = "username IS NULL OR role NOT IN ('groupmate', 'supervisor', 'admin')"


@query(
    "valid_users",
    f"{with_views('users')} SELECT id, username, role FROM users WHERE NOT ({BAD_USER})",
)
def _(spark, sf_dir):
    good, _ = validate(users(spark, sf_dir), user_rules())
    return good.select("id", "username", "role")


@query(
    "refused_users",
    f"""{with_views('users')} SELECT id, concat_ws('; ', CASE WHEN username IS NULL THEN 'username is null' END,
      CASE WHEN role NOT IN ('groupmate', 'supervisor', 'admin') THEN 'role not allowed' END) AS errors
    FROM users WHERE {BAD_USER}""",
)
def _(spark, sf_dir):
    _, bad = validate(users(spark, sf_dir), user_rules())
    return bad.select("id", F.array_join("errors", "; ").alias("errors"))


@query(
    "repeated_invite_codes",
    f"""{with_views('users')}, good AS (SELECT * FROM users WHERE NOT ({BAD_USER}))
    SELECT id, 'duplicate invite_code' AS errors FROM good WHERE invite_code IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY invite_code ORDER BY id) > 1""",
)
def _(spark, sf_dir):
    checked = check_rows(users(spark, sf_dir), user_rules())
    unique = check_unique(checked, "invite_code", order="id", row="id")
    repeated = unique.where(F.array_contains("errors", "duplicate invite_code"))
    return repeated.select("id", F.array_join("errors", "; ").alias("errors"))


@query(
    "orphaned_orders",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN"
    " (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def _(spark, sf_dir):
    solvent = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orphans(orders, solvent, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query(
    "decisions_after_cascade",
    f"""{with_views('decision_rows', 'users')} SELECT decision_rows.* FROM decision_rows
    WHERE user_id NOT IN (SELECT id FROM users WHERE role = 'guest')""",
)
def _(spark, sf_dir):
    rows = view(spark, sf_dir, "decision_rows")
    left = cascade_delete(rows, users(spark, sf_dir).where("role = 'guest'"), "user_id")
    return left.select(*rows.columns)


_TARGET = "target AS (SELECT * FROM users WHERE role = 'supervisor')"


@query(
    "inserted_users",
    f"""{with_views('users', 'user_batch')}, {_TARGET}, firsts AS (SELECT id, username FROM user_batch
    WHERE username NOT IN (SELECT username FROM target WHERE username IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY username ORDER BY id) = 1)
    SELECT (SELECT max(id) FROM target) + row_number() OVER (ORDER BY id) AS id, username FROM firsts""",
)
def _(spark, sf_dir):
    target = users(spark, sf_dir).where("role = 'supervisor'")
    batch = view(spark, sf_dir, "user_batch").select("id", "username")
    absent = insert_if_absent(target, batch, "username", order="id")
    return assign_ids(absent, target, "id")


_OUTCOMES = f"""{with_views('users', 'user_batch')}, {_TARGET}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY username, password_hash IS NULL ORDER BY id) AS nth FROM user_batch),
    loaded AS (SELECT id, username, username AS display_name, role,
      CASE WHEN password_hash IS NULL THEN 'error'
           WHEN username IN (SELECT username FROM target WHERE username IS NOT NULL) OR nth > 1 THEN 'exists'
           ELSE 'created' END AS outcome FROM ranked)"""


def _loaded(spark, sf_dir):
    target = users(spark, sf_dir).where("role = 'supervisor'")
    return load_users(target, view(spark, sf_dir, "user_batch"))


@query("user_outcomes", f"{_OUTCOMES} SELECT * FROM loaded")
def _(spark, sf_dir):
    return _loaded(spark, sf_dir).select("id", "username", "display_name", "role", "outcome")


@query(
    "user_load_report",
    f"""{_OUTCOMES} SELECT count(*) FILTER (outcome = 'created') AS created,
      count(*) FILTER (outcome <> 'created') AS skipped FROM loaded""",
)
def _(spark, sf_dir):
    return user_load_report(_loaded(spark, sf_dir))


@query(
    "seeded_progress",
    f"""{_OUTCOMES}, fresh AS (SELECT *, (SELECT max(id) FROM target) + row_number() OVER (ORDER BY id) AS new_id
      FROM loaded WHERE outcome = 'created')
    SELECT new_id AS user_id, 0 AS current_paper_index, 0 AS total_kept, 0 AS total_rejected
    FROM fresh WHERE role = 'groupmate' AND new_id NOT IN (SELECT user_id FROM events)""",
)
def _(spark, sf_dir):
    created = _loaded(spark, sf_dir).where("outcome = 'created'")
    return seed_progress(created, table(spark, sf_dir, "events"))


@query(
    "users_two_keys",
    f"""{with_views('coded_batch', 'coded_users').replace('WITH ', 'WITH RECURSIVE ', 1)},
    numbered AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY id) AS i FROM coded_batch),
    walk AS (
      SELECT person, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, '' AS outcome,
        list_filter(list_distinct(list(username)), lambda x: x IS NOT NULL) AS names,
        list_filter(list_distinct(list(invite_code)), lambda x: x IS NOT NULL) AS codes
      FROM (SELECT person, username, invite_code FROM coded_users
            UNION ALL SELECT person, NULL, NULL FROM coded_batch) GROUP BY person
      UNION ALL
      SELECT person, i, id, outcome,
        CASE outcome WHEN 'created' THEN list_append(names, username) ELSE names END,
        CASE WHEN outcome = 'created' AND invite_code IS NOT NULL THEN list_append(codes, invite_code) ELSE codes END
      FROM (SELECT n.person, n.i, n.id, n.username, n.invite_code, names, codes,
              CASE WHEN n.password_hash IS NULL THEN 'error'
                   WHEN list_contains(names, n.username) THEN 'exists'
                   WHEN n.invite_code IS NOT NULL AND list_contains(codes, n.invite_code) THEN 'error'
                   ELSE 'created' END AS outcome
            FROM walk JOIN numbered n ON n.person = walk.person AND n.i = walk.i + 1)),
    last_id AS (SELECT max(id) AS last FROM coded_users),
    created AS (SELECT id, (SELECT last FROM last_id) + row_number() OVER (ORDER BY id) AS new_id
      FROM walk WHERE outcome = 'created')
    SELECT walk.id, outcome, new_id,
      CASE WHEN outcome <> 'error' THEN '' WHEN password_hash IS NULL THEN 'password_hash is null'
           ELSE 'duplicate invite_code' END AS errors
    FROM walk JOIN coded_batch USING (id) LEFT JOIN created USING (id)""",
)
def _(spark, sf_dir):
    """Both unique keys of the users table at once, as inserts one by one would keep them."""
    batch = view(spark, sf_dir, "coded_batch").drop("person")
    loaded = load_users(view(spark, sf_dir, "coded_users").drop("person"), batch)
    return loaded.select("id", "outcome", "new_id", F.array_join("errors", "; ").alias("errors"))


# Papers of which some break each limit of the table.
_LONG = f"""{PAPERS}, long AS (SELECT row_id, title, authors,
      CASE WHEN row_id % 13 = 4 THEN '99999999999' ELSE year_raw END AS year_raw,
      substr(abstract, 1, CAST(row_id % 400 AS INT)) AS doi, substr(abstract, 1, CAST(row_id % 150 AS INT)) AS source,
      substr(abstract, 1, CAST(row_id % 30 AS INT)) AS nlp_confidence FROM papers),
    broken AS (SELECT row_id, concat_ws('; ', CASE WHEN NOT {GOOD_TITLE} THEN 'title is blank' END,
      CASE WHEN length(doi) > 255 THEN 'doi too long' END, CASE WHEN length(source) > 100 THEN 'source too long' END,
      CASE WHEN length(nlp_confidence) > 20 THEN 'nlp_confidence too long' END,
      CASE WHEN year_raw = '99999999999' THEN 'year out of range' END) AS errors FROM long)"""


def _long_papers(spark, sf_dir):
    def cut(n):
        return F.substring("abstract", F.lit(1), (F.col("row_id") % n).cast("int"))

    base = papers(spark, sf_dir).select(
        "row_id",
        "title",
        "authors",
        F.when(F.col("row_id") % 13 == 4, "99999999999").otherwise(F.col("year_raw")).alias("year"),
        "abstract",
        cut(400).alias("doi"),
        cut(150).alias("source"),
        cut(30).alias("nlp_confidence"),
    )
    rules = [*paper_rules(), integer_range("year", "year_raw")]
    return check_rows(to_canonical(base, map_columns(base)), rules)


@query("refused_by_length", f"{_LONG} SELECT row_id, errors FROM broken WHERE errors <> ''")
def _(spark, sf_dir):
    """Papers that break the limits of length, range and blankness, with all their reasons."""
    _, bad = split_checked(_long_papers(spark, sf_dir))
    return bad.select("row_id", F.array_join("errors", "; ").alias("errors"))


@query(
    "length_skip_reasons",
    f"""{_LONG} SELECT reason, count(*) AS rows FROM (SELECT unnest(string_split(errors, '; ')) AS reason
      FROM broken WHERE errors <> '') GROUP BY reason""",
)
def _(spark, sf_dir):
    return skip_reasons(_long_papers(spark, sf_dir))
