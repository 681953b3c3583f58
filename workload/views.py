"""Paper, reply, user and decision tables derived from the test tables.

Each text runs unchanged in Spark and in DuckDB. The case distinctions give some rows
null or odd values so that every rule has something to decide; no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from titlesieve.sources.storage import spread

PAPERS = """
SELECT doc_id AS row_id,
  CASE WHEN doc_id % 37 = 0 THEN NULL WHEN doc_id % 41 = 1 THEN '  '
       ELSE split_part(text, chr(10), 1) END AS title,
  'Author ' || CAST(doc_id % 50 AS STRING) AS authors,
  CASE doc_id % 6 WHEN 0 THEN '2020' WHEN 1 THEN '2020.0' WHEN 2 THEN '2021.9'
       WHEN 3 THEN ' 2019 ' WHEN 4 THEN '2020-01-01' ELSE NULL END AS year_raw,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END AS abstract,
  CASE WHEN doc_id % 4 = 0 THEN NULL
       ELSE '10.1000/' || CAST(doc_id AS STRING) END AS doi,
  source
FROM documents"""

_VERDICT = "CASE WHEN quality = 1 THEN 'keep' ELSE 'reject' END"

REPLIES = f"""
SELECT doc_id AS row_id, CASE doc_id % 7
  WHEN 0 THEN '{{"decision":"' || {_VERDICT} || '","confidence":"high"}}'
  WHEN 1 THEN '```json' || chr(10) || '{{"decision":"' || {_VERDICT} || '","confidence":"medium"}}' || chr(10) || '```'
  WHEN 2 THEN '```' || chr(10) || '{{"decision":"' || {_VERDICT} || '"}}' || chr(10) || '```'
  WHEN 3 THEN '{{"decision":"keep"}} trailing'
  WHEN 4 THEN '{{"decision":"maybe","confidence":"low"}}'
  WHEN 5 THEN ''
  ELSE ' {{"decision":"' || {_VERDICT} || '","confidence":null}} ' END AS reply,
  CASE WHEN toxic = 1 THEN 'sorry' ELSE '{{"decision":"reject","confidence":"low"}}' END AS second_reply
FROM labels"""

DECISIONS = """
SELECT event_id, user_id, ts AS decided_at,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'Y'
       WHEN event_type = 'error' THEN 'N'
       WHEN event_type = 'view' THEN 'X'
       WHEN event_id % 29 = 0 THEN 'RESET' ELSE 'N' END AS decision
FROM events"""

# One row per event as a row of the decision table, bad codes and unknown papers included.
# The numbers in the events' props are paper ids.
DECISION_ROWS = """
SELECT event_id AS id, user_id,
  CAST(replace(replace(props, '{"k": ', ''), '}', '') AS BIGINT) AS paper_id,
  CASE event_type WHEN 'purchase' THEN 'keep' WHEN 'signup' THEN 'keep'
       WHEN 'error' THEN 'reject' WHEN 'view' THEN 'maybe' ELSE NULL END AS decision,
  ts AS decided_at
FROM events"""

USERS = """
SELECT c_custkey AS id,
  CASE WHEN c_custkey % 97 = 5 THEN NULL ELSE c_name END AS username,
  md5(c_name) AS password_hash,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE 'User ' || c_name END AS display_name,
  CASE WHEN c_custkey % 50 = 7 THEN 'guest'
       WHEN c_custkey % 10 = 0 THEN 'supervisor' ELSE 'groupmate' END AS role,
  CASE WHEN c_nationkey < 5 THEN NULL
       ELSE c_mktsegment || '-' || CAST(c_nationkey AS STRING) END AS invite_code
FROM customer"""

# A batch of users to load: one row per order, so that usernames repeat.
USER_BATCH = """
SELECT o_orderkey AS id,
  'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') AS username,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE md5(CAST(o_orderkey AS STRING)) END AS password_hash,
  CAST(NULL AS STRING) AS display_name,
  CASE o_orderstatus WHEN 'P' THEN 'admin' WHEN 'F' THEN 'supervisor' ELSE 'groupmate' END AS role,
  CAST(NULL AS STRING) AS invite_code
FROM orders"""

# A batch in which usernames and invite codes clash across each other: a row refused for one
# leaves the other free. Clashes stay among the orders of one customer.
CODED_BATCH = """
SELECT o_orderkey AS id, o_custkey AS person,
  'u' || CAST(o_custkey AS STRING) || '-' || CAST(o_orderkey % 3 AS STRING) AS username,
  CASE WHEN o_orderkey % 11 = 4 THEN NULL ELSE md5(CAST(o_orderkey AS STRING)) END AS password_hash,
  CAST(NULL AS STRING) AS display_name,
  CASE o_orderstatus WHEN 'P' THEN 'admin' WHEN 'F' THEN 'supervisor' ELSE 'groupmate' END AS role,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL
       ELSE 'c' || CAST(o_custkey AS STRING) || '-' || CAST(o_orderkey % 5 AS STRING) END AS invite_code
FROM orders"""

# Users that are there before: every fifth customer has one name and one code already.
CODED_USERS = """
SELECT c_custkey AS id, c_custkey AS person,
  'u' || CAST(c_custkey AS STRING) || '-0' AS username,
  'c' || CAST(c_custkey AS STRING) || '-1' AS invite_code
FROM customer WHERE c_custkey % 5 = 0"""

VIEWS = {
    "papers": PAPERS,
    "replies": REPLIES,
    "decisions": DECISIONS,
    "decision_rows": DECISION_ROWS,
    "users": USERS,
    "user_batch": USER_BATCH,
    "coded_batch": CODED_BATCH,
    "coded_users": CODED_USERS,
}
_TABLES = {
    "papers": "documents", "replies": "labels", "decisions": "events",
    "decision_rows": "events", "users": "customer", "user_batch": "orders",
    "coded_batch": "orders", "coded_users": "customer",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of part files.

    A stream takes the path of a single file only as a pattern.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}.parquet}}")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work that is heavy per row and no filter."""
    return spread(table(spark, sf_dir, name).select(*columns))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame."""
    source = _TABLES[name]
    text = VIEWS[name].replace(f"FROM {source}", "FROM {source}")
    # The braces of JSON texts are no placeholders.
    text = text.replace("{", "{{").replace("}", "}}").replace("{{source}}", "{source}")
    return spark.sql(text, source=table(spark, sf_dir, source))


def with_views(*names: str) -> str:
    """The head of a DuckDB query that uses derived tables."""
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name]})" for name in names)
