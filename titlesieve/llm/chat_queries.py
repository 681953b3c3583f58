"""Registered query of the repair of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlesieve.llm.chat_repair import repair
from titlesieve.llm.registry import query, table
from titlesieve.llm.sql import CRC_TABLE, crc32_of

_OP11_SQL = (
    r"""
WITH RECURSIVE """
    + CRC_TABLE
    + r""",
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
marked AS (SELECT conv_id, turn, role, text, """
    + crc32_of("[ord(key[j]) FOR j IN range(1, len(key) + 1)]")
    + r""" % 20 AS k FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM marked WHERE k <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(role, 1, 64),
    substr(text, 1, 64), sha256(length(role) || ':' || role || text), copy) AS i
  FROM damaged),
faults AS (
  SELECT *, substr(role, 1, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM numbered),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM faults)
  GROUP BY conv_id),
edits(letter, initial, q, q2, c) AS (VALUES
  ('D', NULL, 0, 0, 2), ('D', NULL, 1, 1, 2), ('D', NULL, 2, 2, 2), ('D', NULL, 3, 3, 2),
  ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0),
  ('R', NULL, 0, 2, 1), ('R', NULL, 1, 2, 1), ('R', NULL, 2, 3, 1), ('R', NULL, 3, 2, 1)),
inserts(q, letters, q2, c, put) AS (VALUES
  (0, '', 0, 0, ''), (1, '', 1, 0, ''), (2, '', 2, 0, ''), (3, '', 3, 0, ''),
  (0, 'I', 2, 5, 'user:'), (1, 'I', 2, 5, 'user:'), (2, 'I', 3, 5, 'assistant:'), (3, 'I', 2, 5, 'user:'),
  (0, 'II', 3, 10, 'user:' || chr(10) || 'assistant:'), (1, 'II', 3, 10, 'user:' || chr(10) || 'assistant:'),
  (2, 'II', 2, 10, 'assistant:' || chr(10) || 'user:'), (3, 'II', 3, 10, 'user:' || chr(10) || 'assistant:')),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS kept FROM counted
  UNION ALL
  SELECT conv_id, i, q, cost, audit, kept FROM (
    SELECT dp.conv_id, f.i, e.q2 AS q, dp.cost + n.c + e.c + CASE WHEN f.fault = 'truncated' AND e.letter <> 'D' THEN 5 ELSE 0 END AS cost,
      dp.audit || n.letters || e.letter AS audit,
      dp.kept || CASE n.letters WHEN '' THEN [] ELSE [n.put] END
        || CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text]
           ELSE [CASE e.q2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END AS kept
    FROM dp JOIN faults f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1
    JOIN inserts n ON n.q = dp.q
    JOIN edits e ON e.q = n.q2 AND (e.initial IS NULL OR e.initial = f.initial)
      AND (e.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')))
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
ended AS (
  SELECT dp.conv_id, dp.cost + e.c AS cost, dp.audit || e.letters AS audit,
    dp.kept || CASE e.letters WHEN '' THEN [] ELSE [e.put] END AS kept
  FROM dp JOIN counted ON counted.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = counted.n
  JOIN inserts e ON e.q = dp.q AND e.q2 IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.cost + e.c, dp.audit || e.letters) = 1)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM o.conv_id
"""
)

_NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by the CRC of ``conv_id:turn``; null cells are one space."""
    cells = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in conversations.columns}
    key = F.concat(cells["conv_id"], F.lit(":"), cells["turn"])
    k = F.col("k")
    return (
        conversations.select(
            "conv_id",
            "turn",
            cells["role"].alias("role"),
            cells["text"].alias("text"),
            F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("k"),
        )
        .where(k != 0)
        .select(
            "conv_id",
            "turn",
            F.when(k == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(k == 1, "")
            .when(k == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text"))
            .alias("text"),
            F.explode(F.array_repeat(F.lit(0), F.when(k == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )


@query("op11_conversation_repair", _OP11_SQL)
def op11_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired = repair(damaged(rows))
    plans, digests = repaired.plans(), repaired.digests()
    plans = plans.withColumnRenamed("conv_id", "plan_id")
    digests = digests.withColumnRenamed("conv_id", "digest_id")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (
        rows.select("conv_id")
        .distinct()
        .join(plans, F.col("conv_id").eqNullSafe(F.col("plan_id")), "left")
        .join(digests, F.col("conv_id").eqNullSafe(F.col("digest_id")), "left")
        .select(
            "conv_id",
            *(F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in numbers),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(_NOTHING)).alias("repaired_sha256"),
        )
    )
