"""Registered query of the grouping of spelling variants."""

from __future__ import annotations

from titlesieve.llm.registry import query, table
from titlesieve.llm.spelling import variants
from titlesieve.llm.sql import CRC_TABLE, crc32_of
from titlesieve.sources.storage import spread

_OP12_SQL = (
    r"""
WITH RECURSIVE """
    + CRC_TABLE
    + r""",
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, """
    + crc32_of(
        "flatten([CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END"
        " FOR x IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, '')])"
    )
    + r""" AS h FROM runs, crc),
typed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
    ELSE run END AS word, n FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
masked AS (SELECT word, n, i, substr(word, 1, i - 1) || chr(1) || substr(word, i + 1) AS m FROM places),
cut AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS m FROM places),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM masked a JOIN masked b ON a.m = b.m AND a.word <> b.word
  UNION ALL SELECT cut.word, cut.n, words.word, words.n FROM cut JOIN words ON cut.m = words.word
  UNION ALL SELECT words.word, words.n, cut.word, cut.n FROM cut JOIN words ON cut.m = words.word),
best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, near_n FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
formed AS (
  SELECT words.word, words.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
    CASE WHEN near_n >= 10 * words.n THEN near END AS form, CASE WHEN near_n >= 10 * words.n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
follow AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL SELECT follow.word, formed.form, step + 1 FROM follow JOIN formed ON formed.word = follow.root
  WHERE formed.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, step) AS root FROM follow GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""
)


@query("op12_spelling_variants", _OP12_SQL)
def op12_spelling_variants(spark, sf_dir):
    return variants(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
