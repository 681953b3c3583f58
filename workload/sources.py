"""CSV in and out, column roles and canonical rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlesieve.functions.text import parse_year
from titlesieve.operators.columns import (
    drop_blank_titles, map_columns, require_columns, to_canonical, with_verdict_columns,
)
from titlesieve.operators.filters import apply_filter
from titlesieve.operators.triage import merge_progress
from titlesieve.sources.readers import NULL_TOKENS, describe_source, read_papers, resolve_source
from titlesieve.sources.storage import scratch_folder
from titlesieve.sources.writers import export_nonempty, write_csv
from workload.registry import WORD, query
from workload.screening import PAPERS, SCREENED, SPEC, papers
from workload.triage import VERDICTS, judged
from workload.views import table

TOKENS = ", ".join(f"'{token}'" for token in NULL_TOKENS)
YEAR = "TRY_CAST(trunc(TRY_CAST({} AS DOUBLE)) AS INTEGER)"


def _export(spark, sf_dir, df, name="processed_papers.csv"):
    folder = scratch_folder(spark, "export")
    write_csv(df, f"{folder}/{name}", order_by="row_id")
    return folder


def _cell(name: str) -> str:
    return f"CASE WHEN {name} IN ({TOKENS}) THEN NULL ELSE {name} END AS {name}"


@query(
    "csv_round_trip",
    f"""{PAPERS} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, {_cell('title')}, {_cell('authors')},
      {_cell('year_raw')}, {_cell('abstract')}, {_cell('doi')}, {_cell('source')} FROM papers""",
)
def _(spark, sf_dir):
    """Whole texts, line breaks and quotes included, through CSV and back, ids in file order."""
    base = papers(spark, sf_dir)
    target = scratch_folder(spark, "export")
    export_nonempty(base, target, order_by="row_id")
    return read_papers(spark, target, row_id=False).withColumn("row_id", F.col("row_id").cast("bigint"))


@query(
    "csv_file_order",
    f"""{PAPERS} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, CAST(row_id AS STRING) AS paper,
      {_cell('title')} FROM papers""",
)
def _(spark, sf_dir):
    """Dense ids in file order over many part files."""
    parts = papers(spark, sf_dir).selectExpr("row_id", "cast(row_id AS string) AS paper", "title")
    target = scratch_folder(spark, "export")
    write_csv(parts.repartitionByRange(5, "row_id").sortWithinPartitions("row_id").drop("row_id"), target)
    return read_papers(spark, target)


@query(
    "source_description",
    f"""{PAPERS}, {SCREENED} SELECT (SELECT count(*) FROM papers) AS total, count(*) AS filtered,
      'title' AS title_column, 'title,authors,year_raw,abstract,doi,source' AS columns FROM screened""",
)
def _(spark, sf_dir):
    base = papers(spark, sf_dir)
    description = describe_source(base, apply_filter(base, SPEC, "title"))
    return description.withColumn("columns", F.array_join("columns", ","))


@query(
    "saved_progress",
    f"""{VERDICTS} SELECT papers.row_id, {_cell('papers.title').replace('AS papers.title', 'AS title')},
      nlp_decision, nlp_confidence FROM papers LEFT JOIN judged ON papers.row_id = judged.row_id""",
)
def _(spark, sf_dir):
    """A progress file, found in its folder, taken over into a fresh table."""
    folder = _export(spark, sf_dir, judged(spark, sf_dir))
    found = resolve_source(spark, folder)
    saved = read_papers(spark, found, row_id=False)
    saved = saved.withColumn("row_id", F.col("row_id").cast("bigint"))
    base = papers(spark, sf_dir).select("row_id", "title").withColumn(
        "title", F.when(~F.col("title").isin(*NULL_TOKENS), F.col("title"))
    )
    return merge_progress(with_verdict_columns(base), saved)


def _headed(spark, sf_dir):
    """Papers under the headers of a bibliographic export."""
    return papers(spark, sf_dir).selectExpr(
        "row_id", "title AS Title", "authors AS Authors", "year_raw AS Year",
        "source AS `Source title`", "abstract AS Abstract", "doi AS DOI",
    )


def _canonical(title: str, source: str) -> str:
    return f"""{PAPERS} SELECT row_id, {title} AS title, authors, {YEAR.format('year_raw')} AS year, abstract, doi,
      {source} AS source, CAST(NULL AS STRING) AS nlp_confidence, year_raw FROM papers"""


@query("canonical_first_match", _canonical("title", "source"))
def _(spark, sf_dir):
    headed = _headed(spark, sf_dir)
    return to_canonical(headed, map_columns(headed, "first"))


@query("canonical_last_match", _canonical("source", "CAST(NULL AS STRING)"))
def _(spark, sf_dir):
    headed = _headed(spark, sf_dir)
    return to_canonical(headed, map_columns(headed, "last"))


@query(
    "parsed_years",
    f"""SELECT o_orderkey, {YEAR.format('CAST(o_totalprice AS STRING)')} AS from_price,
      {YEAR.format('CAST(o_orderdate AS STRING)')} AS from_date FROM orders""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        parse_year(F.col("o_totalprice").cast("string")).alias("from_price"),
        parse_year(F.col("o_orderdate").cast("string")).alias("from_date"),
    )


@query(
    "titled_papers",
    f"{PAPERS} SELECT row_id, title FROM papers WHERE coalesce(regexp_matches(title, '{WORD}'), false)",
)
def _(spark, sf_dir):
    return drop_blank_titles(papers(spark, sf_dir)).select("row_id", "title")


@query(
    "triage_columns",
    f"""{PAPERS} SELECT row_id, title, CAST(NULL AS STRING) AS "Abstract", CAST(NULL AS STRING) AS nlp_decision,
      CAST(NULL AS STRING) AS nlp_confidence FROM papers""",
)
def _(spark, sf_dir):
    ready, _, _ = require_columns(papers(spark, sf_dir).select("row_id", "title"))
    return with_verdict_columns(ready)


@query("csv_fallback", f"""{PAPERS} SELECT row_id, {_cell('title')} FROM papers""")
def _(spark, sf_dir):
    """No preferred file in the folder: the first export by name is read, others are not."""
    base = papers(spark, sf_dir)
    folder = scratch_folder(spark, "fallback")
    write_csv(base, f"{folder}/scopus_export_a.csv")
    write_csv(base.limit(0), f"{folder}/scopus_export_b.csv")
    found = read_papers(spark, resolve_source(spark, folder), row_id=False)
    return found.select(F.col("row_id").cast("bigint").alias("row_id"), "title")


@query("csv_one_column", f"""{PAPERS} SELECT {_cell('title')}, count(*) AS rows FROM papers GROUP BY 1""")
def _(spark, sf_dir):
    """A file of one column keeps its rows without a value; it is read by one column of one."""
    folder = scratch_folder(spark, "one-column")
    write_csv(papers(spark, sf_dir).select("title"), folder)
    return read_papers(spark, folder, row_id=False).groupBy("title").agg(F.count("*").alias("rows"))
