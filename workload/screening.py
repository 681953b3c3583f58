"""Filters, de-duplication, paging and their counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlesieve.functions.text import (
    exclude, include_all, include_any, keyword_array, length_between, word_count,
)
from titlesieve.operators.dedup import duplicate_report, remove_duplicates
from titlesieve.operators.filters import (
    FilterSpec, apply_filter, remove_rows, removal_report, reset_filters, search,
)
from titlesieve.operators.ordered import store_ordered
from titlesieve.operators.paging import page, page_info
from titlesieve.operators.stats import dataset_stats, filter_stats
from titlesieve.sources.storage import scratch_folder
from workload.registry import WORD, query
from workload.views import spread_table, table, view, with_views

KEYWORDS = ("The", "tion", "ung")
WORDY = ("eaux", "heit", "c++")
SPEC = FilterSpec(include=KEYWORDS, exclude=("www", "|"), min_words=3, max_words=40)

PAPERS = with_views("papers")
ANY_TITLE = "(contains(lower(title), 'the') OR contains(lower(title), 'tion') OR contains(lower(title), 'ung'))"
WORDS_IN_TITLE = f"len(regexp_extract_all(title, '{WORD}'))"
SPEC_SQL = (
    f"coalesce({ANY_TITLE}, false)"
    " AND coalesce(NOT (contains(lower(title), 'www') OR contains(lower(title), '|')), true)"
    f" AND coalesce({WORDS_IN_TITLE} BETWEEN 3 AND 40, false)"
)
# The rows that the screening filter keeps, as SQL.
SCREENED = f"screened AS (SELECT * FROM papers WHERE {SPEC_SQL})"


def papers(spark, sf_dir):
    return view(spark, sf_dir, "papers")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def texts(spark, sf_dir):
    return spread_table(spark, sf_dir, "documents", "doc_id", "text")


@query("include_any_title", f"{PAPERS} SELECT row_id, title FROM papers WHERE coalesce({ANY_TITLE}, false)")
def _(spark, sf_dir):
    return papers(spark, sf_dir).where(include_any(F.col("title"), KEYWORDS)).select("row_id", "title")


@query(
    "include_any_text",
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'eaux')"
    " OR contains(lower(text), 'heit') OR contains(lower(text), 'c++')",
)
def _(spark, sf_dir):
    return documents(spark, sf_dir).where(include_any(F.col("text"), WORDY)).select("doc_id")


@query(
    "include_all_text",
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion')",
)
def _(spark, sf_dir):
    return documents(spark, sf_dir).where(include_all(F.col("text"), KEYWORDS[:2])).select("doc_id")


@query(
    "exclude_title",
    f"{PAPERS} SELECT row_id, title FROM papers WHERE coalesce(NOT {ANY_TITLE}, true)",
)
def _(spark, sf_dir):
    return papers(spark, sf_dir).where(exclude(F.col("title"), KEYWORDS)).select("row_id", "title")


@query(
    "empty_keyword_lists",
    f"""{PAPERS} SELECT row_id, false AS any_of, title IS NOT NULL AS all_of, true AS none_of FROM papers""",
)
def _(spark, sf_dir):
    title = F.col("title")
    return papers(spark, sf_dir).select(
        "row_id",
        include_any(title, ()).alias("any_of"),
        include_all(title, ()).alias("all_of"),
        exclude(title, ()).alias("none_of"),
    )


@query(
    "length_title",
    f"{PAPERS} SELECT row_id FROM papers WHERE coalesce({WORDS_IN_TITLE} BETWEEN 5 AND 20, false)",
)
def _(spark, sf_dir):
    return papers(spark, sf_dir).where(length_between(F.col("title"), 5, 20)).select("row_id")


@query(
    "word_count_text",
    f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{WORD}')) AS BIGINT) AS words FROM documents",
)
def _(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", word_count(F.col("text")).alias("words"))


@query("screen_papers", f"{PAPERS}, {SCREENED} SELECT row_id, title, source FROM screened")
def _(spark, sf_dir):
    return apply_filter(papers(spark, sf_dir), SPEC, "title").select("row_id", "title", "source")


@query(
    "screen_whole_texts",
    f"""SELECT doc_id, lang FROM documents
    WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion')
      AND NOT contains(lower(text), 'lorem')
      AND len(regexp_extract_all(text, '{WORD}')) BETWEEN 50 AND 1000""",
)
def _(spark, sf_dir):
    spec = FilterSpec(KEYWORDS[:2], ("lorem",), match_all=True, min_words=50, max_words=1000)
    return apply_filter(documents(spark, sf_dir), spec, "text").select("doc_id", "lang")


@query(
    "filter_counts",
    f"{PAPERS}, {SCREENED} SELECT (SELECT count(*) FROM papers) AS total, count(*) AS filtered,"
    " (SELECT count(*) FROM papers) - count(*) AS removed FROM screened",
)
def _(spark, sf_dir):
    return filter_stats(papers(spark, sf_dir), SPEC.predicate(F.col("title")))


@query(
    "reset_counts",
    f"{PAPERS} SELECT count(*) AS total, count(*) AS filtered, 0::BIGINT AS removed FROM papers",
)
def _(spark, sf_dir):
    base = papers(spark, sf_dir)
    return filter_stats(reset_filters(base), F.lit(True))


@query(
    "keyword_lines",
    r"""SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)),
       lambda line: regexp_matches(line, '%s'))) AS BIGINT) AS keywords FROM documents""" % WORD,
)
def _(spark, sf_dir):
    keywords = F.size(keyword_array(F.col("text"))).cast("bigint")
    return texts(spark, sf_dir).select("doc_id", keywords.alias("keywords"))


@query(
    "search_regex",
    f"{PAPERS} SELECT row_id, title FROM papers"
    " WHERE coalesce(regexp_matches(title, '^(the|und) .*(ing|heit)', 'i'), false)",
)
def _(spark, sf_dir):
    return search(papers(spark, sf_dir), "^(the|und) .*(ing|heit)", title="title").select("row_id", "title")


@query(
    "search_literal_text",
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'é. ')",
)
def _(spark, sf_dir):
    return search(documents(spark, sf_dir), "É. ", mode="literal", title="text").select("doc_id")


@query(
    "remove_rows",
    f"{PAPERS} SELECT row_id, title FROM papers WHERE row_id NOT IN"
    " (SELECT doc_id FROM labels WHERE quality = 0)",
)
def _(spark, sf_dir):
    bad = table(spark, sf_dir, "labels").where("quality = 0").selectExpr("doc_id AS row_id")
    return remove_rows(papers(spark, sf_dir), bad).select("row_id", "title")


@query(
    "remove_rows_report",
    f"""{PAPERS} SELECT (SELECT count(*) FROM labels WHERE quality = 0) AS requested,
      count(*) FILTER (row_id IN (SELECT doc_id FROM labels WHERE quality = 0)) AS removed,
      count(*) FILTER (row_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)) AS remaining
    FROM papers""",
)
def _(spark, sf_dir):
    bad = table(spark, sf_dir, "labels").where("quality = 0").selectExpr("doc_id AS row_id")
    return removal_report(papers(spark, sf_dir), bad)


def _ranked(source: str, key: str, order: str) -> str:
    return (
        f"SELECT * FROM {source} QUALIFY"
        f" row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"
    )


@query("dedup_title_first", f"{PAPERS} {_ranked('papers', 'title', 'row_id')}")
def _(spark, sf_dir):
    return remove_duplicates(papers(spark, sf_dir))


@query("dedup_title_last", f"{PAPERS} {_ranked('papers', 'title', 'row_id DESC')}")
def _(spark, sf_dir):
    return remove_duplicates(papers(spark, sf_dir), keep="last")


@query(
    "dedup_title_none",
    f"{PAPERS} SELECT * FROM papers QUALIFY count(*) OVER (PARTITION BY title) = 1",
)
def _(spark, sf_dir):
    return remove_duplicates(papers(spark, sf_dir), keep=False)


@query("dedup_two_columns", _ranked("part", "p_name, p_brand", "p_partkey"))
def _(spark, sf_dir):
    return remove_duplicates(
        table(spark, sf_dir, "part"), ["p_name", "p_brand"], order="p_partkey"
    )


@query("dedup_whole_text", _ranked("documents", "text", "doc_id"))
def _(spark, sf_dir):
    return remove_duplicates(documents(spark, sf_dir), "text", order="doc_id")


@query(
    "dedup_report",
    f"{PAPERS} SELECT count(*) AS original, count(*) - count(DISTINCT coalesce(title, chr(1))) AS removed,"
    " count(DISTINCT coalesce(title, chr(1))) AS remaining FROM papers",
)
def _(spark, sf_dir):
    return duplicate_report(papers(spark, sf_dir))


@query(
    "dataset_stats",
    f"""{PAPERS}, kept AS ({_ranked('papers', 'title', 'row_id')}), counts AS (
      SELECT (SELECT count(*) FROM papers) AS original_count, (SELECT count(*) FROM kept) AS current_count)
    SELECT original_count, current_count, original_count - current_count AS removed,
      round(CAST(original_count - current_count AS DOUBLE) * 100 / original_count, 6) AS removal_rate,
      'title,authors,year_raw,abstract,doi,source' AS columns FROM counts""",
)
def _(spark, sf_dir):
    base = papers(spark, sf_dir)
    return dataset_stats(base, remove_duplicates(base)).withColumns(
        {"removal_rate": F.round("removal_rate", 6), "columns": F.array_join("columns", ",")}
    )


@query(
    "page_of_search",
    f"{PAPERS} SELECT row_id, title FROM papers WHERE coalesce(regexp_matches(title, 'the', 'i'), false)"
    " ORDER BY row_id LIMIT 50 OFFSET 100",
)
def _(spark, sf_dir):
    found = page(papers(spark, sf_dir).select("row_id", "title"), page=2, per_page=50, search_for="the")
    return found


@query(
    "deep_page",
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 12500",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return page(orders, page=250, per_page=50, order="o_orderkey")


@query(
    "page_info",
    f"""{PAPERS}, {SCREENED} SELECT count(*) AS total, 2 AS page, 50 AS per_page,
      CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages, true AS has_previous,
      3 < ceil(count(*) / 50.0) AS has_next FROM screened""",
)
def _(spark, sf_dir):
    return page_info(apply_filter(papers(spark, sf_dir), SPEC, "title"), page=2, per_page=50)


# Sixty syllables of four letters or less, and all pairs of them as keywords.
SYLLABLES = tuple(a + b for a in ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha") for b in
                  ("at", "en", "es", "of", "or", "xq"))
PAIRED = tuple(a + b for a in SYLLABLES for b in SYLLABLES)
_PAIRS = f"""syllables AS (SELECT unnest([{", ".join(f"'{s}'" for s in SYLLABLES)}]) AS s),
    keywords AS (SELECT a.s || b.s AS k FROM syllables a, syllables b)"""


@query(
    "include_any_of_thousands",
    f"""{PAPERS}, {_PAIRS} SELECT row_id FROM papers WHERE abstract IS NOT NULL
      AND EXISTS (SELECT 1 FROM keywords WHERE contains(lower(abstract), k))""",
)
def _(spark, sf_dir):
    """3,600 keywords on whole texts, by stretches of letters instead of one by one."""
    base = papers(spark, sf_dir)
    return base.where(include_any(F.col("abstract"), PAIRED)).select("row_id")


@query(
    "title_page_of_order",
    f"""{PAPERS} SELECT row_id, title, abstract FROM papers ORDER BY title NULLS FIRST, row_id LIMIT 25 OFFSET 100""",
)
def _(spark, sf_dir):
    """The fifth page by title of a stored order; the third is read from it before."""
    path = scratch_folder(spark, "by-title")
    stored = store_ordered(papers(spark, sf_dir).select("row_id", "title", "abstract"), path, "title", "row_id")
    stored.page(2, 25).count()
    return stored.page(4, 25)
