"""Word frequencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlesieve.functions.stopwords import STOP_WORDS
from titlesieve.operators.words import PLACES, with_relative, word_counts, word_frequencies
from titlesieve.plans.flows import top_words
from workload.registry import query
from workload.screening import PAPERS, SPEC, SPEC_SQL, papers, texts
from workload.views import table

STOPS = ", ".join(f"'{word}'" for word in STOP_WORDS)


def counted(source: str, key: str, text: str, stops: str = STOPS) -> str:
    """SQL for word, count and first place, by unnesting runs of word characters."""
    return f"""
    runs AS (SELECT {key} AS row_id, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+') AS tokens
             FROM {source} WHERE {text} IS NOT NULL),
    places AS (SELECT row_id, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS place FROM runs),
    counted AS (SELECT word, count(*) AS count, min({{'r': row_id, 'p': place}}) AS first FROM places
                WHERE regexp_full_match(word, '[a-z]{{3,}}') AND word NOT IN ({stops}) GROUP BY word)"""


@query(
    "word_frequencies_title",
    f"{PAPERS}, {counted('papers', 'row_id', 'title')}"
    " SELECT word, count FROM counted ORDER BY count DESC, first LIMIT 30",
)
def _(spark, sf_dir):
    return word_frequencies(papers(spark, sf_dir), "title")


@query(
    "word_frequencies_text",
    f"WITH {counted('documents', 'doc_id', 'text')}"
    " SELECT word, count FROM counted ORDER BY count DESC, first LIMIT 50",
)
def _(spark, sf_dir):
    return word_frequencies(texts(spark, sf_dir), "text", top_n=50, order="doc_id")


@query(
    "word_counts_text",
    f"WITH {counted('documents', 'doc_id', 'text')}"
    " SELECT word, count, first.r AS first_row FROM counted",
)
def _(spark, sf_dir):
    counts = word_counts(texts(spark, sf_dir), "text", order="doc_id")
    return counts.select("word", "count", F.expr(f"cast(first div {PLACES}BD as bigint)").alias("first_row"))


# Stop words may also come as a table of any size; here, the words of the benchmark texts.
_BENCHMARK_WORDS = (
    "SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) FROM benchmark"
)


@query(
    "word_frequencies_stop_table",
    f"WITH {counted('documents', 'doc_id', 'text', _BENCHMARK_WORDS)}"
    " SELECT word, count FROM counted ORDER BY count DESC, first LIMIT 30",
)
def _(spark, sf_dir):
    stops = word_counts(
        table(spark, sf_dir, "benchmark"), "text", stop_words=(), order="item_id"
    )
    return word_frequencies(texts(spark, sf_dir), "text", stop_words=stops, order="doc_id")


@query(
    "word_bars",
    f"""{PAPERS}, {counted('papers', 'row_id', 'title')},
    top AS (SELECT word, count FROM counted ORDER BY count DESC, first LIMIT 30)
    SELECT word, count, round(CAST(count AS DOUBLE) * 100 / max(count) OVER (), 6) AS relative FROM top""",
)
def _(spark, sf_dir):
    bars = with_relative(word_frequencies(papers(spark, sf_dir), "title"))
    return bars.withColumn("relative", F.round("relative", 6))


@query(
    "screened_title_words",
    f"""{PAPERS}, unique_titles AS (
      SELECT * FROM papers QUALIFY row_number() OVER (PARTITION BY title ORDER BY row_id) = 1),
    screened AS (SELECT * FROM unique_titles WHERE {SPEC_SQL}), {counted('screened', 'row_id', 'title')}
    SELECT word, count FROM counted ORDER BY count DESC, first LIMIT 30""",
)
def _(spark, sf_dir):
    return top_words(papers(spark, sf_dir), SPEC)
