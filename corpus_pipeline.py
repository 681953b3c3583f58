"""A training corpus from documents, in stages; every stage reads what the last one wrote."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlesieve.llm import language_id, sentencepiece_sampling
from titlesieve.llm.batches import BYTES_AT_ONCE, ROWS_AT_ONCE
from titlesieve.llm.decontamination import decontaminate
from titlesieve.llm.minhash import drop_near_duplicates
from titlesieve.llm.registry import ship, table
from titlesieve.llm.substring_dedup import remove_repeats
from titlesieve.sources.storage import materialise

#: A document goes if its language is undetermined or its posterior is not above this.
LEAST_LANGUAGE_SCORE = 0.5


def ready(spark: SparkSession) -> None:
    """Stages share executors: rows reach Python workers in as small batches as they are used in."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_AT_ONCE)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the labelled ones, told by their text alone.

    Without any labelled document nothing can be told, and all stay.
    """
    ready(spark)
    model = language_id.fit(docs, F.lit(True))
    if model is None:
        return docs
    scored = language_id.identify(docs, model)
    good = (F.col("lang_pred") != language_id.UNDETERMINED) & (
        F.col("lang_score") > LEAST_LANGUAGE_SCORE
    )
    return scored.where(good).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ready(spark)
    return drop_near_duplicates(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words and more that start earlier elsewhere."""
    ready(spark)
    return remove_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the ids of the text, their number, and sampled segmentations."""
    ready(spark)
    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    rows = docs.select("doc_id", "source", "lang", "text")
    coded = sentencepiece_sampling.segment(rows, model)
    return coded.drop("text").withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("language_id", known_language),
    ("minhash_dedup", without_near_duplicates),
    ("substring_dedup", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

#: Language models and sampled segmentations are not for SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents, every stage stored and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
