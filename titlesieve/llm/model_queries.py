"""Registered queries of the operators that fit a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlesieve.llm import language_id, quality, toxicity
from titlesieve.llm.registry import query, table
from titlesieve.sources.storage import materialise, spread


def _fold(folds: int):
    """crc32 of the id as text modulo ``folds``; 0 for a null id."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds))


@query("op2_language_id")
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, _fold(4) != 2)
    scored = language_id.identify(docs.select("doc_id", "text"), model, keep_text=False)
    return scored.select(
        "doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


@query("op8_quality")
def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    values = materialise(quality.with_statistics(docs, keep_text=False), "statistics")
    labels = table(spark, sf_dir, "labels").where(_fold(5) != 0).select("doc_id", "quality")
    scored = quality.score(values, quality.fit(values, labels))
    return scored.select(
        "doc_id",
        (_fold(5) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op13_toxicity")
def op13_toxicity(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = table(spark, sf_dir, "labels").where(_fold(4) != 2).select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), keep_text=False)
    return scored.select(
        "doc_id",
        (_fold(4) == 2).alias("held_out"),
        F.col("toxicity_score").alias("score"),
        (F.col("toxicity_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )
