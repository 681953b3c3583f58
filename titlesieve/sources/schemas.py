"""Schemas and row rules of the four review tables."""

from __future__ import annotations

from pyspark.sql import types as T

from titlesieve.functions.rules import Rule, max_length, not_blank, not_null, one_of

# Table columns, length limits and allowed codes.
ROLES = ("groupmate", "supervisor", "admin")
VERDICTS = ("keep", "reject")
SEEDED_ROLE = "groupmate"

USERS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("username", T.StringType(), False),
        T.StructField("password_hash", T.StringType(), False),
        T.StructField("display_name", T.StringType()),
        T.StructField("role", T.StringType(), False),
        T.StructField("invite_code", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
PAPERS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("authors", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("doi", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("nlp_confidence", T.StringType()),
        T.StructField("nlp_reason", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
DECISIONS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("user_id", T.LongType()),
        T.StructField("paper_id", T.LongType()),
        T.StructField("decision", T.StringType(), False),
        T.StructField("decided_at", T.TimestampType()),
    ]
)
PROGRESS = T.StructType(
    [
        T.StructField("user_id", T.LongType(), False),
        T.StructField("current_paper_index", T.IntegerType()),
        T.StructField("total_kept", T.IntegerType()),
        T.StructField("total_rejected", T.IntegerType()),
        T.StructField("last_active", T.TimestampType()),
    ]
)


def user_rules() -> list[Rule]:
    return [
        not_null("username"),
        max_length("username", 50),
        not_null("password_hash"),
        max_length("password_hash", 255),
        max_length("display_name", 100),
        not_null("role"),
        max_length("role", 20),
        one_of("role", ROLES),
        max_length("invite_code", 50),
    ]


def paper_rules() -> list[Rule]:
    return [
        not_blank("title"),
        max_length("doi", 255),
        max_length("source", 100),
        max_length("nlp_confidence", 20),
    ]


def decision_rules() -> list[Rule]:
    return [not_null("decision"), max_length("decision", 10), one_of("decision", VERDICTS)]
