"""Classifier replies: strict parsing and choice among attempts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from titlesieve.functions.text import bind, strip

# The verdicts a reply may carry, and what stands in for bad ones.
DECISIONS = ("keep", "reject")
FENCE = "```"
FALLBACK_DECISION = "reject"
FALLBACK_CONFIDENCE = "low"
MISSING_CONFIDENCE = "unknown"

_REPLY_SCHEMA = "array<struct<decision:string,confidence:string>>"


def _unfenced(text: Column) -> Column:
    inside = F.get(F.split(text, FENCE), F.lit(1))
    return F.when(text.startswith(FENCE), strip(F.regexp_replace(inside, "^json", ""))).otherwise(text)


def _judged(body: Column, parsed: Column) -> Column:
    only = F.get(parsed, F.lit(0))
    valid = (
        body.startswith("{")
        & body.endswith("}")
        & (F.size(parsed) == 1)
        & only["decision"].isin(*DECISIONS)
    )
    has_confidence = F.array_contains(F.json_object_keys(body), "confidence")
    given = F.when(has_confidence, only["confidence"]).otherwise(MISSING_CONFIDENCE)
    return F.when(
        valid,
        F.struct(
            F.lit(True).alias("valid"),
            only["decision"].alias("decision"),
            given.alias("confidence"),
        ),
    ).otherwise(
        F.struct(
            F.lit(False).alias("valid"),
            F.lit(FALLBACK_DECISION).alias("decision"),
            F.lit(FALLBACK_CONFIDENCE).alias("confidence"),
        )
    )


def parse_reply(reply: Column) -> Column:
    """``struct<valid, decision, confidence>`` of one reply text; null for null.

    Spark's JSON readers take trailing text after an object. Reading the reply as
    the only element of an array makes such replies fail, as they should.
    """

    def judge(body: Column) -> Column:
        parsed = F.from_json(
            F.concat(F.lit("["), body, F.lit("]")), _REPLY_SCHEMA, {"allowSingleQuotes": "false"}
        )
        return bind(parsed, lambda objects: _judged(body, objects))

    return F.when(
        reply.isNotNull(), bind(strip(reply), lambda text: bind(_unfenced(text), judge))
    )


def resolve_attempts(replies: Column, retry_count: int = 3) -> Column:
    """``struct<decision, confidence>`` of the first valid reply among the attempts.

    ``replies`` holds one text per attempt, in order. When no attempt is valid the
    verdict is reject / low. Null (never asked) and ``retry_count=0`` give null.
    """
    if retry_count < 0:
        raise ValueError("retry_count must not be negative")
    if retry_count == 0:
        return F.lit(None).cast("struct<decision:string,confidence:string>")
    fallback = F.struct(
        F.lit(True).alias("valid"),
        F.lit(FALLBACK_DECISION).alias("decision"),
        F.lit(FALLBACK_CONFIDENCE).alias("confidence"),
    )
    attempts = F.transform(F.slice(replies, 1, retry_count), parse_reply)
    valid = F.filter(attempts, lambda attempt: attempt["valid"])
    return bind(
        F.get(F.concat(valid, F.array(fallback)), F.lit(0)),
        lambda first: F.when(first.isNotNull(), F.struct(first["decision"], first["confidence"])),
    )
