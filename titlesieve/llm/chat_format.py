"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all preceding turns as context, and only that
reply trainable. A turn is written as

    <s>[INST] role [/INST] text </s>

and control strings inside roles and texts are escaped reversibly: each ``<s>``, ``</s>``,
``[INST]`` or ``[/INST]`` gets a backslash after its bracket, and one that already has
backslashes there gets one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", " </s>"
_ESCAPE = r"([<\[])(\\*/?(?:s>|INST\]))"
_UNESCAPE = r"([<\[])\\(\\*/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    """``text`` without a control string of the template; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`."""
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def format_conversations(conversations: DataFrame, trainable_role: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example, formatted, loss_start, loss_length.

    ``conversations`` has conv_id, turn, role and text; other columns are ignored. Rows of
    a conversation are taken by turn; equal turns by role, then text; repeated rows stay.
    A null conv_id is a conversation of its own, null roles and texts are empty, a null
    turn comes first. ``loss_start`` (from 0) and ``loss_length`` give in code points the
    part of ``formatted`` that is trained on: the escaped reply, without its markers.

    Turns after the last reply would be lost, so a conversation that does not end with a
    reply has one more example, with all its turns and a mask of length 0. ``example``
    counts from 0. An empty table gives no rows.

    A conversation is gathered in one row, as its examples are texts over all its turns;
    its size is that of one training example. The examples of one conversation together
    are quadratic in its turns by definition of the expansion, and are made row by row.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = whole.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == trainable_role).alias("target"),
                F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        ).alias("parts"),
    )
    last = F.size("parts") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("parts", i)["target"])
    ends = F.when(F.get("parts", last)["target"], targets).otherwise(
        F.array_append(targets, last)
    )
    examples = parts.select("conv_id", "parts", F.posexplode(ends).alias("example", "end"))
    context = F.array_join(
        F.transform(
            F.slice("parts", F.lit(1), F.col("end")),
            lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE)),
        ),
        "",
    )
    end = F.get("parts", F.col("end"))
    split = examples.select(
        "conv_id",
        "example",
        F.concat(context, end["head"]).alias("before"),
        end["body"].alias("body"),
        end["target"].alias("target"),
    )
    return split.select(
        "conv_id",
        "example",
        F.concat("before", "body", F.lit(CLOSE)).alias("formatted"),
        F.length("before").alias("loss_start"),
        F.when(F.col("target"), F.length("body")).otherwise(0).alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation of what :func:`format_conversations` wrote.

    conv_id, turns (array of role and text, parsed from the last example, which holds all
    turns), losses (the unescaped text under each mask, in order), formatted_chars (code
    points of all examples together).
    """
    row = F.struct(
        "example",
        F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")).alias("loss"),
        (F.col("loss_length") >= 0).alias("any"),
    )
    gathered = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"),
        F.sort_array(F.collect_list(row)).alias("masks"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    blocks = F.slice(
        F.split("formatted", r" </s>"), F.lit(1), F.size(F.split("formatted", r" </s>")) - 1
    )
    middle = F.lit(MIDDLE)

    def parse(block: Column) -> Column:
        at = F.instr(block, MIDDLE)
        return F.struct(
            unescape(F.substring(block, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"),
            unescape(F.substring(block, at + F.length(middle), F.length(block))).alias("text"),
        )

    return gathered.select(
        "conv_id",
        F.transform(blocks, parse).alias("turns"),
        F.transform("masks", lambda m: unescape(m["loss"])).alias("losses"),
        "formatted_chars",
    )
