import json

import pytest
from pyspark.sql import functions as F

from titlesieve.functions.replies import parse_reply, resolve_attempts

KEEP = '{"decision":"keep","confidence":"high"}'
CASES = {
    KEEP: ("keep", "high"),
    f"  {KEEP}\n": ("keep", "high"),
    f"```json\n{KEEP}\n```": ("keep", "high"),
    f"```\n{KEEP}\n```": ("keep", "high"),
    f"```json\n{KEEP}\n``` and more": ("keep", "high"),
    '{"decision":"reject"}': ("reject", "unknown"),
    '{"decision":"keep","confidence":null}': ("keep", None),
    '{"decision":"keep","confidence":"sure"}': ("keep", "sure"),
    '{"decision":"keep","note":{"confidence":"high"}}': ("keep", "unknown"),
    '{ "confidence" : "low",\n "decision" : "keep" }': ("keep", "low"),
    "{'decision':'keep'}": None,
    KEEP + " trailing": None,
    KEEP + KEEP: None,
    KEEP + "," + KEEP: None,
    f"[{KEEP}]": None,
    '{"decision":"Keep"}': None,
    '{"confidence":"high"}': None,
    '{"decision":"keep"': None,
    '"keep"': None,
    "```": None,
    "``````": None,
    "sorry": None,
    "": None,
    "{}": None,
}


def judged(text):
    """Verdict of a reply by Python's own JSON parser, None if it has no valid one."""
    body = text.strip()
    if body.startswith("```"):
        body = body.split("```")[1].removeprefix("json").strip()
    try:
        reply = json.loads(body)
    except ValueError:
        return None
    if not isinstance(reply, dict) or reply.get("decision") not in ("keep", "reject"):
        return None
    return reply["decision"], reply.get("confidence", "unknown")


def test_the_cases_themselves():
    assert {text: judged(text) for text in CASES} == CASES


def test_parse_reply(frame):
    df = frame("t string", [(text,) for text in CASES]).select("t", parse_reply(F.col("t")).alias("r"))
    got = {row.t: (row.r.valid, row.r.decision, row.r.confidence) for row in df.collect()}
    assert got == {
        text: (True, *verdict) if verdict else (False, "reject", "low") for text, verdict in CASES.items()
    }
    assert frame("t string", [(None,)]).select(parse_reply(F.col("t")).alias("r")).first().r is None


@pytest.mark.parametrize(
    "replies, retries, verdict",
    [
        (["sorry", "", KEEP], 3, ("keep", "high")),
        (["sorry", "", KEEP], 2, ("reject", "low")),
        ([KEEP, '{"decision":"reject"}'], 3, ("keep", "high")),
        (['{"decision":"keep","confidence":null}', KEEP], 3, ("keep", None)),
        ([], 3, ("reject", "low")),
        ([None, KEEP], 3, ("keep", "high")),
        (None, 3, None),
        ([KEEP], 0, None),
    ],
)
def test_attempts(frame, replies, retries, verdict):
    df = frame("replies array<string>", [(replies,)])
    row = df.select(resolve_attempts(F.col("replies"), retries).alias("v")).first()
    assert (tuple(row.v) if row.v else None) == verdict
