"""Repair of the structure of conversations at the least cost.

Rows get one symbol each from their role and their first fault (blank, duplicate,
truncated). Symbols of a conversation are put together, its texts are not: edits are found
by :mod:`titlesieve.llm.edit_tables` and sent back to the stretches that hold the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from titlesieve.llm.edit_tables import AFTER_S, GONE, START, TURN_OF, tables
from titlesieve.sources.storage import materialise

#: Rows, and characters of text, that a stretch of a conversation holds at most, if it
#: has more than one row.
STRETCH_ROWS, STRETCH_CHARS = 1_024, 1 << 20
#: Characters of role and text that order rows of one turn before a digest does.
TIE_CHARS = 64
_BLANKS = " \t\n\x0b\x0c\r"
_FINE, _TRUNCATED, _BLANK, _DUPLICATE = range(4)
_LARGEST = (1 << 63) - 1


def _marked(conversations: DataFrame) -> DataFrame:
    """Different rows of each conversation: their number, symbol, and order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
    )
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    different = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    different = materialise(different.withColumn("said", F.sha2(said, 256)), "chat-rows")
    # The first turn of what is said. One row per key on both sides: no key is hot here.
    first = (
        different.groupBy("conv", "said")
        .agg(F.max(F.col("turn").isNull()).alias("null"), F.min("turn").alias("least"))
        .select(
            F.col("conv").alias("first_conv"),
            F.col("said").alias("first_said"),
            F.when(~F.col("null"), F.col("least")).alias("first_turn"),
        )
    )
    same = (
        F.col("conv").eqNullSafe(F.col("first_conv"))
        & (F.col("said") == F.col("first_said"))
        & F.col("turn").eqNullSafe(F.col("first_turn"))
    )
    end = F.rtrim(F.col("text"), F.lit(_BLANKS))
    whole = F.substring(end, -1, 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    fault = (
        F.when(end == "", _BLANK)
        .when(F.col("first_said").isNull(), _DUPLICATE)
        .when(~whole, _TRUNCATED)
        .otherwise(_FINE)
    )
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return different.join(first, same, "left").select(
        "conv", "turn", "role", "text", "said", "copies", (number + 4 * fault).alias("symbol")
    )


def _stretch_schema(conv: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField("conv", conv)]
        + T.StructType.fromDDL(
            "part int, seq int, symbols binary, roles array<string>, texts array<string>,"
            " first long, last long, turns long"
        ).fields
    )


def _stretches(marked: DataFrame) -> DataFrame:
    """Consecutive rows of conversations, in the order of (part, seq) over all tasks.

    A range sort deals a conversation over as many tasks as its rows need.
    """
    order = [
        F.col("conv"),
        F.col("turn"),
        F.substring("role", 1, TIE_CHARS),
        F.substring("text", 1, TIE_CHARS),
        F.col("said"),
    ]
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = dealt.select("conv", "turn", "role", "text", "copies", "symbol")
    schema = _stretch_schema(marked.schema["conv"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        kind = None
        symbols, roles, texts, turns, chars, conv = bytearray(), [], [], [], 0, None

        def out() -> pa.RecordBatch:
            seen = [t for t in turns if t is not None]
            span = (seen[0], seen[-1], len(set(seen))) if seen else (None, None, 0)
            cells = [conv, part, seq, bytes(symbols), roles, texts, *span]
            kinds = [kind, pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()),
                     pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array([cell], k) for cell, k in zip(cells, kinds)], names=schema.names
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, STRETCH_ROWS):
                columns = [c.to_pylist() for c in batch.slice(at, STRETCH_ROWS).columns]
                for own, turn, role, text, copies, symbol in zip(*columns):
                    if symbols and (
                        own != conv or len(symbols) >= STRETCH_ROWS or chars >= STRETCH_CHARS
                    ):
                        yield out()
                        seq += 1
                        symbols, roles, texts, turns, chars = bytearray(), [], [], [], 0
                    conv = own
                    turns.append(turn)
                    symbols.append(symbol)
                    if symbol < 4 * _BLANK:
                        roles.append(role)
                        texts.append(text)
                        chars += len(text)
                    # Further copies of a row come right after it; they cannot stay.
                    again = symbol if symbol >= 4 * _BLANK else symbol % 4 + 4 * _DUPLICATE
                    while copies > 1:
                        some = min(copies - 1, STRETCH_CHARS)
                        symbols += bytes([again]) * some
                        copies -= some
                        if copies > 1:
                            yield out()
                            seq += 1
                            symbols, roles, texts, turns, chars = bytearray(), [], [], [turn], 0
        if symbols:
            yield out()

    return materialise(rows.mapInArrow(run, schema), "chat-stretches")


_PLAN = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long,"
    " audit string, pieces array<struct<part int, seq int, state int, letters string>>"
)


def _plans(stretches: DataFrame) -> DataFrame:
    """Counts and cheapest edits of each conversation, from its symbols alone."""
    fields = ["part", "seq", "symbols", "first", "last", "turns"]
    whole = stretches.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("stretches")
    )
    conv = stretches.schema["conv"]
    schema = T.StructType([conv] + T.StructType.fromDDL(_PLAN).fields)
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STRETCH_ROWS):
                some = batch.slice(at, STRETCH_ROWS)
                rows = [_plan(parts) for parts in some.column(1).to_pylist()]
                columns = [pa.array(c, kinds.field(i + 1).type) for i, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], names=kinds.names)

    return materialise(whole.mapInArrow(run, schema), "chat-plans")


def _plan(parts: list[dict]) -> tuple:
    every = np.frombuffer(b"".join(p["symbols"] for p in parts), np.uint8)
    initials, faults = every & 3, every >> 2
    counts = np.bincount(faults, minlength=4)
    pairs = initials[:-1] * 4 + initials[1:]
    illegal = int((~np.isin(pairs, [1, 6, 9])).sum())  # su, ua, au
    symbols = np.where(faults >= _BLANK, GONE, every)
    cost, letters, tail = tables().solve(symbols)
    pieces, at, state = [], 0, START
    for part in parts:
        size = len(part["symbols"])
        own = "".join(letters[at : at + size])
        at += size
        if at == len(letters):
            own += tail
        pieces.append((part["part"], part["seq"], state, own))
        if at < len(letters):
            state = _state_after(own, every[at - size : at].tolist(), state)
    return (
        _gaps(parts), int(counts[_BLANK]), int(counts[_DUPLICATE]), int(counts[_TRUNCATED]),
        illegal, cost, "".join(letters) + tail, pieces,
    )


def _state_after(letters: str, symbols: list[int], state: int) -> int:
    row = 0
    for letter in letters:
        if letter != "D":
            system = letter == "K" and symbols[row] % 4 == 0
            state = AFTER_S if system else TURN_OF[state]
        row += letter != "I"
    return state


def _gaps(parts: list[dict]) -> int:
    """Turns missing between the least and the largest, nulls not counted."""
    seen = [p for p in parts if p["first"] is not None]
    if not seen:
        return 0
    shared = sum(a["last"] == b["first"] for a, b in zip(seen, seen[1:]))
    distinct = sum(p["turns"] for p in seen) - shared
    return min(seen[-1]["last"] - seen[0]["first"] + 1 - distinct, _LARGEST)


_ROLES = {1: "user", 2: "user", 3: "assistant"}


def _edited(symbols: bytes, roles: list[str], texts: list[str], state: int, letters: str):
    """(edit, role, text) of the rows of a stretch and those put in; None where deleted."""
    row = stay = 0
    for letter in letters:
        if letter == "I":
            state = TURN_OF[state]
            yield letter, _ROLES[state], ""
            continue
        symbol = symbols[row]
        row += 1
        if letter == "D":
            stay += symbol < 4 * _BLANK
            yield letter, None, None
            continue
        role, text = roles[stay], texts[stay]
        stay += 1
        if letter == "R":
            state = TURN_OF[state]
            role = _ROLES[state]
        else:
            state = AFTER_S if symbol % 4 == 0 else TURN_OF[state]
        yield letter, role, text


class Repaired:
    """What was found about conversations, and their rows after repair."""

    def __init__(self, stretches: DataFrame, plans: DataFrame) -> None:
        self._stretches, self._found = stretches, plans

    def plans(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, by conversation."""
        return self._found.drop("pieces").withColumnRenamed("conv", "conv_id")

    def _parts(self) -> DataFrame:
        pieces = self._found.select(F.explode("pieces").alias("p")).select("p.*")
        return self._stretches.join(pieces, ["part", "seq"]).select(
            "conv", "part", "seq", "symbols", "roles", "texts", "state", "letters"
        )

    def rows(self) -> DataFrame:
        """conv_id, part, seq, place, edit, role, text: every edit in order, distributed.

        (part, seq, place) orders a conversation. Rows with edit D are not in the result
        of the repair: their role and text are null.
        """
        conv = self._stretches.schema["conv"].dataType
        schema = T.StructType(
            [T.StructField("conv_id", conv)]
            + T.StructType.fromDDL(
                "part int, seq int, place int, edit string, role string, text string"
            ).fields
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1)
                    cells = [c[0].as_py() for c in row.columns]
                    edits = list(_edited(*cells[3:]))
                    if not edits:
                        continue
                    n = len(edits)
                    own = pa.concat_arrays([row.column(0)] * n)
                    fixed = [pa.array([v] * n, pa.int32()) for v in cells[1:3]]
                    edit, role, text = (pa.array(c, pa.string()) for c in zip(*edits))
                    place = pa.array(range(n), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [own, *fixed, place, edit, role, text], names=schema.names
                    )

        return self._parts().mapInArrow(run, schema)

    def digests(self) -> DataFrame:
        """conv_id, repaired_sha256: of the lines ``role:text`` joined by line breaks.

        A digest is taken over one text from its start to its end, so the stretches of a
        conversation pass one task, in order, one at a time; none is kept there.
        """
        conv = self._stretches.schema["conv"].dataType
        joined = T.StructType(
            [T.StructField("conv", conv)]
            + T.StructType.fromDDL("part int, seq int, lines string").fields
        )

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns[3:]]
                lines = []
                for cells in zip(*columns):
                    kept = [f"{role}:{text}" for edit, role, text in _edited(*cells) if edit != "D"]
                    lines.append("\n".join(kept) if kept else None)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(lines, pa.string())], names=joined.names
                )

        lines = self._parts().mapInArrow(join, joined)
        dealt = lines.repartition("conv").sortWithinPartitions("conv", "part", "seq")
        schema = T.StructType(
            [T.StructField("conv_id", conv), T.StructField("repaired_sha256", T.StringType())]
        )

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            conv = state = kind = None
            begun = False
            done: list[tuple] = []

            def out() -> pa.RecordBatch:
                ids, texts = zip(*done)
                return pa.RecordBatch.from_arrays(
                    [pa.array(ids, kind), pa.array(texts, pa.string())], names=schema.names
                )

            for batch in batches:
                kind = batch.schema.field(0).type
                for own, text in zip(batch.column(0).to_pylist(), batch.column(3)):
                    if state is None or own != conv:
                        if state is not None:
                            done.append((conv, state.hexdigest()))
                        conv, state, begun = own, hashlib.sha256(), False
                    if text.is_valid:
                        state.update((b"\n" if begun else b"") + text.as_py().encode())
                        begun = True
                if len(done) >= STRETCH_ROWS:
                    yield out()
                    done = []
            if state is not None:
                done.append((conv, state.hexdigest()))
                yield out()

        return dealt.mapInArrow(digest, schema)


def repair(conversations: DataFrame) -> Repaired:
    """The cheapest repair of each conversation of rows (conv_id, turn, role, text).

    Rows of a conversation are taken by turn, a null turn first; rows of one turn by the
    first 64 characters of role and text, then by a SHA-256 of both; repeated rows stay
    together. A null role or text is one space, a null conv_id is a conversation of its
    own, other columns are ignored, and an empty table gives none.

    The first fault of a row counts: ``blank`` (nothing but spaces and 0x09-0x0D),
    ``duplicate`` (role and text were in the conversation before, by SHA-256), then
    ``truncated`` (the last other character is not ``.``, ``!`` or ``?``). ``illegal``
    counts neighbours whose role initials are not su, ua or au, ``gaps`` the turns missing
    between the least and the largest. Edits and their costs are those of
    :mod:`titlesieve.llm.edit_tables`; ``audit`` has their letters.

    A row of the plans holds a conversation's symbols and letters, one byte for each row,
    as its audit is one text. Texts stay where the range sort put them.
    """
    stretches = _stretches(_marked(conversations))
    return Repaired(stretches, _plans(stretches))
