"""Cheapest edits of role sequences by block tables, after the method of the Four Russians.

A conversation is a sequence of symbols, one per row. Edits turn its role initials into
``(s?(ua)+)?``. From the last row to the first, the costs still to come from each of the
four states of that pattern form a vector. Less its least entry it is one of a few, so
what a block of four symbols does to it is a number in a table.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: States: nothing out yet, after s, after u, after a. The first and the last may end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Cost of each edit, in the order of its letter; a truncated row that stays adds one more.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
#: The state after a user or assistant row is put where one may stand.
TURN_OF = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: Symbols: initial s, u, a, other; the same truncated; a row that must go.
SYMBOLS, GONE = 9, 8
BLOCK = 4


def _kept(symbol: int, state: int) -> int | None:
    """The state after keeping a row, None where it may not stand."""
    initial = symbol % 4
    if initial == 0:
        return AFTER_S if state == START else None
    if initial == 1:
        return AFTER_U if state != AFTER_U else None
    return AFTER_A if initial == 2 and state == AFTER_U else None


def _row_edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits that consume a row."""
    edits = [("D", DELETE, state)]
    if symbol != GONE:
        more = TRUNCATED if symbol >= 4 else 0
        after = _kept(symbol, state)
        if after is not None:
            edits.append(("K", KEEP + more, after))
        edits.append(("R", REROLE + more, TURN_OF[state]))
    return edits


def _with_inserts(costs: list[int]) -> list[int]:
    """Costs from each state if turns may be put in first."""
    for _ in range(2):
        costs = [min(costs[q], INSERT + costs[TURN_OF[q]]) for q in range(4)]
    return costs


class Tables:
    """Vectors of costs to come, and what symbols and blocks do to them."""

    def __init__(self) -> None:
        far = 10**6
        end = tuple(_with_inserts([0, far, far, 0]))
        self.vectors, known = [end], {end: 0}
        steps: list[list[tuple[int, int]]] = []
        self.choices: dict[tuple[int, int, int], tuple[str, int]] = {}
        for at, after in enumerate(self.vectors):  # grows while new vectors turn up
            steps.append([])
            for symbol in range(SYMBOLS):
                rows = [_row_edits(symbol, q) for q in range(4)]
                before = _with_inserts(
                    [min(cost + after[to] for _, cost, to in rows[q]) for q in range(4)]
                )
                least = min(before)
                vector = tuple(cost - least for cost in before)
                if vector not in known:
                    known[vector] = len(self.vectors)
                    self.vectors.append(vector)
                steps[at].append((known[vector], least))
                for q in range(4):
                    self.choices[at, symbol, q] = self._choice(rows, before, after, q)
        self.step = steps
        self._tabulate()
        self.expanded: dict[tuple[int, int, int], tuple[tuple[str, ...], int]] = {}

    @staticmethod
    def _choice(rows, before, after, state: int) -> tuple[str, int]:
        """The ASCII-least letters that consume a row at the least cost, and the state then."""
        letters = ""
        while True:
            options = [(letter, to) for letter, cost, to in rows[state]
                       if cost + after[to] == before[state]]
            if INSERT + before[TURN_OF[state]] == before[state]:
                options.append(("I", TURN_OF[state]))
            letter, state = min(options)
            letters += letter
            if letter != "I":
                return letters, state

    def _tabulate(self) -> None:
        """For each vector after a block and each block: the vector before it, and the cost."""
        to = np.array([[to for to, _ in row] for row in self.step])
        cost = np.array([[least for _, least in row] for row in self.step])
        blocks = np.arange(SYMBOLS**BLOCK)
        vector = np.repeat(np.arange(len(to))[:, None], len(blocks), axis=1)
        total = np.zeros_like(vector)
        for k in range(BLOCK):  # from the last symbol to the first
            symbol = blocks // SYMBOLS**k % SYMBOLS
            total += cost[vector, symbol]
            vector = to[vector, symbol]
        self.block_to, self.block_cost = vector, total

    def _expand(self, after: int, block: int, state: int) -> tuple[tuple[str, ...], int]:
        """Letters of each row of a block from the vector after it, and the state at its end.

        The vectors between its rows are built backward again, so that the trace through
        them, forward, can take the ASCII-least of the cheapest edits.
        """
        key = after, block, state
        if key not in self.expanded:
            symbols = [block // SYMBOLS**k % SYMBOLS for k in range(BLOCK)]
            vectors = [after]
            for symbol in symbols[:-1]:
                vectors.append(self.step[vectors[-1]][symbol][0])
            letters = []
            for symbol, vector in zip(reversed(symbols), reversed(vectors)):
                part, state = self.choices[vector, symbol, state]
                letters.append(part)
            self.expanded[key] = tuple(letters), state
        return self.expanded[key]

    def solve(self, symbols: np.ndarray) -> tuple[int, list[str], str]:
        """(least cost, letters of each row, letters after the last row).

        The letters in order are the ASCII-least of the cheapest edit sequences.
        """
        head = len(symbols) % BLOCK
        weights = SYMBOLS ** np.arange(BLOCK)[::-1]
        blocks = (symbols[head:].reshape(-1, BLOCK).astype(np.int64) @ weights).tolist()
        first = symbols[:head].tolist()
        vector, total, after = 0, 0, []
        for block in reversed(blocks):
            after.append(vector)
            total += int(self.block_cost[vector, block])
            vector = int(self.block_to[vector, block])
        for symbol in reversed(first):
            after.append(vector)
            vector, least = self.step[vector][symbol]
            total += least
        total += self.vectors[vector][START]
        state, letters = START, []
        for symbol in first:
            part, state = self.choices[after.pop(), symbol, state]
            letters.append(part)
        for block in blocks:
            parts, state = self._expand(after.pop(), block, state)
            letters += parts
        return total, letters, {AFTER_S: "II", AFTER_U: "I"}.get(state, "")


@cache
def tables() -> Tables:
    """The tables, built once by a Python process."""
    return Tables()
