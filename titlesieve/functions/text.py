"""Text rules as Spark column expressions."""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Callable
from functools import reduce
from itertools import groupby
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 Unicode space characters, as the body of a regex character class.
# Categories are a good deal faster than a list of ranges.
_SPACE = r"\s\x1c-\x1f"

WORD = f"(?U)[^{_SPACE}]+"
_EDGE_SPACE = rf"(?U)^[{_SPACE}]+|[{_SPACE}]+\z"

# Lower-case ASCII words of three letters or more that are not part of a longer
# run of letters, digits or underscores. Possessive, so that a long run which ends
# in a digit is given up at once instead of being retried letter by letter.
COUNTED_WORD = r"(?<![\p{L}\p{N}_])[a-z]{3,}+(?![\p{L}\p{N}_])"

# Beyond this many keywords the test loops over an array literal instead of being
# unrolled into one expression, which would outgrow the JVM's method size.
UNROLLED_KEYWORDS = 64
#: From so many on, "any of them" is one pattern, or looks stretches of the text up, instead
#: of each keyword.
ANCHORED_KEYWORDS = 512
#: First letters of keywords that a pattern is for: it tries their branches in turn.
PATTERN_LETTERS = 256
GRAM = 3


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    A filter's condition is compiled without sharing of common parts, and Spark moves
    filters below the projection that computes their input. Both repeat an expensive
    input, such as a lower-cased text, once for each mention. A lambda variable is
    computed once, which for several keywords outweighs that lambdas are interpreted.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Text without leading and trailing Unicode white space."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def is_blank(text: Column) -> Column:
    """True for null, empty and all-white-space text."""
    return text.isNull() | ~text.rlike(WORD)


def word_count(text: Column) -> Column:
    """Number of white-space separated words; null for null text."""
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def counted_words(text: Column) -> Column:
    """The words that word counts look at, in order of appearance."""
    return F.regexp_extract_all(F.lower(text), F.lit(COUNTED_WORD), F.lit(0))


def parse_keywords(text: str) -> tuple[str, ...]:
    """Keywords typed one per line: trimmed, blank lines dropped."""
    return tuple(line.strip() for line in text.split("\n") if line.strip())


def keyword_array(text: Column) -> Column:
    """``parse_keywords`` for a column of keyword lists."""
    lines = F.transform(F.split(text, "\n"), strip)
    return F.filter(lines, lambda line: line != "")


def _balanced(parts: list[Column], combine) -> Column:
    # A left-deep chain of hundreds of ORs would overflow the optimizer's stack.
    while len(parts) > 1:
        parts = [reduce(combine, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


def keyword_anchors(words) -> tuple[dict[str, list[str]], list[str]]:
    """Keywords by the rarest of their stretches of GRAM letters, and those too short.

    Rare is what few keywords have, so that a stretch leads to few of them; a letter
    beyond the basic plane is in no stretch, as splitting a text may cut it in two.
    """
    grams = {
        word: [g for g in (word[i : i + GRAM] for i in range(len(word) - GRAM + 1)) if max(g) < "\U00010000"]
        for word in words
    }
    often = Counter(gram for own in grams.values() for gram in set(own))
    index: dict[str, list[str]] = {}
    for word, own in grams.items():
        if own:
            index.setdefault(min(own, key=lambda g: (often[g], g)), []).append(word)
    return index, [word for word, own in grams.items() if not own]


#: Branches below one another in a pattern at most; what is left of keywords stands as it is.
NESTED_BRANCHES = 16


def _spelt(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def any_pattern(words, depth: int = NESTED_BRANCHES) -> str:
    """A regex that finds any of ``words``, which are not empty, by their common beginnings.

    At a place of the text only the branch of its letter is followed, so the cost hardly
    grows with the number of words. A word that begins with another one adds nothing.
    """
    kept: list[str] = []
    for word in sorted(set(words)):
        if not (kept and word.startswith(kept[-1])):
            kept.append(word)

    def branch(some: list[str], left: int) -> str:
        if len(some) == 1:
            return _spelt(some[0])
        start = os.path.commonprefix(some)
        rest = [word[len(start) :] for word in some]
        groups = [list(group) for _, group in groupby(rest, lambda word: word[0])]
        parts = [branch(group, left - 1) for group in groups] if left else map(_spelt, rest)
        first = "".join(_spelt(group[0][0]) for group in groups)
        return f"{_spelt(start)}(?=[{first}])(?:{'|'.join(parts)})"

    return branch(kept, depth)


def _any_patterned(lowered: Column, words: list[str]) -> Column:
    """Whether any keyword occurs, by one pattern for all.

    A pattern sees a replacement character for bytes that are no text, so keywords with
    that character are searched for as bytes, one by one.
    """
    plain = [word for word in words if "\ufffd" not in word and _is_text(word)]
    others = sorted(set(words) - set(plain))
    tests = [lowered.rlike(any_pattern(plain))] if plain else []
    tests += [lowered.contains(word) for word in others]
    return _balanced(tests, or_)


def _is_text(word: str) -> bool:
    return not any("\ud800" <= c <= "\udfff" for c in word)


def _any_anchored(lowered: Column, words: list[str]) -> Column:
    """Whether any keyword occurs, at a cost that hardly grows with their number.

    Each stretch of letters of the text is looked up once in a hash set of the keywords'
    anchors; only keywords whose anchor is in the text are searched for in it.
    """
    index, short = keyword_anchors(words)
    table = F.from_json(F.lit(json.dumps(index)), "map<string, array<string>>")

    def found(letters: Column) -> Column:
        grams = F.transform(
            letters,
            lambda c, i: F.concat(c, *[F.get(letters, i + k) for k in range(1, GRAM)]),
        )
        anchors = F.array_distinct(F.filter(grams, lambda gram: gram.isin(list(index))))
        return F.exists(
            anchors,
            lambda gram: F.exists(F.element_at(table, gram), lambda word: lowered.contains(word)),
        )

    # A test of null and false would be null.
    tests = [F.coalesce(bind(F.split(lowered, ""), found), F.lit(False))] if index else []
    tests += [lowered.contains(word) for word in short]
    return F.when(lowered.isNotNull(), _balanced(tests, or_))


def _keyword_test(text: Column, keywords, match_all: bool) -> Column:
    """Null for null text, unless the list is empty; callers decide what null means."""
    words = sorted({keyword.lower() for keyword in keywords})
    if not words:
        return F.lit(match_all)
    if len(words) == 1:
        return F.lower(text).contains(words[0])

    def test(lowered: Column) -> Column:
        if len(words) > ANCHORED_KEYWORDS and not match_all:
            first = {word[:1] for word in words}
            find = _any_patterned if "" not in first and len(first) <= PATTERN_LETTERS else _any_anchored
            return find(lowered, words)
        if len(words) > UNROLLED_KEYWORDS:
            quantifier = F.forall if match_all else F.exists
            return quantifier(F.array(*map(F.lit, words)), lambda word: lowered.contains(word))
        return _balanced([lowered.contains(word) for word in words], and_ if match_all else or_)

    return bind(F.lower(text), test)


def include_any(text: Column, keywords) -> Column:
    """At least one keyword occurs. Null text and an empty list give false."""
    # Null tests stand apart, here and below, so that they reach the scan.
    return text.isNotNull() & _keyword_test(text, keywords, match_all=False)


def include_all(text: Column, keywords) -> Column:
    """Every keyword occurs. Null text gives false, an empty list true."""
    return text.isNotNull() & _keyword_test(text, keywords, match_all=True)


def exclude(text: Column, keywords) -> Column:
    """No keyword occurs. Null text and an empty list give true."""
    return text.isNull() | ~_keyword_test(text, keywords, match_all=False)


def length_between(text: Column, min_words: int = 0, max_words: int = 1000) -> Column:
    """Word count within inclusive bounds. Null text gives false."""
    if min_words is None or max_words is None:
        raise ValueError("word bounds must be numbers")
    return text.isNotNull() & bind(word_count(text), lambda n: n.between(min_words, max_words))


def parse_year(text: Column) -> Column:
    """Year as INT, fractions cut off; null when the text is no number or too large.

    The pattern keeps out what Spark's cast takes but a number parser should not,
    such as a trailing ``d`` or ``f``.
    """
    number = F.when(text.rlike(r"[0-9.]\s*$"), text.try_cast("double"))
    return number.try_cast("int")
