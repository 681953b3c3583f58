"""Finding columns by name and projecting to the canonical paper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlesieve.functions.names import column
from titlesieve.functions.text import is_blank, parse_year

# Each role and the name fragments that mark it, in order of priority.
ROLE_MARKS = {
    "title": ("title",),
    "authors": ("author",),
    "year": ("year", "date"),
    "abstract": ("abstract",),
    "doi": ("doi",),
    "source": ("source", "journal"),
}
CONFIDENCE = "nlp_confidence"
CANONICAL = (*ROLE_MARKS, CONFIDENCE)


def find_title_column(df: DataFrame) -> str:
    """First column whose name contains ``title`` in any case, else the first column."""
    names = [name for name in df.columns if name != "row_id"]
    return next((name for name in names if "title" in name.lower()), names[0])


def require_columns(df: DataFrame) -> tuple[DataFrame, str, str]:
    """``(df, title, abstract)``; no title is an error, no abstract adds a null one."""

    def first_with(fragment: str) -> str | None:
        return next((name for name in df.columns if fragment in name.lower()), None)

    title, abstract = first_with("title"), first_with("abstract")
    if title is None:
        raise ValueError("no title column")
    if abstract is None:
        abstract = "Abstract"
        df = df.withColumn(abstract, F.lit(None).cast("string"))
    return df, title, abstract


def map_columns(df: DataFrame, policy: str = "first") -> dict[str, str]:
    """Role -> column name. Several columns may fit a role; ``policy`` picks one.

    ``last`` is what a plain scan that overwrites earlier finds would give, so that
    ``Source title`` takes the title role from ``Title``. With ``first`` a column whose
    role is taken gets the next role that it fits, so that one becomes the source.
    """
    if policy not in ("first", "last"):
        raise ValueError("policy must be 'first' or 'last'")
    found: dict[str, str] = {}
    for name in df.columns:
        lowered = name.lower()
        roles = [role for role, marks in ROLE_MARKS.items() if any(m in lowered for m in marks)]
        if policy == "first":
            roles = [role for role in roles if role not in found]
        if roles:
            found[roles[0]] = name
    if CONFIDENCE in df.columns:
        found[CONFIDENCE] = CONFIDENCE
    if "title" not in found:
        raise ValueError("no title column")
    return found


def to_canonical(df: DataFrame, mapping: dict[str, str], keep=("row_id",)) -> DataFrame:
    """The seven canonical columns as text and INT year; roles not mapped are null.

    The year's text is kept as ``year_raw`` so that a load can tell a year that is
    out of range from one that is missing.
    """
    text = {
        role: column(mapping[role]).cast("string") if role in mapping else F.lit(None).cast("string")
        for role in CANONICAL
    }
    columns = [
        parse_year(text[role]).alias("year") if role == "year" else text[role].alias(role)
        for role in CANONICAL
    ]
    return df.select(
        *[name for name in keep if name in df.columns], *columns, text["year"].alias("year_raw")
    )


def drop_blank_titles(df: DataFrame, title: str = "title") -> DataFrame:
    """Rows whose title has something other than white space."""
    return df.where(column(title).isNotNull() & ~is_blank(column(title)))


def with_verdict_columns(df: DataFrame) -> DataFrame:
    """Add null ``nlp_decision`` and ``nlp_confidence``."""
    empty = F.lit(None).cast("string")
    return df.withColumns({"nlp_decision": empty, "nlp_confidence": empty})
