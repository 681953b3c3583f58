"""Reading bibliographic exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titlesieve.functions.names import column
from titlesieve.operators.columns import find_title_column
from titlesieve.operators.positions import number_scanned_rows

# Cell texts that a CSV reader takes for a missing value.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

PREFERRED_SOURCES = ("processed_papers.csv",)
FALLBACK_SOURCES = "scopus_export*.csv"
_CORRUPT, _SURPLUS = "__corrupt", "__surplus"


def _csv(spark: SparkSession, multi_line: bool):
    return spark.read.options(
        quote='"', escape='"', multiLine=multi_line, inferSchema=False, mode="PERMISSIVE",
        # Folder names such as decision=keep are not columns.
        recursiveFileLookup=True,
    )


def _header(spark: SparkSession, path, multi_line: bool) -> tuple[list[str], bool]:
    """Column names, and whether they stand in the file like this.

    Repeats get ``.1``, ``.2`` and so on, nameless ones a number.
    """
    first = _csv(spark, multi_line).csv(path).first()
    if first is None:
        raise ValueError(f"no header in {path}")
    names, taken = [], set()
    for index, cell in enumerate(first):
        base = cell or f"Unnamed: {index}"
        name, repeat = base, 0
        while name.lower() in taken:
            repeat += 1
            name = f"{base}.{repeat}"
        taken.add(name.lower())
        names.append(name)
    return names, names == list(first)


def _check_headers(spark: SparkSession, path, multi_line: bool, width: int) -> None:
    """Fail if the files of ``path`` differ in their first rows, which are their headers.

    Spark compares headers with a schema, which cannot repeat names; so where names had
    to be changed, the first rows themselves are compared, one for each file.
    """
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    cells = F.array(*[F.col(f"c{i}") for i in range(width)])
    rows = _csv(spark, multi_line).schema(schema).csv(path).select(
        cells.alias("cells"), F.monotonically_increasing_id().alias("at"), "_metadata"
    )
    begins = rows.where("_metadata.file_block_start = 0")
    heads = begins.groupBy("_metadata.file_path").agg(F.min_by("cells", "at").alias("cells"))
    found = [row.cells for row in heads.select("cells").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"files with different headers: {found[0]} and {found[1]}")


def read_papers(
    spark: SparkSession,
    path,
    null_tokens=NULL_TOKENS,
    row_id: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """Read CSV file(s) with a header, every column as text.

    ``row_id`` adds dense ids in file order, for which the parsed rows are stored
    once. ``multi_line`` allows line breaks in quoted cells at the price of one
    task per file; turn it off for large files without them. Large corpora are
    best kept as many files, or as Parquet with a ``row_id`` column.

    All files must have the same header in the same order, and no row more cells than it;
    else the read fails, whatever columns are selected. Missing cells are null. Headers are
    compared as they are in the files, repeated and empty ones too.
    """
    names, as_written = _header(spark, path, multi_line)
    if row_id and "row_id" in map(str.lower, names):
        raise ValueError("the file has a row_id column: pass row_id=False to use it")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in (*names, _CORRUPT)])
    rows = (
        _csv(spark, multi_line)
        .options(header=True, emptyValue="", enforceSchema=not as_written)
        # All cells are parsed whatever is selected, else a row too wide would not be seen.
        .options(columnNameOfCorruptRecord=_CORRUPT, columnPruning=False)
        .schema(schema)
        .csv(path)
    )
    # A row of too few or too many cells is kept as text; the latter has a cell beyond.
    width = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    again = F.from_csv(
        column(_CORRUPT), f"{width.toDDL()}, {_SURPLUS} string", {"quote": '"', "escape": '"'}
    )
    surplus = column(_CORRUPT).isNotNull() & again[_SURPLUS].isNotNull()
    failed = F.raise_error(F.concat(F.lit("more cells than headers: "), column(_CORRUPT)))
    # A filter, as a column that is not selected would not be checked. Spark asks that a
    # filter on a row's text reads one of its cells too.
    length = F.length(F.coalesce(column(names[0]), F.lit("")))
    fits = F.when(surplus, failed.cast("boolean")).otherwise(length >= 0)
    rows = rows.where(fits)
    if not as_written:
        _check_headers(spark, path, multi_line, len(names))
    cleaned = [F.when(~column(n).isin(*null_tokens), column(n)).alias(n) for n in names]
    if not row_id:
        return rows.select(*cleaned)
    return number_scanned_rows(rows.select(*cleaned, "_metadata"))


def resolve_source(
    spark: SparkSession,
    folder: str,
    preferred=PREFERRED_SOURCES,
    pattern: str = FALLBACK_SOURCES,
) -> str | None:
    """The first preferred file (or folder of part files) that exists, else the first
    match by name, else none."""
    paths = spark._jvm.org.apache.hadoop.fs
    for glob in (*preferred, pattern):
        path = paths.Path(f"{folder.rstrip('/')}/{glob}")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        names = sorted(status.getPath().toString() for status in found or ())
        if names:
            return names[0]
    return None


def describe_source(df: DataFrame, filtered: DataFrame | None = None) -> DataFrame:
    """One row: total, filtered, title_column, columns."""
    marks = df.select(F.lit(1).alias("total"), F.lit(0).alias("filtered"))
    kept = df if filtered is None else filtered
    marks = marks.unionAll(kept.select(F.lit(0), F.lit(1)))
    names = [name for name in df.columns if name != "row_id"]
    return marks.agg(
        F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(F.sum("filtered"), F.lit(0)).cast("bigint").alias("filtered"),
        F.lit(find_title_column(df)).alias("title_column"),
        F.array(*[F.lit(name) for name in names]).alias("columns"),
    )
