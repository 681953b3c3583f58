"""Writing results. Every sink writes part files in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlesieve.functions.names import column
from titlesieve.sources.versions import publish, published

# The CSV dialect that ``read_papers`` and other CSV readers take back
# unchanged, with quotes doubled and outer blanks kept.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, path: str, order_by=None, mode: str = "errorifexists") -> None:
    """Write a folder of CSV part files, each with a header.

    With ``order_by`` the parts are range-sorted, so reading them in name order
    gives the rows in that order. In a table of one column a null is written as a pair
    of quotes, since readers skip empty lines.
    """
    ordered = df.orderBy(order_by) if order_by is not None else df
    options = dict(CSV_OPTIONS)
    if len(df.columns) == 1:
        only = column(df.columns[0])
        ordered = ordered.select(F.coalesce(only.cast("string"), F.lit("")).alias(df.columns[0]))
        options["emptyValue"] = '""'
    ordered.write.mode(mode).options(**options).csv(path)


def export_nonempty(df: DataFrame, path: str, order_by=None, mode: str = "errorifexists") -> None:
    """``write_csv``, refusing an empty result.

    The check runs ``df`` as far as its first row. Behind joins or sorts that is most of
    the work, so ``materialise`` such a result first.
    """
    if df.isEmpty():
        raise ValueError("no data to export")
    write_csv(df, path, order_by, mode)


def write_triage(
    df: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists", folder: str = "decision"
) -> None:
    """One write that serves as keep, reject and full progress output.

    Partition folders ``decision=keep`` and ``decision=reject`` hold the two results; the
    whole folder, undecided rows included, is the progress file. The files hold all
    columns, ``nlp_decision`` too, so ``read_papers`` gets back what was written. The name
    of the folders is not that of a column of ``df``; give another ``folder`` if it is.
    """
    if folder.lower() in map(str.lower, df.columns):
        raise ValueError(f"there is a column {folder}: name the folders otherwise")
    parts = df.withColumn(folder, F.col("nlp_decision"))
    writer = parts.write.mode(mode).partitionBy(folder).format(format)
    if format == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer.save(path)


def publish_triage(df: DataFrame, path: str, format: str = "csv", folder: str = "decision") -> str:
    """``write_triage`` to a folder of its own, which then becomes the current one of ``path``.

    A write that stops midway leaves the version before as the current one. Returns the
    folder that was written. One writer at a time.
    """
    spark = df.sparkSession
    last = published(spark, path)
    version = 0 if last is None else last + 1
    target = f"{path}/version={version}"
    write_triage(df, target, format, "overwrite", folder)
    publish(spark, path, version)
    return target


def current_triage(spark: SparkSession, path: str) -> str | None:
    """The folder of the last version that ``publish_triage`` finished, None without any."""
    version = published(spark, path)
    return None if version is None else f"{path}/version={version}"


def append_papers(df: DataFrame, target: str, format: str = "parquet", **options) -> None:
    """Append canonical paper rows to a table: a path, or ``format='jdbc'`` options."""
    writer = df.write.mode("append").format(format).options(**options)
    if format == "jdbc":
        writer.option("dbtable", target).save()
    else:
        writer.save(target)


def append_to_table(df: DataFrame, table: str) -> None:
    """Append to a catalog table."""
    df.write.mode("append").saveAsTable(table)
