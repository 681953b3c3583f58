"""Run registered queries beside their SQL: python -m workload.check [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

from workload.catalog import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, float) and not math.isnan(value):
            return ("float", f"{value:.9g}")
        return (type(value).__name__, str(value))

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, name: str, sf_dir: str, connection) -> str:
    """Empty text if Spark and SQL agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        return "" if ours else "no rows"
    cursor = connection.cursor()
    answer = cursor.execute(ORACLES[name])
    columns = [column[0] for column in answer.description]
    theirs = rows_of(columns, answer.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if ours != theirs:
        only_ours = [row for row in ours if row not in set(theirs)][:2]
        only_theirs = [row for row in theirs if row not in set(ours)][:2]
        return f"{len(ours)} rows != {len(theirs)}: {only_ours} / {only_theirs}"[:1500]
    return "" if ours else "equal, but empty"


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, connection = session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        started = time.time()
        try:
            problem = compare(spark, name, sf_dir, connection)
        except Exception as error:
            problem = "".join(traceback.format_exception_only(error))[:1500]
        bad += bool(problem)
        print(f"{'BAD' if problem else 'ok '} {name:32} {time.time() - started:6.2f}s {problem}", flush=True)
    print(f"{bad} bad of {len(sys.argv[2:] or QUERIES)}")


if __name__ == "__main__":
    main()
