"""Registered queries of this package, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_ROOT = str(Path(__file__).resolve().parents[2])


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function, with its SQL if there is one."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package by name."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
