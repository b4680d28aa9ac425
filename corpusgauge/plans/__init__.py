"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus, quality, records, security, similarity

_PARTS = (corpus, similarity, quality, security, records)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.QUERIES["exact_dup_docs"](spark, sf_dir)
