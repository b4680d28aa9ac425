"""Canonical views of the scan tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the first in ``order`` (a stable choice among repeated rows)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned documents, the latest ingestion of each id."""
    return first_rows(table(spark, sf_dir, "scan_documents"), ["id"], [F.col("ingested_at").desc_nulls_last(), F.col("content_hash")])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upstream chunks, each id once."""
    return first_rows(table(spark, sf_dir, "chunks"), ["id"], [F.col("document_id"), F.col("index"), F.col("content")])


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings, each id once, with severity and confidence put right."""
    from ..functions import text as T

    one = first_rows(table(spark, sf_dir, "scan_findings"), ["id"], [F.col("last_seen").desc_nulls_last(), F.col("fingerprint"), F.col("confidence").desc_nulls_last()])
    return one.withColumn("severity", T.severity("severity")).withColumn("confidence", T.confidence("confidence"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_rows(
        table(spark, sf_dir, "scan_jobs"), ["id"], [F.col("available_at").desc_nulls_last(), F.col("status"), F.col("attempt_count").desc_nulls_last(), F.col("progress").desc_nulls_last()]
    )
