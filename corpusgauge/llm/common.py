"""Shared plumbing: table access and Arrow-batched Python stages.

Every Python stage here is a ``mapInArrow`` over the scan's own partitions: no
shuffle before it, column pruning reaches the Parquet reader, and a lost task is
simply recomputed from its split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and upstream chunks as (item_type, item_id, content)."""
    docs = table(spark, sf_dir, "scan_documents").select(
        F.lit("document").alias("item_type"), F.col("id").alias("item_id"), "content"
    )
    chunks = table(spark, sf_dir, "chunks").select(
        F.lit("chunk").alias("item_type"), F.col("id").alias("item_id"), "content"
    )
    return docs.unionByName(chunks)


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    schema: str,
    rows: int = 2000,
    mbytes: int = 16,
) -> DataFrame:
    """Apply ``make()`` (built once per task) to column dicts of at most ``rows`` rows.

    Fewer rows at a time where they are long, so that about ``mbytes`` of input are held as
    Python objects; every row is processed whole whatever its length.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            fit = max(1, min(rows, batch.num_rows * mbytes * 1_000_000 // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, fit):
                part = batch.slice(at, fit)
                out = step({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in out_schema], schema=out_schema
                )

    return df.mapInArrow(run, schema)
