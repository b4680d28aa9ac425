"""Chunking advice for a workload profile from observed statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Minimum, target and maximum tokens, overlap, results to retrieve.
PROFILES = {
    "fact_lookup": (40, 128, 256, 12, 5),
    "general_qa": (50, 300, 500, 30, 5),
    "policy_procedure": (80, 450, 700, 45, 6),
    "long_context_research": (120, 700, 1024, 70, 8),
    "code_assistant": (80, 600, 1000, 60, 6),
    "table_analytics": (80, 500, 800, 0, 5),
}


def advise(statistics: DataFrame, structure: DataFrame) -> DataFrame:
    """(profile, target_tokens, action), one row an action; both inputs have one row.

    statistics: quality statistics; structure: (chunks, table_chunks, code_chunks).
    """
    profiles = F.array(*(F.struct(F.lit(n).alias("profile"), *(F.lit(v).alias(k) for k, v in zip(("minimum", "target", "maximum", "overlap", "top_k"), values))) for n, values in PROFILES.items()))
    one = statistics.select("median_tokens", "oversized", "undersized", "broken").crossJoin(structure)
    each = one.select("*", F.explode(profiles).alias("p"))
    action = lambda text, when: F.when(F.coalesce(when, F.lit(False)), F.lit(text))
    actions = F.array_compact(F.array(
        action("increase_chunk_size", (F.col("median_tokens") > 0) & (F.col("median_tokens") < F.col("p.minimum"))),
        action("decrease_chunk_size", F.col("median_tokens") > F.col("p.maximum")),
        action("split_oversized_chunks", F.col("oversized") > 0),
        action("merge_small_chunks", F.col("undersized") > F.greatest(F.lit(1), F.floor(F.col("chunks") / 4))),
        action("repair_broken_boundaries", F.col("broken") > 0),
        action("keep_tables_whole", (F.col("table_chunks") > 0) & F.col("p.profile").isin("table_analytics", "general_qa")),
        action("keep_code_whole", (F.col("code_chunks") > 0) & (F.col("p.profile") == "code_assistant")),
    ))
    return each.select(F.col("p.profile").alias("profile"), F.col("p.target").cast("bigint").alias("target_tokens"), F.explode(actions).alias("action"))


def structure(chunks: DataFrame) -> DataFrame:
    flag = lambda n: F.sum(F.coalesce(F.col(f"metadata.{n}"), F.lit(False)).cast("bigint"))
    return chunks.agg(F.count("*").alias("chunks"), flag("table_present").alias("table_chunks"), flag("code_block_present").alias("code_chunks"))
