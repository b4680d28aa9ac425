"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reached, for every node of an edge.

    Each round replaces the edges by large-star and small-star edges, so the rounds
    grow with the logarithm of a component's size, not its diameter, and no node
    gathers its component in one task. Lineage is cut by checkpoint() into the shared folder.
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    current = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct().checkpoint()
    previous = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        smallest = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        current = small.unionByName(smallest.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if previous == (state.n, state.s):
            break
        previous = (state.n, state.s)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
