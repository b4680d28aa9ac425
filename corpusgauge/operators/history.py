"""Scan history: saving, paging, comparison, change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(baseline: DataFrame, candidate: DataFrame, *, same_coverage: bool = True, compatible: bool = True) -> DataFrame:
    """(fingerprint, state): new, recurring, severity_changed, resolved or not_observed.

    A missing finding counts as resolved only where both scans covered the same; of
    incompatible scans nothing is compared.
    """
    b = baseline.groupBy("fingerprint").agg(F.max("severity").alias("before"))
    c = candidate.groupBy("fingerprint").agg(F.max("severity").alias("after"))
    both = b.join(c, "fingerprint", "full_outer")
    gone = "resolved" if same_coverage else "not_observed"
    state = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), gone).when(F.col("before") != F.col("after"), "severity_changed").otherwise("recurring")
    out = both.select("fingerprint", "before", "after", state.alias("state"))
    return out if compatible else out.where(F.lit(False))


def changes(old: DataFrame, new: DataFrame, key: str = "external_id", version: str = "version") -> DataFrame:
    """Added, modified and deleted items between two snapshots; unchanged ones are left out."""
    o = old.groupBy(key).agg(F.max(version).alias("previous_version"))
    n = new.groupBy(key).agg(F.max(version).alias("current_version"))
    kind = F.when(F.col("previous_version").isNull(), "added").when(F.col("current_version").isNull(), "deleted").otherwise("modified")
    differs = ~F.col("previous_version").eqNullSafe(F.col("current_version"))
    return o.join(n, key, "full_outer").where(differs).select(key, kind.alias("change"), "previous_version", "current_version")


def save(existing: DataFrame, incoming: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Rows of ``incoming`` that history lacks, each key once (insert, do nothing on conflict)."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def page(scans: DataFrame, *, after=None, before=None, source: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """History newest first."""
    if not (1 <= limit <= 200 and offset >= 0):
        raise ValueError("limit must be 1 to 200 and offset 0 or more")
    out = scans
    if after is not None:
        out = out.where(F.col("created_at") >= F.lit(after))
    if before is not None:
        out = out.where(F.col("created_at") <= F.lit(before))
    if source is not None:
        out = out.where(F.col("source_id") == source)
    return out.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)


def next_display_id(ids: DataFrame, column: str = "display_id", prefix: str = "SCAN") -> DataFrame:
    """The next sequence id: largest number so far plus one."""
    n = F.coalesce(F.max(F.regexp_extract(column, "([0-9]+)$", 1).try_cast("bigint")), F.lit(0)) + 1
    return ids.agg(F.concat(F.lit(f"{prefix}-"), F.lpad(n.cast("string"), 4, "0")).alias("next_id"))


def score_deltas(before: DataFrame, after: DataFrame, key: str, score: str) -> DataFrame:
    a = before.select(key, F.col(score).alias("before"))
    b = after.select(key, F.col(score).alias("after"))
    return a.join(b, key, "full_outer").select(key, "before", "after", F.round(F.col("after") - F.col("before"), 6).alias("delta"))
