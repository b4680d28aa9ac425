"""Scores, coverage, summaries, report assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions import text as T


def security_score(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """100 less the severity penalties times confidence, not under 0."""
    lost = F.sum(T.choose(F.col("severity"), P.SEVERITY_PENALTY) * F.col("confidence"))
    grouped = findings.groupBy(*by) if by else findings.groupBy()
    return grouped.agg(F.count("*").alias("findings"), F.round(F.greatest(F.lit(0.0), 100.0 - F.coalesce(lost, F.lit(0.0))), 6).alias("security"))


def knowledge_score(chunk_scores: DataFrame) -> DataFrame:
    """Token-weighted mean of chunk scores; null without chunks."""
    w = F.greatest(F.col("tokens"), F.lit(1))
    return chunk_scores.agg(F.round(F.try_divide(F.sum(F.col("overall") * w), F.sum(w)), 6).alias("knowledge"))


def efficiency_score(statistics: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """100 less the larger of the shares of exact and, where they were sought, near duplicates."""
    lost = F.col("redundant_percent")
    if near is not None:
        statistics, lost = statistics.crossJoin(near), F.greatest(lost, F.col("near_percent"))  # one row each
    return statistics.select(F.round(F.greatest(F.lit(0.0), 100.0 - lost), 6).alias("efficiency"))


def overall(scores: DataFrame, critical: Column | None = None) -> DataFrame:
    """Weights renormalised over the assessed dimensions; two are needed; capped under 55 by a critical finding.

    A null score means not assessed and is never read as 0.
    """
    names = list(P.WEIGHTS)
    weight = sum((F.when(F.col(n).isNotNull(), F.lit(P.WEIGHTS[n])).otherwise(0.0) for n in names), F.lit(0.0))
    total = sum((F.coalesce(F.col(n), F.lit(0.0)) * F.lit(P.WEIGHTS[n]) for n in names), F.lit(0.0))
    assessed = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    raw = F.when(assessed >= 2, total / weight)
    cap = F.coalesce(critical if critical is not None else F.lit(False), F.lit(False)) & (raw > 54.99)
    return scores.select("*", F.round(F.when(cap, 54.99).otherwise(raw), 6).alias("overall"), F.coalesce(cap, F.lit(False)).alias("cap_applied"), F.round(weight / sum(P.WEIGHTS.values()), 6).alias("coverage_ratio"))


def severity_histogram(findings: DataFrame, by: str) -> DataFrame:
    """Findings by severity, zero where none."""
    counts = [F.sum((F.col("severity") == s).cast("bigint")).alias(s) for s in P.SEVERITY_RANK]
    return findings.groupBy(by).agg(*counts)


def rank(severity: Column) -> Column:
    return T.choose(severity, P.SEVERITY_RANK)


def filtered(findings: DataFrame, *, min_severity: str = "info", include_info: bool = True, categories: tuple[str, ...] = (), rule_ids: tuple[str, ...] = (), document_ids: tuple[str, ...] = ()) -> DataFrame:
    keep = rank(F.col("severity")) >= P.SEVERITY_RANK[min_severity]
    if not include_info:
        keep = keep & (F.col("severity") != "info")
    for column, values in (("category", categories), ("rule_id", rule_ids), ("document_id", document_ids)):
        if values:
            keep = keep & F.col(column).isin(*values)
    return findings.where(keep)


def top_findings(findings: DataFrame, limit: int = 500) -> DataFrame:
    """The report's first findings: severity, confidence, category, rule, fingerprint, id."""
    return findings.orderBy(rank(F.col("severity")).desc(), F.col("confidence").desc(), "category", "rule_id", "fingerprint", "id").limit(limit)


def finding_groups(findings: DataFrame, groups: DataFrame) -> DataFrame:
    """Findings grouped by the duplicate group of their chunk, else by rule."""
    g = groups.select("chunk_id", "group_id").where("chunk_id is not null").groupBy("chunk_id").agg(F.min("group_id").alias("group_id"))
    keyed = findings.join(g, "chunk_id", "left").withColumn("group_key", F.coalesce("group_id", "rule_id"))
    return keyed.groupBy("group_key").agg(
        F.count("*").alias("findings"), F.countDistinct(F.coalesce("chunk_id", "id")).alias("affected"), F.max(rank(F.col("severity"))).cast("bigint").alias("top_rank"), F.min("rule_id").alias("first_rule")
    )


def model_context(groups: DataFrame, max_groups: int = 25, max_chars: int = 18_000) -> DataFrame:
    """The groups a bounded summary may quote: by severity, affected, key, within a running size."""
    order = [F.col("top_rank").desc(), F.col("affected").desc(), F.col("group_key")]
    first = groups.orderBy(*order).limit(max_groups)  # a bounded top list, so one-task windows below see few rows
    w = Window.orderBy(*order)
    size = F.length(F.concat_ws("|", "group_key", "first_rule", F.col("affected").cast("string")))
    out = first.withColumn("place", F.row_number().over(w)).withColumn("chars_so_far", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where(F.col("chars_so_far") <= max_chars)


def unsafe_sources(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """Sources with any finding (semi join)."""
    d = documents.select(F.col("id").alias("document_id"), F.col("source.source_id").alias("source_id"))
    return d.join(findings.select("document_id"), "document_id", "left_semi").select("source_id").where("source_id is not null").distinct()


def duplicate_summary(groups: DataFrame) -> DataFrame:
    c = F.col("category")
    return groups.agg(
        F.sum((c == "exact_duplicate_document").cast("bigint")).alias("exact_documents"), F.sum((c == "exact_duplicate_chunk").cast("bigint")).alias("exact_chunks"),
        F.sum(c.contains("near_duplicate").cast("bigint")).alias("near"), F.sum(F.coalesce("estimated_redundant_characters", F.lit(0))).cast("bigint").alias("redundant_chars"),
    )


def scan_status(cancelled: Column, fatal: Column, documents: Column, warnings: Column) -> Column:
    return F.when(cancelled, "cancelled").when(fatal | (documents == 0), "failed").when(warnings > 0, "completed_with_warnings").otherwise("completed")


def coverage(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_id, area, status, reason): what could be assessed of each source."""
    d = documents.groupBy(F.col("source.source_id").alias("source_id")).agg(F.count("*").alias("documents"))
    k = chunks.groupBy(F.col("source.source_id").alias("source_id")).agg(F.count("*").alias("chunks"))
    one = d.join(k, "source_id", "left").select("source_id", "documents", F.coalesce("chunks", F.lit(0)).alias("chunks")).where("source_id is not null")
    areas = F.array(
        F.struct(F.lit("security").alias("area"), F.lit("assessed").alias("status"), F.lit("").alias("reason")),
        F.struct(F.lit("exact_duplicates").alias("area"), F.when(F.col("documents") > 1, "assessed").otherwise("partial").alias("status"), F.when(F.col("documents") > 1, "").otherwise("single document").alias("reason")),
        F.struct(F.lit("chunk_quality").alias("area"), F.when(F.col("chunks") > 0, "assessed").otherwise("not_assessed").alias("status"), F.when(F.col("chunks") > 0, "").otherwise("no chunks").alias("reason")),
    )
    return one.select("source_id", F.explode(areas).alias("a")).select("source_id", "a.area", "a.status", "a.reason")


def language_vote(documents: DataFrame) -> DataFrame:
    """(id, vote): stop words of five languages, Chinese by its characters, en as the fallback."""
    w = T.words("content")
    han = F.length("content") - F.length(F.regexp_replace("content", "[一-鿿]", ""))

    def hits(stop: tuple[str, ...]) -> Column:
        return F.size(F.filter(w, lambda x: x.isin(*stop)))

    counts = [F.struct(hits(stop).alias("n"), F.lit(code).alias("language")) for code, stop in sorted(P.STOP_WORDS.items())]
    ordered = F.array_sort(F.array(*counts), lambda a, b: F.when(a.n > b.n, -1).when(a.n < b.n, 1).when(a.language < b.language, -1).otherwise(1))
    best, second = F.element_at(ordered, 1), F.element_at(ordered, 2)
    vote = F.when(han >= 20, "zh-CN").when((best.n >= 6) & (best.n >= second.n + 2), best.language).otherwise("en")
    return documents.select("id", vote.alias("vote"))


def report_json(summary: DataFrame) -> DataFrame:
    """One canonical JSON a row, keys in order."""
    return summary.select(F.to_json(F.struct(*sorted(summary.columns))).alias("report"))


def grouped_messages(documents: DataFrame, limit: int = 50) -> DataFrame:
    """Distinct warnings in order, bounded, with their document count."""
    return documents.select("id", F.explode("warnings").alias("message")).groupBy("message").agg(F.countDistinct("id").alias("documents")).orderBy("message").limit(limit)


def issues_of(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ingestion issues: hash mismatches, then documents left without text, then orphan chunks; one an item."""
    bad = documents.where(F.sha2("content", 256) != F.coalesce("content_hash", F.lit(""))).select(F.col("id").alias("item"), F.lit("hash_mismatch").alias("issue"))
    empty = documents.where(F.coalesce(F.trim("content"), F.lit("")) == "").select(F.col("id").alias("item"), F.lit("empty_document").alias("issue"))
    orphan = chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti").select(F.col("id").alias("item"), F.lit("orphan_chunk").alias("issue"))
    later = empty.unionByName(orphan)
    return bad.unionByName(later.join(bad.select("item"), "item", "left_anti"))
