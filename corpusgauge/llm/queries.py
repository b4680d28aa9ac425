"""Queries of the training-data operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import languages, leakage, lookalikes, markup, near_duplicates, personal, sentences, splitting, templates, tokenization
from .common import corpus_items, table


def _items_with_headings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "scan_documents").select(
        F.lit("document").alias("item_type"), F.col("id").alias("item_id"), "content",
        F.lit(None).cast("array<string>").alias("headings"),
    )
    chunks = table(spark, d, "chunks").select(F.lit("chunk").alias("item_type"), F.col("id").alias("item_id"), "content", "headings")
    return docs.unionByName(chunks)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(corpus_items(spark, d)).select("item_type", "item_id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_items_with_headings(spark, d)).dropDuplicates(["item_type", "item_id", "piece"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find_personal(corpus_items(spark, d))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redact(corpus_items(spark, d)).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_visible_text(table(spark, d, "scan_documents"))


def p3_normalized(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.normalize(table(spark, d, "scan_documents")).select("document_id", "normalized_content").distinct()


def _language_model(spark: SparkSession, d: str) -> languages.Model:
    return languages.fit(table(spark, d, "documents"), "doc_id", "text", "lang")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.mislabelled(table(spark, d, "scan_documents"), _language_model(spark, d))


def p4_languages(spark: SparkSession, d: str) -> DataFrame:
    return languages.document_languages(table(spark, d, "scan_documents"), _language_model(spark, d)).drop("label_code", "fits").distinct()


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.document_segments(table(spark, d, "scan_documents"), _language_model(spark, d)).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similar_chunks(table(spark, d, "chunks")).select("chunk_id_a", "chunk_id_b")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(table(spark, d, "chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.found_markup(table(spark, d, "scan_documents"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.cleaned(table(spark, d, "scan_documents")).distinct()


def p6_templates(spark: SparkSession, d: str) -> DataFrame:
    return templates.templates(table(spark, d, "scan_documents"))


def p6_slots(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "scan_documents")
    return templates.slots(docs, templates.templates(docs))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenization.encode(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents")).select("doc_id", "sent_end").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
