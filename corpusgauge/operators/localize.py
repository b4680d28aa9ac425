"""Rule and coverage texts by language, with English as the fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TITLES = {
    "STATIC-PI-001": ("Instruction that overrides earlier ones", "Önceki talimatları geçersiz kılan ifade"),
    "STATIC-SP-001": ("Request for hidden instructions", "Gizli talimatları isteyen ifade"),
    "STATIC-RP-001": ("Attempt to suppress other sources", "Diğer kaynakları bastırma girişimi"),
    "STATIC-TA-001": ("Instruction to use a tool", "Araç kullandırma talimatı"),
    "STATIC-CMD-001": ("Instruction to run a command", "Komut çalıştırma talimatı"),
    "STATIC-META-001": ("Instruction inside metadata", "Üst veride talimat"),
    "STATIC-HID-001": ("Hidden content", "Gizli içerik"),
    "STATIC-ENC-001": ("Encoded instruction", "Kodlanmış talimat"),
    "STATIC-URL-001": ("Suspicious link", "Şüpheli bağlantı"),
    "STATIC-PII-001": ("Possible personal data", "Olası kişisel veri"),
    "STATIC-SEC-001": ("Possible secret", "Olası gizli anahtar"),
}
REASONS = {"no chunks": "parça yok", "single document": "tek belge", "": ""}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def rule_title(rule_id: Column, language: Column, fallback: Column) -> Column:
    """Title in tr or en; the fallback for unknown rules."""
    en = _lookup(rule_id, {k: v[0] for k, v in TITLES.items()})
    tr = _lookup(rule_id, {k: v[1] for k, v in TITLES.items()})
    return F.coalesce(F.when(F.lower(language).startswith("tr"), tr), en, fallback)


def coverage_reason(reason: Column, language: Column) -> Column:
    return F.coalesce(F.when(F.lower(language).startswith("tr"), _lookup(reason, REASONS)), reason)


def localized(findings: DataFrame, language: str) -> DataFrame:
    return findings.withColumn("title", rule_title(F.col("rule_id"), F.lit(language), F.col("rule_id")))
