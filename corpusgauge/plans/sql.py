"""Fragments the SQL of several queries shares."""

from ..functions import patterns as P

DOCS = "docs AS (SELECT * FROM scan_documents QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, content_hash) = 1)"
CHUNKS = "chs AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY document_id, \"index\", content) = 1)"
RANKS = "CASE {0} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
FINDINGS = """fnd AS (
    SELECT * REPLACE (
        CASE WHEN lower(trim(severity)) IN ('critical','high','medium','low','info') THEN lower(trim(severity)) ELSE 'info' END AS severity,
        greatest(0.0, least(1.0, coalesce(confidence, 0.0))) AS confidence)
    FROM scan_findings QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_seen DESC NULLS LAST, fingerprint, confidence DESC NULLS LAST) = 1)"""
JOBS = "jbs AS (SELECT * FROM scan_jobs QUALIFY row_number() OVER (PARTITION BY id ORDER BY available_at DESC NULLS LAST, status, attempt_count DESC NULLS LAST, progress DESC NULLS LAST) = 1)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(c: str) -> str:
    return f"regexp_extract_all({c}, {lit(P.TOKEN)})"


def token_count(c: str) -> str:
    return f"CAST(len({tokens(c)}) AS BIGINT)"


def fold(c: str) -> str:
    # İ folds to two characters, as the JVM does
    return f"replace(lower(replace({c}, 'İ', 'i' || chr(775))), 'ß', 'ss')"


def words(c: str) -> str:
    return f"regexp_extract_all({fold(c)}, {lit(P.WORD)})"


def shingles(c: str, k: int = 5) -> str:
    w = words(c)
    return (
        f"list_distinct(CASE WHEN len({w}) >= {k} THEN list_transform(range(1, len({w}) - {k - 2}), lambda i: array_to_string(list_slice({w}, i, i + {k - 1}), ' ')) "
        f"WHEN len({w}) > 0 THEN [array_to_string({w}, ' ')] ELSE [] END)"
    )


def lines(c: str) -> str:
    return f"string_split(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), chr(10))"


def count_of(c: str, literal: str) -> str:
    return f"CAST((length({c}) - length(replace({c}, {lit(literal)}, ''))) / {len(literal)} AS BIGINT)"


def instances(values: tuple[str, ...]) -> str:
    return ", ".join(lit(v) for v in values)


def masked(c: str) -> str:
    out = c
    for pattern, mark in P.MASKS:
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(mark)}, 'g')"
    return out
