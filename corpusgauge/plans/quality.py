"""Chunk quality, scores, advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import advice, duplicates, quality, scoring
from ..operators.base import chunks, documents, findings
from . import sql as S
from .similarity import SQL as SIMILARITY
from .similarity import dup_stats


def chunk_positions(spark: SparkSession, d: str) -> DataFrame:
    return quality.positions(chunks(spark, d)).select("id", F.col("position").cast("bigint").alias("position"), F.col("document_chunks").alias("document_chunks"), F.col("run_position").cast("bigint").alias("run_position"))


def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    return quality.overlaps(chunks(spark, d)).select("id", "previous_id", "overlap_words", "overlap_ratio", "word_jaccard")


def chunk_quality_issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.issues(quality.assessed(chunks(spark, d)))


def chunk_quality_scores(spark: SparkSession, d: str) -> DataFrame:
    return quality.scores(quality.assessed(chunks(spark, d))).select("id", *P.DIMENSIONS, "overall")


def chunk_quality_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(quality.assessed(chunks(spark, d)))


def document_medians(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("document_id", T.token_count("content").alias("n")).groupBy("document_id").agg(F.median("n").alias("median_tokens"))


def line_repetition(spark: SparkSession, d: str) -> DataFrame:
    rows = F.filter(F.transform(T.lines("content"), lambda x: F.trim(x)), lambda x: x != "")
    return chunks(spark, d).select("id", rows.alias("rows")).where("size(rows) >= 3").select("id", F.round(quality.most_frequent_share(F.col("rows")), 6).alias("share"))


def lexical_density(spark: SparkSession, d: str) -> DataFrame:
    w = chunks(spark, d).select("id", T.words("content").alias("w")).where("size(w) >= 20")
    return w.select("id", F.round(F.size(F.array_distinct("w")) / F.size("w"), 6).alias("density"), F.round(quality.most_frequent_share(F.col("w")), 6).alias("top_share"))


def excessive_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.excessive_counts(documents(spark, d), chunks(spark, d), 2.0)


def stale_counts(spark: SparkSession, d: str) -> DataFrame:
    """Stored token and character counts against the text."""
    actual = T.token_count("content")
    return chunks(spark, d).where(~F.col("token_count").eqNullSafe(actual.cast("int")) | ~F.col("character_count").eqNullSafe(F.length("content"))).select(
        "id", F.col("token_count").alias("stored_tokens"), actual.alias("actual_tokens"), F.col("character_count").alias("stored_chars"), F.length("content").cast("bigint").alias("actual_chars")
    )


def knowledge_score(spark: SparkSession, d: str) -> DataFrame:
    return scoring.knowledge_score(quality.scores(quality.assessed(chunks(spark, d))))


def efficiency_score(spark: SparkSession, d: str) -> DataFrame:
    return scoring.efficiency_score(dup_stats(spark, d))


def security_score(spark: SparkSession, d: str) -> DataFrame:
    return scoring.security_score(findings(spark, d))


def document_security(spark: SparkSession, d: str) -> DataFrame:
    return scoring.security_score(findings(spark, d).where("document_id is not null"), ["document_id"])


def overall_score(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    one = scoring.security_score(f).select("security").crossJoin(knowledge_score(spark, d)).crossJoin(efficiency_score(spark, d)).crossJoin(f.agg(F.max((F.col("severity") == "critical").cast("int")).alias("critical")))
    out = scoring.overall(one, F.col("critical") == 1)
    return out.select("security", "knowledge", "efficiency", "overall", "cap_applied", "coverage_ratio", T.score_band("overall").alias("band"))


def chunk_size_advice(spark: SparkSession, d: str) -> DataFrame:
    own = chunks(spark, d)
    return advice.advise(quality.statistics(quality.assessed(own)), advice.structure(own))


def heading_only_chunks(spark: SparkSession, d: str) -> DataFrame:
    bare = F.trim(F.regexp_replace("content", "[ \t\r\n]+", " "))
    return chunks(spark, d).where(F.exists(F.coalesce("headings", F.array().cast("array<string>")), lambda h: h == bare)).select("id")


_W = "w AS (SELECT id, document_id, \"index\", content FROM chs)"
_POS = """flags AS (SELECT id, document_id, "index", coalesce(metadata.forced_split, false) AS forced, concat(CAST(coalesce(metadata.forced_split, false) AS INT), CAST(coalesce(metadata.table_present, false) AS INT), CAST(coalesce(metadata.code_block_present, false) AS INT), CAST(coalesce(metadata.list_present, false) AS INT)) AS sig FROM chs),
    beg AS (SELECT *, CASE WHEN forced AND coalesce(lag(forced) OVER o AND lag(sig) OVER o = sig, false) THEN 0 ELSE 1 END AS b FROM flags WINDOW o AS (PARTITION BY document_id ORDER BY "index", id)),
    runs AS (SELECT *, sum(b) OVER (PARTITION BY document_id ORDER BY "index", id) AS run FROM beg),
    pos AS (SELECT id, document_id, "index", forced, row_number() OVER (PARTITION BY document_id ORDER BY "index", id) - 1 AS position, count(*) OVER (PARTITION BY document_id) AS document_chunks, row_number() OVER (PARTITION BY document_id, run ORDER BY "index", id) - 1 AS run_position FROM runs)"""
_OVER = f"""ow AS (SELECT document_id, "index", id, coalesce(metadata.generated, false) AS gen, {S.words('content')} AS cur FROM chs),
    op AS (SELECT document_id, id, cur, lag(cur) OVER o AS prev, gen AND lag(gen) OVER o AS both_generated, lag(id) OVER o AS previous_id FROM ow WINDOW o AS (PARTITION BY document_id ORDER BY "index", id)),
    ov AS (SELECT id, previous_id, CAST(coalesce(list_max(list_filter(range(1, least(len(prev), len(cur)) + 1), lambda k: list_slice(prev, len(prev) - k + 1, len(prev)) = list_slice(cur, 1, k))), 0) AS BIGINT) AS overlap_words, cur, prev, both_generated FROM op WHERE previous_id IS NOT NULL),
    ovl AS (SELECT id, previous_id, both_generated, overlap_words, round(CASE WHEN len(cur) > 0 THEN overlap_words * 1.0 / len(cur) ELSE 0 END, 6) AS overlap_ratio,
        round(CASE WHEN len(list_distinct(list_concat(prev, cur))) > 0 THEN len(list_intersect(list_distinct(prev), list_distinct(cur))) * 1.0 / len(list_distinct(list_concat(prev, cur))) ELSE 0 END, 6) AS word_jaccard FROM ov)"""


def _top_share(c: str) -> str:
    return f"(CASE WHEN len({c}) > 0 THEN list_max(map_values(histo)) * 1.0 / len({c}) ELSE 0 END)"


_ROWS = f"list_filter(list_transform({S.lines('content')}, lambda x: trim(x, ' ')), lambda x: x <> '')"
_MEAS = f"""m0 AS (SELECT c.id, c.document_id, p.position, p.document_chunks, p.run_position, p.forced, coalesce(c.metadata.generated, false) AS generated, coalesce(c.metadata.table_present, false) AS has_table, coalesce(c.metadata.code_block_present, false) AS has_code,
        coalesce(c.metadata.list_present, false) AS has_list, trim(content, ' ') AS bare, length(content) AS chars, {S.token_count('content')} AS tokens, {S.words('content')} AS words, {_ROWS} AS rws,
        len(regexp_extract_all(content, {S.lit(quality.CONTROL)})) AS markers, length(regexp_replace(content, '[\\x{{00}}-\\x{{08}}\\x{{0b}}-\\x{{1f}}\\x{{7f}}-\\x{{9f}}\\x{{200b}}-\\x{{200f}}\\x{{2028}}-\\x{{202e}}\\x{{2060}}-\\x{{206f}}\\x{{feff}}]', '', 'g')) AS printable,
        {S.count_of('content', '�')} + {S.count_of('content', '<REPLACEMENT>')} AS replacements FROM chs c JOIN pos p ON c.id = p.id),
    meds AS (SELECT document_id, median(tokens) AS median_tokens FROM m0 GROUP BY 1),
    rtop AS (SELECT id, max(n) * 1.0 / sum(n) AS rshare FROM (SELECT id, x, count(*) AS n FROM (SELECT id, unnest(rws) AS x FROM m0) GROUP BY ALL) GROUP BY id),
    wtop AS (SELECT id, max(n) * 1.0 / sum(n) AS wshare, count(*) * 1.0 / sum(n) AS density FROM (SELECT id, x, count(*) AS n FROM (SELECT id, unnest(words) AS x FROM m0) GROUP BY ALL) GROUP BY id),
    m AS (SELECT m0.*, median_tokens, coalesce(rshare, 0) AS rshare, coalesce(wshare, 0) AS wshare, coalesce(density, 0) AS density, overlap_ratio, word_jaccard, both_generated, bare <> '' AS go, regexp_matches(bare, '^[0-9][0-9 .,/-]*$') AS numeric,
        len(words) >= 20 AS enough, coalesce(list_sum(list_transform(list_filter(rws, lambda x: regexp_matches(lower(x), {S.lit(quality.PAGE_NUMBER)})), lambda x: length(x))), 0) >= 0.6 * greatest(length(bare), 1) AS boiler
        FROM m0 JOIN meds USING (document_id) LEFT JOIN rtop USING (id) LEFT JOIN wtop USING (id) LEFT JOIN ovl USING (id)),
    m2 AS (SELECT *, enough AND len(rws) >= 3 AND rshare >= 0.6 AS repeated, forced AND run_position = 0 AS ff FROM m),
    m3 AS (SELECT *, enough AND NOT has_code AND NOT has_table AND NOT repeated AND NOT boiler AS lexical, go AND NOT numeric AS con, NOT generated AS up FROM m2)"""
_RULES = (
    ("empty_chunk", "high", "content", "NOT go"),
    ("oversized_chunk", "medium", "size", "go AND tokens > 500"),
    ("undersized_chunk", "low", "size", "go AND up AND document_chunks > 1 AND tokens < 50"),
    ("extreme_size_outlier", "low", "size", "go AND up AND document_chunks > 1 AND tokens > 3 * median_tokens"),
    ("near_character_limit", "low", "size", "go AND up AND chars >= 90000"),
    ("table_split", "medium", "structure", "go AND ff AND has_table"),
    ("code_block_split", "medium", "structure", "go AND ff AND NOT has_table AND has_code"),
    ("list_split", "medium", "structure", "go AND ff AND NOT has_table AND NOT has_code AND has_list"),
    ("forced_split", "medium", "structure", "go AND ff AND NOT has_table AND NOT has_code AND NOT has_list"),
    ("middle_sentence_start", "low", "structure", "go AND lower(bare[1]) = bare[1] AND upper(bare[1]) <> bare[1] AND CASE WHEN up THEN position > 0 ELSE forced AND run_position = 1 END"),
    ("middle_sentence_end", "low", "structure", "go AND regexp_matches(bare[-1], '[\\p{L}\\p{N}]') AND CASE WHEN up THEN position < document_chunks - 1 ELSE ff END"),
    ("punctuation_only_chunk", "medium", "content", "go AND NOT regexp_matches(bare, '[\\p{L}\\p{N}]')"),
    ("numeric_only", "low", "content", "go AND numeric AND (up OR forced)"),
    ("repeated_line_chunk", "low", "content", "con AND repeated"),
    ("boilerplate_dominated_chunk", "low", "content", "con AND boiler"),
    ("low_printable_ratio", "medium", "extraction", "con AND printable < 0.85 * greatest(chars, 1)"),
    ("excessive_control_markers", "medium", "extraction", "con AND markers > 0.05 * greatest(tokens, 1)"),
    ("highly_repetitive_tokens", "low", "content", "con AND lexical AND wshare >= 0.55"),
    ("low_information_density", "low", "content", "con AND lexical AND wshare < 0.55 AND density < 0.25"),
    ("garbled_extraction", "medium", "extraction", "con AND (replacements >= 3 OR replacements > 0.02 * greatest(chars, 1))"),
    ("excessive_overlap", "medium", "overlap", "NOT both_generated AND overlap_ratio >= 0.4"),
    ("near_identical_neighbor_chunks", "low", "overlap", "NOT both_generated AND NOT coalesce(overlap_ratio >= 0.4, false) AND word_jaccard >= 0.9"),
)
_ALL = f"{S.CHUNKS}, {_POS}, {_OVER}, {_MEAS}, iss AS (" + " UNION ALL ".join(f"SELECT id, '{n}' AS issue, '{s}' AS severity, '{dim}' AS dimension FROM m3 WHERE {w}" for n, s, dim, w in _RULES) + ")"
_PEN = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.ISSUE_PENALTY.items()) + " END"
_SCORES = (
    "sco AS (SELECT c.id, c.document_id, "
    + ", ".join(f"greatest(0.0, 100.0 - coalesce(sum({_PEN}) FILTER (WHERE dimension = '{x}'), 0)) AS {x}" for x in P.DIMENSIONS)
    + " FROM chs c LEFT JOIN iss i ON c.id = i.id GROUP BY ALL), scr AS (SELECT *, round(("
    + " + ".join(P.DIMENSIONS)
    + f") / {len(P.DIMENSIONS)}, 6) AS overall FROM sco)"
)
_KNOW = "SELECT round(sum(overall * greatest(tokens, 1)) / sum(greatest(tokens, 1)), 6) AS knowledge FROM scr JOIN m0 USING (id)"
_STATS = """st AS (SELECT (SELECT count(*) FROM chs) AS chunks, count(DISTINCT id) FILTER (WHERE issue = 'oversized_chunk') AS oversized, count(DISTINCT id) FILTER (WHERE issue = 'undersized_chunk') AS undersized, count(DISTINCT id) FILTER (WHERE issue = 'empty_chunk') AS empty,
    count(DISTINCT id) FILTER (WHERE dimension = 'structure') AS broken, (SELECT round(avg(tokens), 6) FROM m0) AS mean_tokens, (SELECT median(tokens) FROM m0) AS median_tokens FROM iss)"""
_SEC = "round(greatest(0.0, 100.0 - coalesce(sum((CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.SEVERITY_PENALTY.items()) + " END) * confidence), 0.0)), 6)"
_PROFILES = " UNION ALL ".join(f"SELECT '{n}' AS profile, {a} AS minimum, {b} AS target, {c} AS maximum" for n, (a, b, c, _, _) in advice.PROFILES.items())
_ACTIONS = (
    ("increase_chunk_size", "median_tokens > 0 AND median_tokens < minimum"), ("decrease_chunk_size", "median_tokens > maximum"), ("split_oversized_chunks", "oversized > 0"),
    ("merge_small_chunks", "undersized > greatest(1, floor(k.chunks / 4))"), ("repair_broken_boundaries", "broken > 0"), ("keep_tables_whole", "table_chunks > 0 AND profile IN ('table_analytics', 'general_qa')"),
    ("keep_code_whole", "code_chunks > 0 AND profile = 'code_assistant'"),
)

QUERIES = {f.__name__: f for f in (
    chunk_positions, chunk_overlap, chunk_quality_issues, chunk_quality_scores, chunk_quality_stats, document_medians, line_repetition, lexical_density, excessive_chunk_counts, stale_counts, knowledge_score, efficiency_score,
    security_score, document_security, overall_score, chunk_size_advice, heading_only_chunks,
)}

SQL = {
    "chunk_positions": f"WITH {S.CHUNKS}, {_POS} SELECT id, position, document_chunks, run_position FROM pos",
    "chunk_overlap": f"WITH {S.CHUNKS}, {_OVER} SELECT id, previous_id, overlap_words, overlap_ratio, word_jaccard FROM ovl",
    "chunk_quality_issues": f"WITH {_ALL} SELECT * FROM iss",
    "chunk_quality_scores": f"WITH {_ALL}, {_SCORES} SELECT id, {', '.join(P.DIMENSIONS)}, overall FROM scr",
    "chunk_quality_stats": f"WITH {_ALL}, {_STATS} SELECT * FROM st",
    "document_medians": f"WITH {S.CHUNKS} SELECT document_id, median({S.token_count('content')}) AS median_tokens FROM chs GROUP BY 1",
    "line_repetition": f"WITH {S.CHUNKS}, r AS (SELECT id, {_ROWS} AS rws FROM chs), n AS (SELECT id, x, count(*) AS n FROM (SELECT id, unnest(rws) AS x FROM r WHERE len(rws) >= 3) GROUP BY ALL) SELECT id, round(max(n) * 1.0 / sum(n), 6) AS share FROM n GROUP BY id",
    "lexical_density": f"WITH {S.CHUNKS}, r AS (SELECT id, {S.words('content')} AS w FROM chs), n AS (SELECT id, x, count(*) AS n FROM (SELECT id, unnest(w) AS x FROM r WHERE len(w) >= 20) GROUP BY ALL) SELECT id, round(count(*) * 1.0 / sum(n), 6) AS density, round(max(n) * 1.0 / sum(n), 6) AS top_share FROM n GROUP BY id",
    "excessive_chunk_counts": f"WITH {S.DOCS}, {S.CHUNKS}, n AS (SELECT document_id, count(*) AS chunks FROM chs WHERE NOT coalesce(metadata.generated, false) GROUP BY 1) SELECT document_id, chunks, round(chunks * 1000.0 / greatest(length(content), 1), 6) AS per_thousand FROM n JOIN docs ON id = document_id WHERE chunks * 1000.0 / greatest(length(content), 1) > 2.0",
    "stale_counts": f"WITH {S.CHUNKS} SELECT id, token_count AS stored_tokens, {S.token_count('content')} AS actual_tokens, character_count AS stored_chars, length(content) AS actual_chars FROM chs WHERE token_count IS DISTINCT FROM {S.token_count('content')} OR character_count IS DISTINCT FROM length(content)",
    "knowledge_score": f"WITH {_ALL}, {_SCORES} {_KNOW}",
    "efficiency_score": f"SELECT round(greatest(0.0, 100.0 - redundant_percent), 6) AS efficiency FROM ({SIMILARITY['dup_stats']})",
    "security_score": f"WITH {S.FINDINGS} SELECT count(*) AS findings, {_SEC} AS security FROM fnd",
    "document_security": f"WITH {S.FINDINGS} SELECT document_id, count(*) AS findings, {_SEC} AS security FROM fnd WHERE document_id IS NOT NULL GROUP BY 1",
    "overall_score": f"""WITH {_ALL}, {_SCORES}, {S.FINDINGS}, k AS ({_KNOW}), e AS (SELECT round(greatest(0.0, 100.0 - redundant_percent), 6) AS efficiency FROM ({SIMILARITY['dup_stats']})), s AS (SELECT {_SEC} AS security, max(CAST(severity = 'critical' AS INT)) AS critical FROM fnd),
        r AS (SELECT security, knowledge, efficiency, critical, (security * 0.35 + knowledge * 0.2 + efficiency * 0.15) / 0.7 AS raw FROM k, e, s),
        o AS (SELECT security, knowledge, efficiency, round(CASE WHEN critical = 1 AND raw > 54.99 THEN 54.99 ELSE raw END, 6) AS overall, critical = 1 AND raw > 54.99 AS cap_applied, 1.0 AS coverage_ratio FROM r)
        SELECT *, CASE WHEN overall < 55 THEN 'critical' WHEN overall < 70 THEN 'poor' WHEN overall < 85 THEN 'warning' ELSE 'healthy' END AS band FROM o""",
    "chunk_size_advice": f"""WITH {_ALL}, {_STATS}, k AS (SELECT count(*) AS chunks, count(*) FILTER (WHERE metadata.table_present) AS table_chunks, count(*) FILTER (WHERE metadata.code_block_present) AS code_chunks FROM chs), p AS ({_PROFILES}), a AS (SELECT * FROM p, st, k)
        """ + " UNION ALL ".join(f"SELECT profile, CAST(target AS BIGINT) AS target_tokens, '{n}' AS action FROM p, st, k WHERE {w}" for n, w in _ACTIONS),
    "heading_only_chunks": f"WITH {S.CHUNKS} SELECT id FROM chs c WHERE len(list_filter(coalesce(c.headings, []), lambda h: h = trim(regexp_replace(c.content, '[ \\t\\r\\n]+', ' ', 'g'), ' '))) > 0",
}
