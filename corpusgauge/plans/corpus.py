"""Corpus shape: statistics, normalization, structure, chunking, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import chunking, normalize, scoring
from ..operators.base import chunks, documents, table
from ..sources import files
from . import sql as S


def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(
        "id", F.length("content").cast("bigint").alias("chars"), T.token_count("content").alias("tokens"), F.size(T.lines("content")).cast("bigint").alias("line_count"), F.size(T.words("content")).cast("bigint").alias("word_count")
    )


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return normalize.normalize(documents(spark, d)).select("id", "normalized", "normalized_hash", "stale")


def control_markers(spark: SparkSession, d: str) -> DataFrame:
    return normalize.marker_counts(documents(spark, d))


def structure_lines(spark: SparkSession, d: str) -> DataFrame:
    return normalize.structure_counts(documents(spark, d))


def hash_integrity(spark: SparkSession, d: str) -> DataFrame:
    return normalize.integrity(documents(spark, d))


def boilerplate_lines(spark: SparkSession, d: str) -> DataFrame:
    return normalize.boilerplate_lines(documents(spark, d))


def offset_map(spark: SparkSession, d: str) -> DataFrame:
    out = normalize.with_offsets(documents(spark, d))
    return out.select("id", F.sha2("text", 256).alias("text_hash"), F.size("segments").alias("segments"), "composed")


def chunk_source_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Original offsets of each upstream chunk's stored normalized range (range join inside the document)."""
    seg = normalize.with_offsets(documents(spark, d)).select(F.col("id").alias("document_id"), "segments")
    start, end = F.col("metadata.normalized_start"), F.col("metadata.normalized_end")
    at, to = normalize.source_range(start, end, F.col("segments"))
    placed = chunks(spark, d).where(start.isNotNull() & end.isNotNull()).join(seg, "document_id")
    return placed.select("id", at.alias("original_start"), to.alias("original_end"))


def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    return chunking.heading_paths(documents(spark, d))


def heading_of_line(spark: SparkSession, d: str) -> DataFrame:
    """For each document, lines under its latest heading at or before them (as-of within the document)."""
    from pyspark.sql.window import Window

    ls = normalize.lines_of(documents(spark, d))
    own = F.when(F.col("line").rlike("^#{1,6} +[^ ]"), F.col("line_number"))
    w = Window.partitionBy("id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    asof = ls.select("id", "line_number", F.last(own, ignorenulls=True).over(w).alias("heading_line"))
    return asof.where("heading_line is not null").groupBy("id", "heading_line").agg(F.count("*").alias("lines_under"))


def token_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.token_windows(documents(spark, d)).select("document_id", F.col("index").cast("bigint").alias("chunk_index"), "token_count", F.md5("words").alias("words_hash"))


def structure_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.structure_chunks(documents(spark, d))


def language_vote(spark: SparkSession, d: str) -> DataFrame:
    return scoring.language_vote(documents(spark, d))


def parser_route(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).groupBy(files.route(F.col("mime_type"), F.col("source.source_path")).alias("parser")).agg(F.count("*").alias("documents"))


def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("source.source_path")
    return documents(spark, d).where(files.matches(p, include=("**/*.md", "**/*.txt", "**/*.html"), exclude=("**/archive/*",))).select("id", p.alias("path"))


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    title = F.coalesce("title", F.lit(""))
    return documents(spark, d).select(
        "id", T.safe_filename(title).alias("file_name"), T.truncate("content", 80).alias("short"), T.guard_cell("content").alias("cell"), T.rot13("content").alias("turned"), T.fold(title).alias("folded_title")
    )


def character_entropy(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("id", F.round(T.entropy("content"), 6).alias("entropy"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Namespaced, versioned identities of documents and chunks."""
    return chunks(spark, d).select("id", F.sha2(F.concat_ws(":", F.lit("chunk:v1"), "document_id", F.col("index").cast("string"), F.sha2("content", 256)), 256).alias("chunk_key"))


def metadata_entries(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("id", F.explode(F.map_entries("metadata")).alias("e")).select("id", F.col("e.key").alias("field"), F.col("e.value").alias("value"))


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their documents; those without one are told apart (left and anti join in one)."""
    docs = documents(spark, d).select(F.col("id").alias("document_id"), F.lit(True).alias("known"))
    return chunks(spark, d).join(docs, "document_id", "left").groupBy("document_id").agg(F.count("*").alias("chunks"), F.bool_and(F.coalesce("known", F.lit(False))).alias("document_known"))


def source_mix(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "scan_sources").select("source_id", "source_type")
    docs = documents(spark, d).select(F.col("source.source_id").alias("source_id"), F.length("content").cast("bigint").alias("chars"))
    return docs.join(src, "source_id").groupBy("source_type").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))


def extraction_flags(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("id", F.array_join(T.extraction_flags("content"), ",").alias("flags")).where("flags <> ''")


def line_repair(spark: SparkSession, d: str) -> DataFrame:
    return normalize.repair_lines(documents(spark, d)).select("id", F.md5("repaired").alias("repaired_hash"), "wraps", "hyphens")


def redacted_metadata(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("id", F.size(T.redact_headers("metadata")).cast("bigint").alias("fields"), F.array_join(T.unreferenced_secrets("metadata"), ",").alias("secret_fields"))


def scan_scores(spark: SparkSession, d: str) -> DataFrame:
    """The whole scan over the documents as they stand: chunks, rules, duplicates, quality, scores.

    The scan is run, stage by stage in a folder of its own; its one row is brought back.
    """
    from .. import pipeline
    from ..session import work_folder

    with work_folder(spark) as work:
        scores = pipeline.scan(documents(spark, d), work=work).scores
        return spark.createDataFrame(scores.collect(), scores.schema)


_TABLE_LINE = f"(({S.count_of('x', '|')}) >= 2 OR regexp_matches(x, {S.lit(normalize.GAPS)}))"
_BARE = "trim(x, ' ')"
_DIAGRAM = f"(length({_BARE}) >= 3 AND length({_BARE}) - length(translate({_BARE}, '+-|><=_/\\[]()', '')) >= 0.4 * length({_BARE}))"
_HEADING = f"(regexp_matches(x, '^#{{1,6}} ') OR (length({_BARE}) BETWEEN 1 AND 80 AND upper({_BARE}) = {_BARE} AND lower({_BARE}) <> {_BARE}))"
_VISIBLE = "content"
for _c, _n in P.MARKERS.items():
    if _c != "\u0000":
        _VISIBLE = f"replace({_VISIBLE}, chr({ord(_c)}), '<{_n}>')"
NORMALIZED = f"""regexp_replace(array_to_string(list_transform({S.lines(_VISIBLE)},
            lambda x: CASE WHEN {_TABLE_LINE} OR {_DIAGRAM} THEN rtrim(x, ' ') ELSE regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' $', '') END), chr(10)), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')"""
TABLE_LINE, HEADING_LINE = _TABLE_LINE, _HEADING
_HAN = "length(content) - length(regexp_replace(content, '[一-鿿]', '', 'g'))"
_VOTES = ", ".join(f"{{'n': len(list_filter(w, lambda x: x IN ({S.instances(s)}))), 'language': '{c}'}}" for c, s in sorted(P.STOP_WORDS.items()))
_FENCED = "regexp_matches(line, '^#{1,6} +[^ ]')"

QUERIES = {f.__name__: f for f in (
    doc_stats, normalize_text, control_markers, structure_lines, hash_integrity, boilerplate_lines, offset_map, chunk_source_ranges, heading_paths, heading_of_line, token_window_chunks, structure_chunks,
    language_vote, parser_route, glob_filter, text_functions, character_entropy, stable_ids, metadata_entries, chunk_documents, source_mix,
    extraction_flags, line_repair, redacted_metadata, scan_scores,
)}

SQL = {
    "doc_stats": f"WITH {S.DOCS} SELECT id, length(content) AS chars, {S.token_count('content')} AS tokens, CAST(len({S.lines('content')}) AS BIGINT) AS line_count, CAST(len({S.words('content')}) AS BIGINT) AS word_count FROM docs",
    "normalize_text": f"""WITH {S.DOCS}, n AS (SELECT id, normalized_content AS stored, {NORMALIZED} AS normalized FROM docs)
        SELECT id, normalized, sha256(normalized) AS normalized_hash, coalesce(stored <> normalized, true) AS stale FROM n""",
    "control_markers": f"WITH {S.DOCS} SELECT id, marker, n FROM (" + " UNION ALL ".join(f"SELECT id, '{n}' AS marker, CAST(length(content) - length(replace(content, chr({ord(c)}), '')) AS BIGINT) AS n FROM docs" for c, n in P.MARKERS.items() if c != "\u0000") + ") WHERE n > 0",
    "structure_lines": f"""WITH {S.DOCS}, l AS (SELECT id, unnest({S.lines('content')}) AS x FROM docs)
        SELECT id, count(*) AS line_count, CAST(count(*) FILTER (WHERE {_HEADING}) AS BIGINT) AS heading_lines, CAST(count(*) FILTER (WHERE regexp_matches(x, {S.lit(normalize.LIST_LINE)})) AS BIGINT) AS list_lines,
            CAST(count(*) FILTER (WHERE {_TABLE_LINE}) AS BIGINT) AS table_lines FROM l GROUP BY id""",
    "hash_integrity": f"WITH {S.DOCS} SELECT id, content_hash, sha256(content) AS actual_hash FROM docs WHERE content_hash IS NULL OR sha256(content) <> content_hash",
    "boilerplate_lines": f"""WITH {S.DOCS}, v AS (SELECT source.source_id AS source_id, id, list_filter(list_transform({S.lines('content')}, lambda x: trim(x, ' ')), lambda x: x <> '') AS v FROM docs),
        e AS (SELECT source_id, id, unnest(list_distinct([lower(v[1]), lower(v[-1])])) AS line FROM v WHERE len(v) > 1)
        SELECT source_id, line, count(DISTINCT id) AS documents FROM e GROUP BY ALL HAVING count(DISTINCT id) >= 3""",
    "heading_of_line": f"""WITH {S.DOCS}, l AS (SELECT id, unnest({S.lines('content')}) AS line, generate_subscripts({S.lines('content')}, 1) AS line_number FROM docs),
        a AS (SELECT id, last_value(CASE WHEN {_FENCED} THEN line_number END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading_line FROM l)
        SELECT id, CAST(heading_line AS INTEGER) AS heading_line, count(*) AS lines_under FROM a WHERE heading_line IS NOT NULL GROUP BY ALL""",
    "token_window_chunks": f"""WITH {S.DOCS}, t AS (SELECT id AS document_id, {S.tokens('content')} AS t FROM docs),
        w AS (SELECT document_id, t, unnest(range(0, CAST(greatest(ceil((len(t) - 30) / 470.0), 1) AS BIGINT))) AS chunk_index FROM t WHERE len(t) > 0)
        SELECT document_id, chunk_index, CAST(len(list_slice(t, chunk_index * 470 + 1, chunk_index * 470 + 500)) AS BIGINT) AS token_count, md5(array_to_string(list_slice(t, chunk_index * 470 + 1, chunk_index * 470 + 500), ' ')) AS words_hash FROM w""",
    "language_vote": f"""WITH {S.DOCS}, c AS (SELECT id, {_HAN} AS han, {S.words('content')} AS w FROM docs),
        v AS (SELECT id, han, list_sort(list_transform([{_VOTES}], lambda s: {{'k': -s.n, 'language': s.language}})) AS v FROM c)
        SELECT id, CASE WHEN han >= 20 THEN 'zh-CN' WHEN -v[1].k >= 6 AND -v[1].k >= -v[2].k + 2 THEN v[1].language ELSE 'en' END AS vote FROM v""",
    "parser_route": f"""WITH {S.DOCS}, p AS (SELECT lower(regexp_replace(coalesce(mime_type, ''), ';.*$', '')) AS m, lower(regexp_extract(coalesce(source.source_path, ''), '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM docs)
        SELECT coalesce(CASE WHEN m = 'text/markdown' THEN 'markdown' WHEN m = 'application/pdf' THEN 'pdf' WHEN m LIKE '%officedocument%' OR m LIKE '%opendocument%' OR m = 'application/epub+zip' THEN 'archive'
                WHEN m LIKE 'text/%' OR m IN ('application/json', 'application/xml', 'application/x-tex') THEN 'text' END,
            CASE WHEN ext IN ('md', 'markdown') THEN 'markdown' WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ({S.instances(tuple(files.ARCHIVE_EXTENSIONS))}) THEN 'archive' WHEN ext IN ({S.instances(tuple(files.TEXT_EXTENSIONS))}) THEN 'text' END, 'unsupported') AS parser,
            count(*) AS documents FROM p GROUP BY ALL""",
    "glob_filter": f"WITH {S.DOCS} SELECT id, source.source_path AS path FROM docs WHERE regexp_matches(source.source_path, '\\.(md|txt|html)$') AND NOT regexp_matches(source.source_path, '(^|/)archive/')",
    "text_functions": f"""WITH {S.DOCS} SELECT id,
            substring(regexp_replace(regexp_replace(lower(trim(coalesce(title, ''), ' ')), '[^a-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 1, 120) AS file_name,
            CASE WHEN length(content) > 80 THEN substring(content, 1, 68) || '…[truncated]' ELSE content END AS short,
            CASE WHEN regexp_matches(content, '^[=+\\-@\\t\\r]') THEN '''' || content ELSE content END AS cell,
            translate(content, '{T.ROT_FROM}', '{T.ROT_TO}') AS turned, {S.fold("coalesce(title, '')")} AS folded_title FROM docs""",
    "character_entropy": f"""WITH {S.DOCS}, c AS (SELECT id, unnest(string_split(content, '')) AS ch FROM docs), n AS (SELECT id, ch, count(*) AS n FROM c GROUP BY ALL)
        SELECT id, round(-sum(n * 1.0 / t * log2(n * 1.0 / t)), 6) AS entropy FROM (SELECT id, n, sum(n) OVER (PARTITION BY id) AS t FROM n) GROUP BY id""",
    "stable_ids": f"WITH {S.CHUNKS} SELECT id, sha256('chunk:v1:' || document_id || ':' || CAST(\"index\" AS VARCHAR) || ':' || sha256(content)) AS chunk_key FROM chs",
    "metadata_entries": f"WITH {S.DOCS}, e AS (SELECT id, unnest(map_entries(metadata)) AS e FROM docs) SELECT id, e.key AS field, e.value AS value FROM e",
    "redacted_metadata": f"""WITH {S.DOCS}, e AS (SELECT id, unnest(map_entries(metadata)) AS e FROM docs),
        s AS (SELECT id, list_sort(list(e.key)) AS k FROM e WHERE (regexp_matches(e.key, {S.lit(T.SECRET_KEY)}) AND coalesce(e.value, '') <> '' AND NOT coalesce(regexp_matches(e.value, {S.lit(T.REFERENCE)}), false)) OR coalesce({S.masked('e.value')} <> e.value, false) GROUP BY id)
        SELECT d.id, CAST(cardinality(metadata) AS BIGINT) AS fields, coalesce(array_to_string(s.k, ','), '') AS secret_fields FROM docs d LEFT JOIN s ON d.id = s.id""",
    "chunk_documents": f"WITH {S.DOCS}, {S.CHUNKS} SELECT c.document_id, count(*) AS chunks, bool_and(d.id IS NOT NULL) AS document_known FROM chs c LEFT JOIN docs d ON c.document_id = d.id GROUP BY ALL",
    "source_mix": f"WITH {S.DOCS} SELECT s.source_type, count(*) AS documents, CAST(sum(length(content)) AS BIGINT) AS chars FROM docs d JOIN scan_sources s ON d.source.source_id = s.source_id GROUP BY ALL",
}
