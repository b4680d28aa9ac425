"""Exact and near duplicates, and the record of an earlier scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import duplicates
from ..operators.base import chunks, documents, table
from ..operators.graph import connected_components
from ..session import cut
from . import sql as S


def exact_dup_docs(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.exact_groups(duplicates.document_items(documents(spark, d)))


def _chunk_items(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.chunk_items(documents(spark, d), chunks(spark, d))


def exact_dup_chunks(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.exact_groups(_chunk_items(spark, d))


def dup_stats(spark: SparkSession, d: str) -> DataFrame:
    items = duplicates.document_items(documents(spark, d)).unionByName(_chunk_items(spark, d))
    return duplicates.duplicate_statistics(duplicates.exact_groups(items), items)


def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.near_pairs(_chunk_items(spark, d))


def _components(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pairs = cut(near_dup_pairs(spark, d))
    comp = connected_components(pairs, "left_key", "right_key")
    return pairs, comp


def near_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    pairs, comp = _components(spark, d)
    return duplicates.near_groups(pairs, comp)


def near_dup_classes(spark: SparkSession, d: str) -> DataFrame:
    items = _chunk_items(spark, d)
    return duplicates.near_classes(items, duplicates.near_pairs(items)).select("item_id", "component", "links")


def shared_phrases(spark: SparkSession, d: str) -> DataFrame:
    _, comp = _components(spark, d)
    return duplicates.shared_phrases(_chunk_items(spark, d), comp)


def separated_groups(spark: SparkSession, d: str) -> DataFrame:
    items = _chunk_items(spark, d)
    classes = duplicates.near_classes(items, duplicates.near_pairs(items))
    return duplicates.separate_sources(classes.join(items.select("item_id", F.col("document_id").alias("source_id")), "item_id").select("component", "item_id", "source_id"))


def recorded_groups(spark: SparkSession, d: str) -> DataFrame:
    """The earlier scan's groups, with what their members say now: repeated member rows count once."""
    m = table(spark, d, "duplicate_members").select("group_id", "item_id", "character_count", "token_count").distinct().groupBy("group_id", "item_id").agg(F.max("character_count").alias("chars"), F.max("token_count").alias("tokens"))
    g = table(spark, d, "duplicate_groups").select("id", "category", "canonical_item_id").distinct()
    agg = m.groupBy("group_id").agg(F.count("*").alias("members"), F.sum("chars").alias("chars"), F.min("item_id").alias("first_item"))
    return g.join(agg, g.id == agg.group_id, "left").select("id", "category", F.coalesce("members", F.lit(0)).cast("bigint").alias("members"), F.col("chars").cast("bigint").alias("chars"), (F.col("first_item") == F.col("canonical_item_id")).alias("canonical_is_first"))


def recorded_summary(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import scoring

    return scoring.duplicate_summary(table(spark, d, "duplicate_groups"))


def stale_members(spark: SparkSession, d: str) -> DataFrame:
    """Recorded members whose hash is not that of the chunk's stored normalized text."""
    now = chunks(spark, d).select(F.col("id").alias("chunk_id"), F.sha2("normalized_content", 256).alias("actual_hash"))
    m = table(spark, d, "duplicate_members").where("chunk_id is not null").select("group_id", "chunk_id", "normalized_hash").distinct()
    return m.join(now, "chunk_id").where(~F.col("normalized_hash").eqNullSafe(F.col("actual_hash"))).select("group_id", "chunk_id")


_BARE = "trim(regexp_replace(c.content, '[ \\t\\r\\n]+', ' ', 'g'), ' ')"
_ITEMS = f"""citems AS (SELECT 'chunk' AS item_type, c.id AS item_id, c.document_id, coalesce(c.source.source_path, '') AS path, c.content FROM chs c JOIN docs d ON c.document_id = d.id
    WHERE trim(c.content, ' ') <> trim(d.content, ' ') AND length(trim(c.content, ' ')) >= 48 AND NOT coalesce(c.metadata.generated AND len(list_filter(coalesce(c.headings, []), lambda h: h = {_BARE})) > 0, false)
      AND len({S.tokens('c.content')}) >= 6)"""
_DITEMS = "ditems AS (SELECT 'document' AS item_type, id AS item_id, id AS document_id, coalesce(source.source_path, '') AS path, content FROM docs WHERE trim(content, ' ') <> '')"


def _groups(items: str) -> str:
    return f"""SELECT item_type, content_hash,
        CASE WHEN item_type = 'document' THEN 'exact_duplicate_document' WHEN min(document_id) = max(document_id) THEN 'repeated_chunk_within_document' ELSE 'exact_duplicate_chunk' END AS category,
        arg_min(item_id, (path, item_id)) AS canonical_id, count(*) AS members, CAST(sum(chars) - any_value(chars) AS BIGINT) AS redundant_chars, CAST(sum(tokens) - any_value(tokens) AS BIGINT) AS redundant_tokens
        FROM (SELECT *, sha256(content) AS content_hash, length(content) AS chars, len({S.tokens('content')}) AS tokens FROM {items}) GROUP BY item_type, content_hash HAVING count(*) > 1"""


_SETS = f"""sets AS (SELECT key, {S.shingles('content')} AS s, list_distinct({S.words('content')}) AS w FROM (SELECT sha256(content) AS key, regexp_replace(regexp_replace(any_value(content), '\\r\\n?', chr(10), 'g'), {S.lit('(?im)' + duplicates.PAGE_LINE)}, '', 'g') AS content FROM citems WHERE length(trim(content, ' ')) >= 120 GROUP BY 1)),
    sh AS (SELECT key, unnest(s) AS t FROM sets), com AS (SELECT a.key AS l, b.key AS r, count(*) AS n FROM sh a JOIN sh b ON a.t = b.t AND a.key < b.key GROUP BY ALL),
    pairs AS (SELECT l AS left_key, r AS right_key, greatest(n * 1.0 / greatest(len(a.s), len(b.s)), CASE WHEN least(len(a.w), len(b.w)) * 10 >= 8 * greatest(len(a.w), len(b.w)) THEN 0.9 * len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) ELSE 0 END) AS exact
        FROM com JOIN sets a ON a.key = l JOIN sets b ON b.key = r),
    near AS (SELECT left_key, right_key, round(exact, 6) AS score FROM pairs WHERE exact >= 0.8 - 1e-12)"""
_REACH = """e AS (SELECT left_key AS a, right_key AS b FROM near UNION SELECT right_key, left_key FROM near),
    reach AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
    comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""
_BASE = f"{S.DOCS}, {S.CHUNKS}, {_ITEMS}"
_NEAR = f"WITH RECURSIVE {_BASE}, {_SETS}, {_REACH}"
_CLASSES = "classes AS (SELECT item_id, document_id, sha256(content) AS key FROM citems WHERE length(trim(content, ' ')) >= 120)"

QUERIES = {f.__name__: f for f in (exact_dup_docs, exact_dup_chunks, dup_stats, near_dup_pairs, near_dup_groups, near_dup_classes, shared_phrases, separated_groups, recorded_groups, recorded_summary, stale_members)}

SQL = {
    "exact_dup_docs": f"WITH {S.DOCS}, {_DITEMS} {_groups('ditems')}",
    "exact_dup_chunks": f"WITH {_BASE} {_groups('citems')}",
    "dup_stats": f"""WITH {_BASE}, {_DITEMS}, items AS (SELECT * FROM ditems UNION ALL SELECT * FROM citems), g AS ({_groups('items')})
        SELECT count(*) FILTER (WHERE category = 'exact_duplicate_document') AS document_groups, count(*) FILTER (WHERE category = 'exact_duplicate_chunk') AS chunk_groups,
            count(*) FILTER (WHERE category = 'repeated_chunk_within_document') AS repeated_groups, CAST(coalesce(sum(redundant_chars), 0) AS BIGINT) AS redundant_chars, CAST(coalesce(sum(redundant_tokens), 0) AS BIGINT) AS redundant_tokens,
            round(least(100.0, coalesce(sum(redundant_chars), 0) * 100.0 / greatest((SELECT sum(length(content)) FROM items), 1)), 6) AS redundant_percent FROM g""",
    "near_dup_pairs": f"WITH {_BASE}, {_SETS} SELECT * FROM near",
    "near_dup_groups": f"""{_NEAR} SELECT s.component, s.classes, m.similarity FROM (SELECT component, count(*) AS classes FROM comp GROUP BY 1) s
        JOIN (SELECT component, min(score) AS similarity FROM near JOIN comp ON left_key = node GROUP BY 1) m USING (component)""",
    "near_dup_classes": f"""{_NEAR}, {_CLASSES}, links AS (SELECT a AS key, count(*) AS links FROM e GROUP BY 1)
        SELECT item_id, component, links FROM classes JOIN comp ON key = node JOIN links USING (key)""",
    "shared_phrases": f"""{_NEAR}, n AS (SELECT component, count(*) AS classes FROM comp GROUP BY 1), p AS (SELECT component, t AS phrase, count(*) AS n FROM comp JOIN sh ON node = key GROUP BY ALL)
        SELECT component, substring(phrase, 1, 200) AS phrase FROM p JOIN n USING (component) WHERE n = classes QUALIFY row_number() OVER (PARTITION BY component ORDER BY phrase) <= 5""",
    "separated_groups": f"""{_NEAR}, {_CLASSES}, m AS (SELECT component, item_id, document_id AS source_id FROM classes JOIN comp ON key = node),
        o AS (SELECT *, count(*) OVER (PARTITION BY component, source_id) >= 2 AS own FROM m),
        k AS (SELECT component, CASE WHEN own THEN 'within_document_near_duplicates' ELSE 'near_duplicate_chunk' END AS category, CASE WHEN own THEN source_id ELSE '' END AS part, item_id FROM o)
        SELECT component, category, part, count(*) AS members, min(item_id) AS first_item FROM k GROUP BY ALL HAVING count(*) >= 2""",
    "recorded_groups": """WITH m AS (SELECT group_id, item_id, max(character_count) AS chars FROM duplicate_members GROUP BY ALL), a AS (SELECT group_id, count(*) AS members, sum(chars) AS chars, min(item_id) AS first_item FROM m GROUP BY 1)
        SELECT DISTINCT g.id, category, coalesce(members, 0) AS members, CAST(chars AS BIGINT) AS chars, first_item = canonical_item_id AS canonical_is_first FROM duplicate_groups g LEFT JOIN a ON g.id = a.group_id""",
    "recorded_summary": """SELECT count(*) FILTER (WHERE category = 'exact_duplicate_document') AS exact_documents, count(*) FILTER (WHERE category = 'exact_duplicate_chunk') AS exact_chunks, count(*) FILTER (WHERE category LIKE '%near_duplicate%') AS near,
        CAST(sum(coalesce(estimated_redundant_characters, 0)) AS BIGINT) AS redundant_chars FROM duplicate_groups""",
    "stale_members": f"""WITH {S.CHUNKS} SELECT DISTINCT m.group_id, m.chunk_id FROM duplicate_members m JOIN chs c ON m.chunk_id = c.id WHERE m.normalized_hash IS DISTINCT FROM sha256(c.normalized_content)""",
}
