"""Findings, reports, history, jobs, schedules, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import history, scoring
from ..operators import jobs as J
from ..operators.base import chunks, documents, findings, jobs, table
from ..sources import web
from ..streaming import telemetry
from . import sql as S

NOW = "2025-02-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def severity_pivot(spark: SparkSession, d: str) -> DataFrame:
    return scoring.severity_histogram(findings(spark, d), "category")


def finding_filter(spark: SparkSession, d: str) -> DataFrame:
    return scoring.filtered(findings(spark, d), min_severity="medium", categories=("prompt_injection", "secret", "pii")).select("id", "severity", "category")


def report_top_findings(spark: SparkSession, d: str) -> DataFrame:
    return scoring.top_findings(findings(spark, d)).select("id", "severity", "category", "rule_id", F.round("confidence", 6).alias("confidence"))


def finding_groups(spark: SparkSession, d: str) -> DataFrame:
    return scoring.finding_groups(findings(spark, d), table(spark, d, "duplicate_members"))


def model_context(spark: SparkSession, d: str) -> DataFrame:
    return scoring.model_context(finding_groups(spark, d)).select("group_key", "affected", F.col("place").cast("bigint").alias("place"), F.col("chars_so_far").cast("bigint").alias("chars_so_far"))


def capped_matches(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty findings of each rule in order of first sight, and how many there are in all."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("rule_id").orderBy("first_seen", "id")
    f = findings(spark, d).withColumn("place", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy("rule_id")))
    return f.where("place <= 20").select("rule_id", "id", F.col("place").cast("bigint").alias("place"), "total")


def coverage(spark: SparkSession, d: str) -> DataFrame:
    return scoring.coverage(documents(spark, d), chunks(spark, d))


def coverage_percent(spark: SparkSession, d: str) -> DataFrame:
    c = scoring.coverage(documents(spark, d), chunks(spark, d))
    return c.groupBy("area").agg(F.round(F.avg(F.col("status").isin("assessed", "partial").cast("double")) * 100, 6).alias("percent"))


def scan_status(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).groupBy(F.col("source.source_id").alias("source_id")).agg(F.count("*").alias("documents"), F.sum(F.size(F.coalesce("warnings", F.array().cast("array<string>")))).cast("bigint").alias("warnings")).where("source_id is not null")
    return docs.select("source_id", scoring.scan_status(F.lit(False), F.lit(False), F.col("documents"), F.col("warnings")).alias("status"))


def ingestion_issues(spark: SparkSession, d: str) -> DataFrame:
    return scoring.issues_of(documents(spark, d), chunks(spark, d))


def warning_messages(spark: SparkSession, d: str) -> DataFrame:
    return scoring.grouped_messages(documents(spark, d))


def report_json(spark: SparkSession, d: str) -> DataFrame:
    return scoring.report_json(severity_pivot(spark, d))


def finding_union(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the recorded scan and issues of ingestion in one frame; missing columns are null."""
    f = findings(spark, d).select("id", "category", "severity")
    i = scoring.issues_of(documents(spark, d), chunks(spark, d)).select(F.col("item").alias("id"), F.col("issue").alias("category"))
    return f.unionByName(i, allowMissingColumns=True).groupBy("category", "severity").agg(F.count("*").alias("rows"))


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two scans by time: what was first seen by mid-January, and what was last seen after it."""
    f = findings(spark, d).where("fingerprint is not null")
    cut = F.lit("2025-01-20 00:00:00").cast("timestamp_ntz")
    return f.where(F.col("first_seen") <= cut), f.where(F.col("last_seen") > cut)


def scan_compare(spark: SparkSession, d: str) -> DataFrame:
    return history.compare(*_halves(spark, d)).groupBy("state").agg(F.count("*").alias("findings"))


def history_insert(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return history.save(old, new).select("fingerprint")


def change_detection(spark: SparkSession, d: str) -> DataFrame:
    """Stored hash against the text: items of a source as two snapshots by ingestion time."""
    s = table(spark, d, "scan_documents").select(F.col("id").alias("external_id"), F.concat_ws(":", F.coalesce("content_hash", F.lit("")), F.length("content").cast("string")).alias("version"), "ingested_at")
    cut = F.lit("2025-01-20 00:00:00").cast("timestamp_ntz")
    return history.changes(s.where(F.col("ingested_at") <= cut), s.where(F.col("ingested_at") > cut))


def history_page(spark: SparkSession, d: str) -> DataFrame:
    scans = jobs(spark, d).select("id", F.col("available_at").alias("created_at"), F.get_json_object("payload_json", "$.source_id").alias("source_id"))
    return history.page(scans, before=None, limit=50, offset=10).select("id", "source_id")


def next_display_id(spark: SparkSession, d: str) -> DataFrame:
    return history.next_display_id(table(spark, d, "scan_sources").select(F.concat(F.lit("SCAN-"), F.regexp_extract("source_id", "src-([0-9]+)", 1)).alias("display_id")))


def score_deltas(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return history.score_deltas(scoring.security_score(old, ["category"]), scoring.security_score(new, ["category"]), "category", "security")


def job_states(spark: SparkSession, d: str) -> DataFrame:
    return J.states(jobs(spark, d), _now())


def next_job(spark: SparkSession, d: str) -> DataFrame:
    return J.next_job(jobs(spark, d), _now())


def job_retries(spark: SparkSession, d: str) -> DataFrame:
    return J.retries(jobs(spark, d))


def job_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Dotted-path extraction from JSON, with the work each source has asked for."""
    j = jobs(spark, d)
    return j.groupBy(F.get_json_object("payload_json", "$.source_id").alias("source_id")).agg(F.count("*").alias("jobs"), F.sum(F.get_json_object("payload_json", "$.documents").try_cast("bigint")).alias("documents"))


def _schedules(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("source_id", "src-([0-9]+)", 1).cast("int")
    start = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "scan_sources").select(
        F.col("source_id").alias("id"), F.lit("static_scan").alias("kind"), (n * 15 + 15).alias("interval_minutes"), (n % 5 != 0).alias("enabled"), (start + F.make_dt_interval(hours=n * 20)).alias("next_run_at")
    )


def schedule_materialize(spark: SparkSession, d: str) -> DataFrame:
    return J.materialize(_schedules(spark, d), jobs(spark, d), _now()).select("schedule_id", "idempotency_key", "available_at", "next_run_at")


def enqueue_idempotent(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d)
    return J.enqueue(j.where("status = 'succeeded'"), j.where("status <> 'succeeded'").select("kind", "idempotency_key")).select("kind", "idempotency_key")


def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    return J.rate_limit(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", limit=2, seconds=600).select("event_id", "in_window", "over_limit")


def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    """Sitemaps composed from each source's documents; foreign origins and repeats fall out."""
    ids = documents(spark, d).where("source.source_id is not null").select(F.col("source.source_id").alias("s"), "id")
    base = F.concat(F.lit("https://"), "s", F.lit(".example/"))
    loc = F.concat(F.lit("<url><loc> "), F.when(F.substring("id", -1, 1).isin("0", "1"), F.lit("http://other.example/")).otherwise(base), "id", F.lit(" </loc></url>"))
    return web.sitemap_entry_urls(web.places(ids, "s", "id").select(base.alias("base_url"), F.concat(F.lit("<urlset>"), loc, F.lit("</urlset>")).alias("xml"), "place"))


def environment_classes(spark: SparkSession, d: str) -> DataFrame:
    """Sources classified by hints in their names."""
    low = F.lower("source_name")
    kind = F.when(low.contains("wiki"), "wiki").when(low.contains("handbook") | low.contains("runbook"), "handbook").when(low.contains("desk"), "helpdesk").otherwise("other")
    return table(spark, d, "scan_sources").groupBy("source_type", kind.alias("kind")).agg(F.count("*").alias("sources"))


def source_identity(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("HTTPS://"), F.upper("source_id"), F.lit(".Example:443/docs/"))
    return table(spark, d, "scan_sources").select("source_id", web.identity(F.col("source_type"), F.concat(F.lit("/srv/"), "source_id", F.lit("/")), url).alias("identity"))


def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.tumbling(table(spark, d, "events"))


def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.sliding(table(spark, d, "events"))


def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.sessions(table(spark, d, "events"))


_RANK = S.RANKS.format("severity")
_GROUPS = f"""g AS (SELECT chunk_id, min(group_id) AS group_id FROM duplicate_members WHERE chunk_id IS NOT NULL GROUP BY 1),
    fg AS (SELECT coalesce(group_id, rule_id) AS group_key, count(*) AS findings, count(DISTINCT coalesce(f.chunk_id, f.id)) AS affected, CAST(max({_RANK}) AS BIGINT) AS top_rank, min(rule_id) AS first_rule FROM fnd f LEFT JOIN g ON f.chunk_id = g.chunk_id GROUP BY 1)"""
_ISSUES = """bad AS (SELECT id AS item, 'hash_mismatch' AS issue FROM docs WHERE sha256(content) <> coalesce(content_hash, '')),
    later AS (SELECT id AS item, 'empty_document' AS issue FROM docs WHERE coalesce(trim(content, ' '), '') = '' UNION ALL SELECT id, 'orphan_chunk' FROM chs WHERE NOT EXISTS (SELECT 1 FROM docs WHERE docs.id = chs.document_id)),
    iss AS (SELECT * FROM bad UNION ALL SELECT * FROM later WHERE item NOT IN (SELECT item FROM bad))"""
_CUT = "TIMESTAMP '2025-01-20 00:00:00'"
_OLD = f"old AS (SELECT * FROM fnd WHERE fingerprint IS NOT NULL AND first_seen <= {_CUT}), new AS (SELECT * FROM fnd WHERE fingerprint IS NOT NULL AND last_seen > {_CUT})"
_COVER = """one AS (SELECT d.source_id, d.documents, coalesce(k.chunks, 0) AS chunks FROM (SELECT source.source_id AS source_id, count(*) AS documents FROM docs GROUP BY 1) d LEFT JOIN (SELECT source.source_id AS source_id, count(*) AS chunks FROM chs GROUP BY 1) k USING (source_id) WHERE d.source_id IS NOT NULL),
    cov AS (SELECT source_id, 'security' AS area, 'assessed' AS status, '' AS reason FROM one UNION ALL SELECT source_id, 'exact_duplicates', CASE WHEN documents > 1 THEN 'assessed' ELSE 'partial' END, CASE WHEN documents > 1 THEN '' ELSE 'single document' END FROM one
        UNION ALL SELECT source_id, 'chunk_quality', CASE WHEN chunks > 0 THEN 'assessed' ELSE 'not_assessed' END, CASE WHEN chunks > 0 THEN '' ELSE 'no chunks' END FROM one)"""
_SCORE = "round(greatest(0.0, 100.0 - coalesce(sum((CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.SEVERITY_PENALTY.items()) + " END) * confidence), 0.0)), 6)"
_PIVOT = f"SELECT category, {', '.join(f'''count(*) FILTER (WHERE severity = '{s}') AS {s}''' for s in P.SEVERITY_RANK)} FROM fnd GROUP BY 1"
_TNOW = f"TIMESTAMP '{NOW}'"
_SCHED = """sch AS (SELECT source_id AS id, n * 15 + 15 AS interval_minutes, n % 5 <> 0 AS enabled, TIMESTAMP '2025-01-01 00:00:00' + to_hours(n * 20) AS next_run_at FROM (SELECT source_id, CAST(regexp_extract(source_id, 'src-([0-9]+)', 1) AS INTEGER) AS n FROM scan_sources))"""

QUERIES = {f.__name__: f for f in (
    severity_pivot, finding_filter, report_top_findings, finding_groups, model_context, capped_matches, coverage, coverage_percent, scan_status, ingestion_issues, warning_messages, report_json, finding_union, scan_compare, history_insert,
    change_detection, history_page, next_display_id, score_deltas, job_states, next_job, job_retries, job_payloads, schedule_materialize, enqueue_idempotent, rate_limit_window, sitemap_urls, environment_classes, source_identity,
    events_tumbling, events_sliding, events_sessions,
)}

SQL = {
    "severity_pivot": f"WITH {S.FINDINGS} {_PIVOT}",
    "finding_filter": f"WITH {S.FINDINGS} SELECT id, severity, category FROM fnd WHERE {_RANK} >= 2 AND category IN ('prompt_injection', 'secret', 'pii')",
    "report_top_findings": f"WITH {S.FINDINGS} SELECT id, severity, category, rule_id, round(confidence, 6) AS confidence FROM fnd ORDER BY {_RANK} DESC, fnd.confidence DESC, category, rule_id, fingerprint, id LIMIT 500",
    "finding_groups": f"WITH {S.FINDINGS}, {_GROUPS} SELECT * FROM fg",
    "model_context": f"""WITH {S.FINDINGS}, {_GROUPS}, t AS (SELECT * FROM fg ORDER BY top_rank DESC, affected DESC, group_key LIMIT 25),
        r AS (SELECT group_key, affected, row_number() OVER o AS place, CAST(sum(length(group_key || '|' || first_rule || '|' || CAST(affected AS VARCHAR))) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS chars_so_far FROM t WINDOW o AS (ORDER BY top_rank DESC, affected DESC, group_key))
        SELECT * FROM r WHERE chars_so_far <= 18000""",
    "capped_matches": f"WITH {S.FINDINGS} SELECT rule_id, id, row_number() OVER (PARTITION BY rule_id ORDER BY first_seen NULLS FIRST, id) AS place, count(*) OVER (PARTITION BY rule_id) AS total FROM fnd QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY first_seen NULLS FIRST, id) <= 20",
    "coverage": f"WITH {S.DOCS}, {S.CHUNKS}, {_COVER} SELECT * FROM cov",
    "coverage_percent": f"WITH {S.DOCS}, {S.CHUNKS}, {_COVER} SELECT area, round(avg(CASE WHEN status IN ('assessed', 'partial') THEN 1.0 ELSE 0.0 END) * 100, 6) AS percent FROM cov GROUP BY 1",
    "scan_status": f"WITH {S.DOCS} SELECT source.source_id AS source_id, CASE WHEN count(*) = 0 THEN 'failed' WHEN sum(len(coalesce(warnings, []))) > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status FROM docs WHERE source.source_id IS NOT NULL GROUP BY 1",
    "ingestion_issues": f"WITH {S.DOCS}, {S.CHUNKS}, {_ISSUES} SELECT * FROM iss",
    "warning_messages": f"WITH {S.DOCS} SELECT message, count(DISTINCT id) AS documents FROM (SELECT id, unnest(warnings) AS message FROM docs) GROUP BY 1 ORDER BY 1 LIMIT 50",
    "report_json": f"""WITH {S.FINDINGS}, p AS ({_PIVOT}) SELECT '{{"category":"' || category || '","critical":' || critical || ',"high":' || high || ',"info":' || info || ',"low":' || low || ',"medium":' || medium || '}}' AS report FROM p""",
    "finding_union": f"WITH {S.DOCS}, {S.CHUNKS}, {S.FINDINGS}, {_ISSUES} SELECT category, severity, count(*) AS rows FROM (SELECT category, severity FROM fnd UNION ALL SELECT issue, NULL FROM iss) GROUP BY ALL",
    "scan_compare": f"""WITH {S.FINDINGS}, {_OLD}, b AS (SELECT fingerprint, max(severity) AS before FROM old GROUP BY 1), c AS (SELECT fingerprint, max(severity) AS after FROM new GROUP BY 1)
        SELECT CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'resolved' WHEN before <> after THEN 'severity_changed' ELSE 'recurring' END AS state, count(*) AS findings FROM b FULL JOIN c USING (fingerprint) GROUP BY 1""",
    "history_insert": f"WITH {S.FINDINGS}, {_OLD} SELECT DISTINCT fingerprint FROM new WHERE fingerprint NOT IN (SELECT fingerprint FROM old)",
    "change_detection": f"""WITH s AS (SELECT id AS external_id, coalesce(content_hash, '') || ':' || CAST(length(content) AS VARCHAR) AS version, ingested_at FROM scan_documents), o AS (SELECT external_id, max(version) AS previous_version FROM s WHERE ingested_at <= {_CUT} GROUP BY 1),
        n AS (SELECT external_id, max(version) AS current_version FROM s WHERE ingested_at > {_CUT} GROUP BY 1)
        SELECT external_id, CASE WHEN previous_version IS NULL THEN 'added' WHEN current_version IS NULL THEN 'deleted' ELSE 'modified' END AS change, previous_version, current_version FROM o FULL JOIN n USING (external_id) WHERE previous_version IS DISTINCT FROM current_version""",
    "history_page": f"WITH {S.JOBS} SELECT id, json_extract_string(payload_json, '$.source_id') AS source_id FROM jbs ORDER BY available_at DESC NULLS LAST, id LIMIT 50 OFFSET 10",
    "next_display_id": "SELECT 'SCAN-' || lpad(CAST(max(CAST(regexp_extract(source_id, 'src-([0-9]+)', 1) AS BIGINT)) + 1 AS VARCHAR), 4, '0') AS next_id FROM scan_sources",
    "score_deltas": f"WITH {S.FINDINGS}, {_OLD}, a AS (SELECT category, {_SCORE} AS before FROM old GROUP BY 1), b AS (SELECT category, {_SCORE} AS after FROM new GROUP BY 1) SELECT category, before, after, round(after - before, 6) AS delta FROM a FULL JOIN b USING (category)",
    "job_states": f"""WITH {S.JOBS}, x AS (SELECT *, status = 'running' AND (lease_expires_at IS NULL OR lease_expires_at < {_TNOW}) AS expired, attempt_count >= max_attempts AS spent FROM jbs)
        SELECT id, status, CASE WHEN status = 'cancel_requested' THEN 'cancelled' WHEN expired AND spent THEN 'failed' WHEN expired THEN 'queued' WHEN status = 'queued' AND spent THEN 'failed' WHEN status = 'queued' AND available_at <= {_TNOW} THEN 'claimable' ELSE status END AS next_state FROM x""",
    "next_job": f"WITH {S.JOBS} SELECT id, kind, available_at FROM jbs WHERE status = 'queued' AND available_at <= {_TNOW} AND attempt_count < max_attempts ORDER BY available_at, id LIMIT 1",
    "job_retries": f"WITH {S.JOBS}, r AS (SELECT id, available_at, CAST(least(pow(2, least(attempt_count, 10)), 60) AS BIGINT) AS delay_seconds FROM jbs WHERE status = 'failed' AND attempt_count < max_attempts) SELECT id, delay_seconds, available_at + to_seconds(delay_seconds) AS retry_at FROM r",
    "job_payloads": f"WITH {S.JOBS} SELECT json_extract_string(payload_json, '$.source_id') AS source_id, count(*) AS jobs, CAST(sum(TRY_CAST(json_extract_string(payload_json, '$.documents') AS BIGINT)) AS BIGINT) AS documents FROM jbs GROUP BY 1",
    "schedule_materialize": f"""WITH {S.JOBS}, {_SCHED}, due AS (SELECT id AS schedule_id, 'static_scan' AS kind, 'schedule:' || id || ':' || strftime(next_run_at, '%Y%m%d%H%M') AS idempotency_key, next_run_at AS available_at,
            next_run_at + to_minutes(CAST((floor(epoch({_TNOW} - next_run_at) / (interval_minutes * 60)) + 1) * interval_minutes AS BIGINT)) AS next_run_at FROM sch WHERE enabled AND next_run_at <= {_TNOW})
        SELECT schedule_id, idempotency_key, available_at, next_run_at FROM due WHERE NOT EXISTS (SELECT 1 FROM jbs j WHERE j.kind = due.kind AND j.idempotency_key = due.idempotency_key)""",
    "enqueue_idempotent": f"WITH {S.JOBS} SELECT DISTINCT kind, idempotency_key FROM jbs a WHERE status <> 'succeeded' AND NOT EXISTS (SELECT 1 FROM jbs b WHERE b.status = 'succeeded' AND b.kind IS NOT DISTINCT FROM a.kind AND b.idempotency_key IS NOT DISTINCT FROM a.idempotency_key)",
    "rate_limit_window": "SELECT event_id, n AS in_window, n > 2 AS over_limit FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) AS n FROM events)",
    "sitemap_urls": f"""WITH {S.DOCS}, i AS (SELECT source.source_id AS s, id, row_number() OVER (PARTITION BY source.source_id ORDER BY id) - 1 AS place_at FROM docs WHERE source.source_id IS NOT NULL)
        SELECT 'https://' || s || '.example/' AS base_url, 'https://' || s || '.example/' || id AS url, min(place_at) AS place FROM i WHERE right(id, 1) NOT IN ('0', '1') GROUP BY ALL""",
    "environment_classes": "SELECT source_type, CASE WHEN lower(source_name) LIKE '%wiki%' THEN 'wiki' WHEN lower(source_name) LIKE '%handbook%' OR lower(source_name) LIKE '%runbook%' THEN 'handbook' WHEN lower(source_name) LIKE '%desk%' THEN 'helpdesk' ELSE 'other' END AS kind, count(*) AS sources FROM scan_sources GROUP BY ALL",
    "source_identity": "SELECT source_id, CASE WHEN source_type = 'filesystem' THEN '/srv/' || source_id ELSE 'https://' || lower(source_id) || '.example:443/docs' END AS identity FROM scan_sources",
    "events_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "events_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1",
    "events_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
        SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
}
