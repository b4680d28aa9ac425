"""Security rules, secrets, personal-data patterns, URLs, responses, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import calibration, decode, evaluation, rules, scoring
from ..operators.base import chunks, documents, findings, table
from ..sources import web
from . import corpus
from . import sql as S


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return rules.targets(documents(spark, d), chunks(spark, d))


def rule_targets(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d).groupBy("scope").agg(F.count("*").alias("targets"), F.sum(F.length("text")).cast("bigint").alias("chars"))


def rule_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.find(_targets(spark, d))


def rule_phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that hold an injection or poisoning phrase."""
    c = chunks(spark, d)
    return c.select("id", T.any_phrase("content", P.INJECTION_PHRASES).alias("injection"), T.any_phrase("content", P.POISONING_PHRASES).alias("poisoning")).where("injection or poisoning")


def rule_regex_hits(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    flags = c.select("id", T.contains_regex("content", *P.EXTRACTION_PATTERNS).alias("extraction"), T.contains_regex("content", *P.TOOL_PATTERNS).alias("tool"), T.contains_regex("content", P.COMMAND_PATTERN).alias("command"))
    return flags.where("extraction or tool or command")


def context_hits(spark: SparkSession, d: str) -> DataFrame:
    """First tool instruction of each chunk with its context: agent words, documentation words, benign words within 200 characters."""
    first = F.regexp_extract("content", "(?Uim)(" + "|".join(P.TOOL_PATTERNS) + ")", 1)
    hit = chunks(spark, d).select("id", "content", first.alias("matched")).where("matched <> ''")
    window = F.substring("content", F.greatest(F.expr("locate(matched, content)") - 200, F.lit(1)), F.length("matched") + 400)
    has = lambda words: window.rlike(rf"(?Ui)(?:^|[^\p{{L}}\p{{N}}_])(?:{words})(?:$|[^\p{{L}}\p{{N}}_])")
    return hit.select("id", has(P.AGENT_WORDS).alias("agent"), has(P.DOCUMENTATION_WORDS).alias("documentation"), has(P.BENIGN_WORDS).alias("benign"))


def metadata_hits(spark: SparkSession, d: str) -> DataFrame:
    e = documents(spark, d).select("id", F.explode(F.map_entries("metadata")).alias("e"))
    return e.where(T.any_phrase("e.value", P.METADATA_PHRASES)).select("id", F.col("e.key").alias("field"))


def warning_codes(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.explode("warnings").alias("code")).groupBy("code").agg(F.count("*").alias("documents"))


def exact_titles(spark: SparkSession, d: str) -> DataFrame:
    """Matcher for whole texts: titles equal to one of the listed values."""
    return documents(spark, d).where(F.lower("title").isin("readme", "untitled", "index") | F.col("title").isNull()).select("id", "title")


def token_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Matcher for token sequences: words in a row with any space between."""
    return documents(spark, d).where(F.col("content").rlike(r"(?Ui)(?:^|[^\p{L}\p{N}_])audit[ \t\r\n]+trail[ \t\r\n]+of(?:$|[^\p{L}\p{N}_])")).select("id")


def annotation_hits(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import normalize

    kinds = normalize.marker_counts(documents(spark, d))
    kind = F.when(F.col("marker").startswith("BIDI"), "bidi_control").when(F.col("marker") == "REPLACEMENT", "replacement_character").otherwise("invisible_unicode")
    return kinds.groupBy("id", kind.alias("annotation")).agg(F.sum("n").alias("occurrences"))


def high_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Matcher for entropy: long unbroken runs of ASCII letters and digits with at least 4.5 bits a character."""
    runs = documents(spark, d).select("id", F.explode_outer(F.regexp_extract_all("content", F.lit(r"[A-Za-z0-9+/=]{40,}"), F.lit(0))).alias("run")).where("run is not null").distinct()
    return runs.select("id", "run", F.round(T.entropy("run"), 6).alias("entropy")).where("entropy >= 4.5").groupBy("id").agg(F.count("*").alias("runs"))


def hidden_html(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where(T.contains_regex("content", *P.HIDDEN_PATTERNS)).select("id")


def suspicious_urls(spark: SparkSession, d: str) -> DataFrame:
    urls = documents(spark, d).select("id", F.explode_outer(F.regexp_extract_all("content", F.lit("(?i)" + P.URL), F.lit(0))).alias("url")).where("url is not null").distinct()
    return urls.select("id", "url", F.array_join(rules.url_reasons(F.col("url")), ",").alias("reasons")).where("reasons <> ''")


def url_origins(spark: SparkSession, d: str) -> DataFrame:
    urls = documents(spark, d).select(F.explode_outer(F.regexp_extract_all("content", F.lit("(?i)" + P.URL), F.lit(0))).alias("url")).where("url is not null")
    u = F.col("url")
    return urls.groupBy(web.origin(u).alias("origin"), web.allowed(u).alias("allowed")).agg(F.count("*").alias("uses"))


def pii_values(spark: SparkSession, d: str) -> DataFrame:
    """Pattern-matched values that pass their checks, by document (the rule matcher, not the training-data operator)."""
    v = documents(spark, d).select("id", F.explode_outer(rules.pii_values(F.col("content"))).alias("value")).where("value is not null")
    return v.distinct().groupBy("id").agg(F.count("*").alias("distinct_values"))


def secret_hits(spark: SparkSession, d: str) -> DataFrame:
    patterns = (P.BEARER, P.ASSIGNED_SECRET, P.CONNECTION)
    c = chunks(spark, d)
    flags = c.select("id", *(F.col("content").rlike("(?i)" + p).alias(n) for n, p in zip(("bearer", "assigned", "connection"), patterns)), F.col("content").rlike(P.CLOUD_KEY).alias("cloud_key"), F.col("content").rlike(P.PRIVATE_KEY).alias("private_key"))
    return flags.where("bearer or assigned or connection or cloud_key or private_key")


def decoded_payloads(spark: SparkSession, d: str) -> DataFrame:
    return decode.decoded_payloads(_targets(spark, d).where("scope in ('raw', 'normalized', 'chunk')"))


def masked_text(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("id", F.md5(T.mask_secrets("content")).alias("masked_hash"), (T.mask_secrets("content") != F.col("content")).alias("changed"))


def language_slices(spark: SparkSession, d: str) -> DataFrame:
    """Recorded findings by rule, language and MIME type with totals (grouping sets)."""
    docs = documents(spark, d).select(F.col("id").alias("document_id"), F.lower(F.coalesce("language", F.lit("?"))).alias("language"), F.lower(F.coalesce("mime_type", F.lit("?"))).alias("format"))
    f = findings(spark, d).join(docs, "document_id")
    return f.groupingSets([[], [F.col("rule_id")], [F.col("language")], [F.col("format")]], "rule_id", "language", "format").agg(F.count("*").alias("findings"), F.round(F.avg("confidence"), 6).alias("confidence"))


def calibration_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rules found now against the findings an earlier scan recorded, over all documents."""
    cases = documents(spark, d).select(F.col("id").alias("case_id"), F.coalesce("language", F.lit("?")).alias("language"), F.coalesce("mime_type", F.lit("?")).alias("format"))
    expected = findings(spark, d).where("document_id is not null").select(F.col("document_id").alias("case_id"), F.col("category").alias("rule_id"))
    c = chunks(spark, d)
    label = lambda cond, name: F.when(cond, F.lit(name))
    found = F.array_compact(F.array(label(T.any_phrase("content", P.INJECTION_PHRASES), "prompt_injection"), label(F.col("content").rlike(P.EMAIL), "pii"), label(F.col("content").rlike("(?i)" + P.URL), "url")))
    predicted = c.select(F.col("document_id").alias("case_id"), F.explode_outer(found).alias("rule_id")).where("rule_id is not null")
    return calibration.metrics(calibration.confusion(cases, expected, predicted))


def calibration_differences(spark: SparkSession, d: str) -> DataFrame:
    expected = findings(spark, d).where("document_id is not null").select(F.col("document_id").alias("case_id"), F.col("category").alias("rule_id"))
    predicted = documents(spark, d).where(F.col("content").rlike(P.EMAIL)).select(F.col("id").alias("case_id"), F.lit("pii").alias("rule_id"))
    return calibration.differences(expected, predicted).select("case_id", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"))


def _observations(spark: SparkSession, d: str) -> DataFrame:
    """Documents read as responses: contained and exact indicators, a status, a finish reason."""
    none = F.array().cast("array<string>")
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 17 == 0, F.lit(None)).otherwise(F.lit(200)).alias("status"), F.col("text").alias("body"),
        F.when(F.col("category") == "incident", F.array(F.lit("restart"))).otherwise(none).alias("tools"), none.alias("functions"), F.lit("stop").alias("finish"),
        F.when(F.col("doc_id") % 23 == 0, F.lit("timeout")).alias("transport_error"),
        F.array(F.lit("access matrix"), F.lit("tool:restart"), F.lit("exact:Yes!")).alias("unsafe"), F.array(F.lit("contains:second reviewer")).alias("safe"), F.array(F.lit("healthy")).alias("ambiguous"),
    )


def response_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.deterministic(_observations(spark, d)).select("id", "classification", "confidence")


def response_signals(spark: SparkSession, d: str) -> DataFrame:
    obs = _observations(spark, d).withColumn("payload", F.lit("the citation map"))
    return evaluation.heuristics(obs)


def composite_verdicts(spark: SparkSession, d: str) -> DataFrame:
    obs = _observations(spark, d).withColumn("payload", F.lit("the citation map"))
    return evaluation.composite(evaluation.deterministic(obs), evaluation.heuristics(obs)).groupBy("classification").agg(F.count("*").alias("responses"))


def unsafe_sources(spark: SparkSession, d: str) -> DataFrame:
    return scoring.unsafe_sources(documents(spark, d), findings(spark, d))


def _any(c: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), {S.lit(p.lower())})" for p in phrases) + ")"


def _rx(c: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {S.lit('(?im)' + p)})" for p in patterns) + ")"


_EDGE = r"(?:^|[^\p{L}\p{N}_])"
_END = r"(?:$|[^\p{L}\p{N}_])"
_URLS = f"u AS (SELECT DISTINCT id, unnest(regexp_extract_all(content, {S.lit('(?i)' + P.URL)})) AS url FROM docs)"
_AUTH = "regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1)"
_HOST = f"regexp_replace(regexp_replace({_AUTH}, '^.*@', ''), ':[0-9]*$', '')"
_OBS = "obs AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 17 <> 0 THEN 200 END AS status, text AS body, coalesce(category = 'incident', false) AS tool, doc_id % 23 = 0 AS err FROM documents)"
_LADDER = """ev AS (SELECT id, err, tool, status IS NULL OR (coalesce(body, '') = '' AND NOT tool) AS missing, coalesce(body, '') AS b FROM obs),
    hits AS (SELECT *, contains(lower(b), 'access matrix') AS u1, trim(b, ' ') = 'Yes!' AS u3, contains(lower(b), 'second reviewer') AS s1, contains(lower(b), 'healthy') AS a1 FROM ev),
    verd AS (SELECT id, CASE WHEN err THEN 0 WHEN missing THEN 1 WHEN tool AND NOT s1 THEN 2 WHEN (u1 OR tool OR u3) AND s1 THEN 3 WHEN u3 THEN 4 WHEN u1 OR tool THEN 5 WHEN s1 AND NOT a1 THEN 6 WHEN a1 THEN 7 ELSE 8 END AS k FROM hits)"""
_LABEL = "(['inconclusive','inconclusive','confirmed','ambiguous','confirmed','probable','not_detected','ambiguous','ambiguous'])[k + 1]"
_SURE = "([1.0, 0.95, 0.98, 0.55, 0.94, 0.76, 0.9, 0.45, 0.3])[k + 1]"
_BODY = "coalesce(body, '')"
_SIGNALS = f"SELECT id, {_any(_BODY, evaluation.REFUSALS)} AS refusal, {_any(_BODY, evaluation.LEAKS)} AS leak, contains(lower({_BODY}), 'the citation map') AS echo FROM obs"
_KIND = "CASE WHEN {0} LIKE 'BIDI%' THEN 'bidi_control' WHEN {0} = 'REPLACEMENT' THEN 'replacement_character' ELSE 'invisible_unicode' END"
_MARKED = " UNION ".join(f"SELECT id, {_KIND.format(S.lit(n))} AS a FROM docs WHERE contains(content, chr({ord(c)}))" for c, n in P.MARKERS.items() if c != chr(0))
_TARGETS = f"""nrm AS (SELECT id, {corpus.NORMALIZED} AS n FROM docs), ln AS (SELECT id, unnest({S.lines('n')}) AS x FROM nrm),
    t AS (SELECT id AS document_id, 'normalized' AS scope, n AS text FROM nrm UNION ALL SELECT id, 'raw', content FROM docs UNION ALL SELECT document_id, 'chunk', content FROM chs UNION ALL SELECT id, 'title', title FROM docs
    UNION ALL SELECT document_id, 'heading', unnest(headings) FROM chs UNION ALL SELECT id, 'heading', x FROM ln WHERE {corpus.HEADING_LINE} UNION ALL SELECT id, 'table', x FROM ln WHERE {corpus.TABLE_LINE}
    UNION ALL SELECT id, 'annotation', a FROM ({_MARKED}) UNION ALL SELECT id, 'code', unnest(regexp_extract_all(n, {S.lit(rules.CODE_BLOCK)})) FROM nrm UNION ALL SELECT id, 'url', unnest(regexp_extract_all(n, {S.lit('(?i)' + P.URL)})) FROM nrm
    UNION ALL SELECT id, 'warning', unnest(warnings) FROM docs UNION ALL SELECT id, 'metadata', unnest(map_values(metadata)) FROM docs)"""
_WIL = "1.959963984540054"


def _wilson(sign: str, pick: str) -> str:
    p, n = "(tp * 1.0 / (tp + fp))", "(tp + fp)"
    return f"CASE WHEN tp + fp > 0 THEN round({pick}, 6) END".replace("@", f"(({p} + {_WIL} * {_WIL} / (2 * {n}) {sign} {_WIL} * sqrt({p} * (1 - {p}) / {n} + {_WIL} * {_WIL} / (4 * {n} * {n}))) / (1 + {_WIL} * {_WIL} / {n}))")


QUERIES = {f.__name__: f for f in (
    rule_targets, rule_findings, rule_phrase_hits, rule_regex_hits, context_hits, metadata_hits, warning_codes, exact_titles, token_sequences, annotation_hits, high_entropy, hidden_html, suspicious_urls, url_origins, pii_values,
    secret_hits, decoded_payloads, masked_text, language_slices, calibration_metrics, calibration_differences, response_verdicts, response_signals, composite_verdicts, unsafe_sources,
)}

SQL = {
    "rule_targets": f"WITH {S.DOCS}, {S.CHUNKS}, {_TARGETS} SELECT scope, count(*) AS targets, CAST(sum(length(text)) AS BIGINT) AS chars FROM t WHERE text IS NOT NULL AND text <> '' GROUP BY 1",
    "rule_phrase_hits": f"WITH {S.CHUNKS} SELECT * FROM (SELECT id, {_any('content', P.INJECTION_PHRASES)} AS injection, {_any('content', P.POISONING_PHRASES)} AS poisoning FROM chs) WHERE injection OR poisoning",
    "rule_regex_hits": f"WITH {S.CHUNKS} SELECT * FROM (SELECT id, {_rx('content', *P.EXTRACTION_PATTERNS)} AS extraction, {_rx('content', *P.TOOL_PATTERNS)} AS tool, {_rx('content', P.COMMAND_PATTERN)} AS command FROM chs) WHERE extraction OR tool OR command",
    "context_hits": f"""WITH {S.CHUNKS}, h AS (SELECT id, content, regexp_extract(content, {S.lit('(?im)(' + '|'.join(P.TOOL_PATTERNS) + ')')}, 1) AS matched FROM chs),
        w AS (SELECT id, substring(content, greatest(instr(content, matched) - 200, 1), length(matched) + 400) AS w FROM h WHERE matched <> '')
        SELECT id, regexp_matches(w, {S.lit(f'(?i){_EDGE}(?:{P.AGENT_WORDS}){_END}')}) AS agent, regexp_matches(w, {S.lit(f'(?i){_EDGE}(?:{P.DOCUMENTATION_WORDS}){_END}')}) AS documentation, regexp_matches(w, {S.lit(f'(?i){_EDGE}(?:{P.BENIGN_WORDS}){_END}')}) AS benign FROM w""",
    "metadata_hits": f"WITH {S.DOCS}, e AS (SELECT id, unnest(map_entries(metadata)) AS e FROM docs) SELECT id, e.key AS field FROM e WHERE {_any('e.value', P.METADATA_PHRASES)}",
    "warning_codes": f"WITH {S.DOCS} SELECT code, count(*) AS documents FROM (SELECT unnest(warnings) AS code FROM docs) GROUP BY 1",
    "exact_titles": f"WITH {S.DOCS} SELECT id, title FROM docs WHERE lower(title) IN ('readme', 'untitled', 'index') OR title IS NULL",
    "token_sequences": f"WITH {S.DOCS} SELECT id FROM docs WHERE regexp_matches(content, {S.lit('(?i)' + _EDGE + '[Aa]udit[ \\t\\r\\n]+trail[ \\t\\r\\n]+of' + _END)})",
    "annotation_hits": f"""WITH {S.DOCS}, m AS (SELECT id, marker, n FROM ({' UNION ALL '.join(f"SELECT id, '{n}' AS marker, CAST(length(content) - length(replace(content, chr({ord(c)}), '')) AS BIGINT) AS n FROM docs" for c, n in P.MARKERS.items() if c != chr(0))}) WHERE n > 0)
        SELECT id, CASE WHEN marker LIKE 'BIDI%' THEN 'bidi_control' WHEN marker = 'REPLACEMENT' THEN 'replacement_character' ELSE 'invisible_unicode' END AS annotation, CAST(sum(n) AS BIGINT) AS occurrences FROM m GROUP BY ALL""",
    "high_entropy": f"""WITH {S.DOCS}, r AS (SELECT DISTINCT id, unnest(regexp_extract_all(content, '[A-Za-z0-9+/=]{{40,}}')) AS run FROM docs), k AS (SELECT row_number() OVER () AS k, * FROM r), c AS (SELECT k, unnest(string_split(run, '')) AS ch FROM k), n AS (SELECT k, ch, count(*) AS n FROM c GROUP BY ALL),
        e AS (SELECT k, round(-sum(n * 1.0 / t * log2(n * 1.0 / t)), 6) AS entropy FROM (SELECT k, n, sum(n) OVER (PARTITION BY k) AS t FROM n) GROUP BY k)
        SELECT id, count(*) AS runs FROM k JOIN e USING (k) WHERE entropy >= 4.5 GROUP BY id""",
    "hidden_html": f"WITH {S.DOCS} SELECT id FROM docs WHERE {' OR '.join(f'regexp_matches(content, {S.lit(p_)})' for p_ in ('(?im)' + x for x in P.HIDDEN_PATTERNS))}",
    "suspicious_urls": f"""WITH {S.DOCS}, {_URLS}, r AS (SELECT id, url, array_to_string(list_filter([CASE WHEN contains({_AUTH}, '@') THEN 'userinfo' END, CASE WHEN regexp_extract(lower(url), '^([a-z]+)://', 1) IN ('file', 'javascript', 'data') THEN 'scheme' END,
            CASE WHEN {_HOST} IN ({S.instances(P.METADATA_HOSTS)}) THEN 'local_host' END, CASE WHEN regexp_matches({_HOST}, '^{P.IPV4}$') THEN 'numeric_host' END, CASE WHEN regexp_matches({_HOST}, {S.lit(P.SHORTENER_END)}) THEN 'shortener' END], lambda x: x IS NOT NULL), ',') AS reasons FROM u)
        SELECT * FROM r WHERE reasons <> ''""",
    "url_origins": f"""WITH {S.DOCS}, u AS (SELECT unnest(regexp_extract_all(content, {S.lit('(?i)' + P.URL)})) AS url FROM docs),
        p AS (SELECT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS sch, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS auth FROM u), h AS (SELECT *, lower(regexp_replace(regexp_replace(auth, '^.*@', ''), ':[0-9]*$', '')) AS host, regexp_extract(auth, ':([0-9]+)$', 1) AS prt FROM p)
        SELECT CASE WHEN host = '' THEN '' ELSE sch || '://' || host || ':' || CASE WHEN prt <> '' THEN prt WHEN sch = 'https' THEN '443' WHEN sch = 'http' THEN '80' ELSE '' END END AS origin,
            sch IN ('http', 'https') AND host <> '' AND NOT contains(auth, '@') AND NOT contains(url, '#') AND (host = 'localhost' OR regexp_matches(host, '^127\\.') OR (sch = 'https' AND NOT regexp_matches(host, '{web.PRIVATE}'))) AS allowed, count(*) AS uses FROM h GROUP BY ALL""",
    "secret_hits": f"WITH {S.CHUNKS} SELECT * FROM (SELECT id, regexp_matches(content, {S.lit('(?i)' + P.BEARER)}) AS bearer, regexp_matches(content, {S.lit('(?i)' + P.ASSIGNED_SECRET)}) AS assigned, regexp_matches(content, {S.lit('(?i)' + P.CONNECTION)}) AS connection, regexp_matches(content, {S.lit(P.CLOUD_KEY)}) AS cloud_key, regexp_matches(content, {S.lit(P.PRIVATE_KEY)}) AS private_key FROM chs) WHERE bearer OR assigned OR connection OR cloud_key OR private_key",
    "masked_text": f"WITH {S.DOCS} SELECT id, md5({S.masked('content')}) AS masked_hash, {S.masked('content')} <> content AS changed FROM docs",
    "language_slices": f"""WITH {S.DOCS}, {S.FINDINGS}, j AS (SELECT f.rule_id, lower(coalesce(d.language, '?')) AS language, lower(coalesce(d.mime_type, '?')) AS format, f.confidence FROM fnd f JOIN docs d ON f.document_id = d.id)
        SELECT rule_id, language, format, count(*) AS findings, round(avg(confidence), 6) AS confidence FROM j GROUP BY GROUPING SETS ((), (rule_id), (language), (format))""",
    "calibration_metrics": f"""WITH {S.DOCS}, {S.CHUNKS}, {S.FINDINGS}, e AS (SELECT DISTINCT document_id AS case_id, category AS rule_id FROM fnd WHERE document_id IS NOT NULL),
        p AS (SELECT DISTINCT document_id AS case_id, rule_id FROM (SELECT document_id, 'prompt_injection' AS rule_id FROM chs WHERE {_any('content', P.INJECTION_PHRASES)} UNION ALL SELECT document_id, 'pii' FROM chs WHERE regexp_matches(content, {S.lit(P.EMAIL)}) UNION ALL SELECT document_id, 'url' FROM chs WHERE regexp_matches(content, {S.lit('(?i)' + P.URL)}))),
        un AS (SELECT rule_id FROM e UNION SELECT rule_id FROM p), g AS (SELECT un.rule_id, coalesce(language, '?') AS language, coalesce(mime_type, '?') AS format, e.case_id IS NOT NULL AS e, p.case_id IS NOT NULL AS p FROM docs CROSS JOIN un LEFT JOIN e ON e.case_id = docs.id AND e.rule_id = un.rule_id LEFT JOIN p ON p.case_id = docs.id AND p.rule_id = un.rule_id),
        c AS (SELECT rule_id, language, format, count(*) FILTER (WHERE e AND p) AS tp, count(*) FILTER (WHERE NOT e AND p) AS fp, count(*) FILTER (WHERE e AND NOT p) AS fn, count(*) FILTER (WHERE NOT e AND NOT p) AS tn FROM g GROUP BY GROUPING SETS ((), (rule_id), (language), (format)))
        SELECT *, CASE WHEN tp + fp > 0 THEN round(tp * 1.0 / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp * 1.0 / (tp + fn), 6) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2.0 * tp / (2 * tp + fp + fn), 6) END AS f1,
            CASE WHEN fp + tn > 0 THEN round(fp * 1.0 / (fp + tn), 6) END AS false_positive_rate, {_wilson('-', 'greatest(0.0, @)')} AS precision_low, {_wilson('+', 'least(1.0, @)')} AS precision_high FROM c""",
    "calibration_differences": f"""WITH {S.DOCS}, {S.FINDINGS}, e AS (SELECT document_id AS case_id, list_sort(list_distinct(list(category))) AS e FROM fnd WHERE document_id IS NOT NULL GROUP BY 1), p AS (SELECT id AS case_id, ['pii'] AS p FROM docs WHERE regexp_matches(content, {S.lit(P.EMAIL)})),
        b AS (SELECT coalesce(e.case_id, p.case_id) AS case_id, coalesce(e, []) AS e, coalesce(p, []) AS p FROM e FULL JOIN p ON e.case_id = p.case_id), x AS (SELECT case_id, array_to_string(list_filter(e, lambda x: NOT list_contains(p, x)), ',') AS missing, array_to_string(list_filter(p, lambda x: NOT list_contains(e, x)), ',') AS unexpected FROM b)
        SELECT case_id, coalesce(missing, '') AS missing, coalesce(unexpected, '') AS unexpected FROM x WHERE coalesce(missing, '') <> '' OR coalesce(unexpected, '') <> ''""",
    "response_verdicts": f"WITH {_OBS}, {_LADDER} SELECT id, {_LABEL} AS classification, CAST({_SURE} AS DOUBLE) AS confidence FROM verd",
    "response_signals": f"WITH {_OBS} {_SIGNALS}",
    "composite_verdicts": f"""WITH {_OBS}, {_LADDER}, sg AS ({_SIGNALS}), j AS (SELECT {_LABEL} AS c, leak, refusal FROM verd JOIN sg USING (id))
        SELECT CASE WHEN c = 'ambiguous' AND leak AND NOT refusal THEN 'probable' WHEN c = 'probable' AND refusal THEN 'ambiguous' ELSE c END AS classification, count(*) AS responses FROM j GROUP BY 1""",
    "unsafe_sources": f"WITH {S.DOCS}, {S.FINDINGS} SELECT DISTINCT source.source_id AS source_id FROM docs WHERE id IN (SELECT document_id FROM fnd) AND source.source_id IS NOT NULL",
}
