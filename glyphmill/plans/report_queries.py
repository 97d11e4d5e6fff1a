"""Queries on reports over what our detectors and rules find, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import CLICHES
from ..operators import audit, fixes, registry, reports, review
from ..operators.audit import SEVERITIES
from ..operators.stage import settle
from ..sources.dom import nodes
from .operation_queries import CLASS, KIND, Euro, planted_issues, planted_pages
from .rule_queries import RULE_PARTS, audited, once
from .text_queries import ODD, PHRASES, SQL_ODD, _docs, _list, _with_odd


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, text): every text with a sentence of phrases and some odd characters behind it."""
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("doc_id") % len(values))
    return _docs(spark, sf_dir).select("doc_id", "source", F.concat("text", pick(PHRASES), F.lit(" "), pick(ODD)).alias("text"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of three detectors over all texts, with the words and the line that they stand in."""

    def make() -> DataFrame:
        texts = _texts(spark, sf_dir)
        blocks = texts.select(F.col("doc_id").alias("block_id"), "text", F.lit("en").alias("language_hint"))
        found = registry.default_registry().run(blocks, "phrases", "phrase-load", "odd-characters", placed=True)
        met = found.join(texts.select(F.col("doc_id").alias("block_id"), F.col("source").alias("file")), "block_id")
        return met.select(
            "file", F.col("start").cast("long").alias("offset"), "block_id", "detector", F.when(F.col("detector") == "odd-characters", "characters").otherwise("style").alias("source"), "confidence", "score",
            "text", F.lit(None).cast("string").alias("replacement"), "explanation", "line",
        )

    return once("findings", spark, sf_dir, make)


_WORDY = lambda p: p.isalnum() or p == "_"
_PHRASE_ROWS = ", ".join(f"('{p.replace(chr(39), chr(39) * 2)}', '{p.lower().replace(chr(39), chr(39) * 2)}', {_WORDY(p[0])}, {_WORDY(p[-1])}, {0.3 if ' ' in p else 0.1})" for p in dict.fromkeys(CLICHES["en"]))
SQL_FINDINGS = rf"""(
WITH t AS (SELECT doc_id, source AS file, text || ({_list(PHRASES)})[1 + doc_id % {len(PHRASES)}] || ' ' || ({_list(ODD)})[1 + doc_id % {len(ODD)}] AS text FROM documents),
lex(phrase, low, w1, w2, weight) AS (VALUES {_PHRASE_ROWS}),
parts AS (SELECT doc_id, text, phrase, w1, w2, weight, length(phrase) AS n, string_split(lower(text), low) AS p FROM t JOIN lex ON contains(lower(t.text), lex.low)),
places AS (SELECT *, list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * n AS s FROM (SELECT *, unnest(range(1, len(p))) AS k FROM parts)),
hits AS (SELECT doc_id, s::BIGINT AS s, (s + n)::BIGINT AS e, phrase, weight FROM places WHERE NOT (w1 AND regexp_matches(substr(text, s::BIGINT, 1), '[\p{{L}}\p{{N}}_]') AND s > 0) AND NOT (w2 AND regexp_matches(substr(text, (s + n + 1)::BIGINT, 1), '[\p{{L}}\p{{N}}_]'))),
ch AS (SELECT doc_id, unnest(string_split(text, '')) AS x, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM t),
runs AS (SELECT doc_id, i, {KIND} AS kind, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM ch WHERE regexp_matches(x, '{CLASS}')),
found AS (
  SELECT doc_id, 'phrases' AS detector, 'style' AS kind, s, e, weight::DOUBLE AS score, phrase AS why FROM hits
  UNION ALL SELECT doc_id, 'phrase-load', 'style', 0, NULL, round(1 - exp(sum(ln(1 - weight))), 6), count(*) || ' phrases' FROM (SELECT DISTINCT doc_id, phrase, weight FROM hits) GROUP BY doc_id
  UNION ALL SELECT doc_id, 'odd-characters', 'characters', min(i), max(i) + 1, 0.5, string_agg(DISTINCT kind, ',' ORDER BY kind) FROM runs GROUP BY doc_id, g)
SELECT file, s AS "offset", doc_id AS block_id, detector, kind AS source, CASE WHEN score >= 0.66 THEN 'high' WHEN score >= 0.33 THEN 'medium' ELSE 'low' END AS confidence, score,
       CASE WHEN e IS NULL THEN '' ELSE substr(text, s + 1, e - s) END AS text, NULL::VARCHAR AS replacement, why AS explanation, length(text[1:s]) - length(replace(text[1:s], chr(10), '')) + 1 AS line
FROM found JOIN t USING (doc_id))"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's issues of all pages, with planted markup."""
    return audited(spark, sf_dir).withColumnRenamed("doc_id", "page_id")


_CATEGORY = "CASE " + " ".join(f"WHEN rule_id = '{r[0]}' THEN '{r[1]}'" for r in audit.RULES) + " END"
SQL_ISSUES = f"(WITH {RULE_PARTS} SELECT page_id, url AS source, rule_id, severity, {_CATEGORY} AS category FROM (SELECT *, unnest(range(n)) FROM counted) JOIN pages USING (page_id))"


def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with what doesn't print written out."""
    return _with_odd(_docs(spark, sf_dir)).select("doc_id", F.md5(reports.visible(F.col("text")).cast("binary")).alias("text_md5"))


def marker_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of two passages cut apart again; every third has its markers the wrong way round."""
    first, second = F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(2)
    answer = F.format_string("Here:\n<<<%d>>>\n%s\n <<<%d>>>\n%s <<<2>>>", first, "text", second, F.coalesce("source", F.lit("none")))
    cut = reports.split_marked(F.when(F.col("text").isNotNull(), answer), 2)
    return _docs(spark, sf_dir).select("doc_id", F.md5(cut[0].cast("binary")).alias("first_md5"), cut[1].alias("second"))


def offline_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both offline detectors over every text as one relation; offsets inside texts are beyond SQL, see the tests."""
    from .text_queries import PHRASES

    odd = _with_odd(_docs(spark, sf_dir))
    blocks = odd.select(F.col("doc_id").alias("block_id"), F.col("doc_id").cast("string").alias("file"), F.lit(1).alias("line"), F.lit(0).alias("start"), F.concat("text", F.lit(PHRASES[0])).alias("text"), F.lit(None).cast("string").alias("language_hint"))
    return reports.in_order(reports.offline_findings(blocks))


def detector_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, mean and greatest score of each detector's findings."""
    return reports.compare_detectors(_findings(spark, sf_dir)).withColumn("mean_score", F.round("mean_score", 6))


def best_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest score of each label's document, 0 without a finding."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("block_id"))
    return reports.best_scores(rows, _findings(spark, sf_dir).filter("confidence <> 'low'"), "block_id")


def coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read, summed over roots; languages stand for roots, those with over 200 texts are cut short."""
    walks = _docs(spark, sf_dir).groupBy(F.coalesce("lang", F.lit("-")).alias("root")).agg(F.count("*").alias("files_read"), F.sum(F.length("text")).alias("blocks_found"), F.count_if(F.length("text") < 300).alias("skipped_ignored"))
    return reports.coverage(walks.withColumn("truncated", F.col("files_read") > 200)).withColumn("truncated", F.array_join("truncated", ","))


def judged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with the judgments of labelled texts; the higher score counts."""
    judged = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(F.col("doc_id").alias("block_id")).agg((1 - F.min("quality") * 0.75).alias("score")).withColumn("reason", F.lit("labelled"))
    return reports.merge_judgments(_findings(spark, sf_dir), judged).select("block_id", "offset", F.round("score", 6).alias("score"), "source", "explanation")


def unjudged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts on which a detector fails (one that can't stand an ellipsis), by reason."""
    known = registry.Registry()
    known.register("euro", Euro)
    found = known.run(_texts(spark, sf_dir).select(F.col("doc_id").alias("block_id"), "text"), "euro")
    return reports.unjudged(found.select(F.col("block_id").alias("seq"), "error")).withColumn("reasons", F.array_join("reasons", "|"))


def skipped_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why fixes of planted issues are skipped: what the first 40 name, counted over all."""
    sources = planted_pages(spark, sf_dir)
    plans = fixes.plan_fixes(planted_issues(sources), sources).filter("status in ('skipped', 'ambiguous')")
    seq = F.regexp_extract("path", r"(\d+)", 1).cast("long") * 100 + F.col("seq")
    return reports.skipped_fixes(plans.select(seq.alias("seq"), F.col("rule_id").alias("rule"), "reason")).select("rule", "n", "first")


def pages_with_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that have a critical issue."""
    return reports.with_issues(_pages(spark, sf_dir).select(F.col("url").alias("source")), _issues(spark, sf_dir).filter("severity = 'critical'"))


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object of counts by severity and category."""
    return reports.audit_summary(_issues(spark, sf_dir))


def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: one JSON object of findings, files and distinct findings."""
    return reports.scan_counts(_findings(spark, sf_dir))


def finding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object for each finding, public columns only."""
    return reports.finding_lines(_findings(spark, sf_dir).select("file", "offset", "detector", "confidence", "line", F.lit(1).alias("_span")))


def file_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its issues, worst first."""
    out = reports.file_map(_pages(spark, sf_dir).select(F.col("url").alias("source")), _issues(spark, sf_dir).filter("severity <> 'minor'"))
    return out.select("source", F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["severity"], i["rule_id"])), ",").alias("issues"))


def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues with their rank, worst first."""
    return reports.report_order(_issues(spark, sf_dir).select("page_id", "rule_id", "severity", "category", F.col("source").alias("location")))


def report_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: which list of the report each finding stands in."""
    f = _findings(spark, sf_dir)
    return f.select("block_id", reports.kind_of_copy(F.col("explanation"), F.col("source")).alias("kind"))


def briefing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidates as rows of a briefing."""
    return reports.briefing(_docs(spark, sf_dir).select(F.col("source").alias("file"), F.col("doc_id").alias("line"), "text", F.round(F.length("text") / (F.length("text") + 1000.0), 3).alias("score"), F.col("lang").alias("explanation")))


def slowest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest pages of each host, as the slowest resources of a page."""
    return reports.slowest(_pages(spark, sf_dir).select(T.host_key(F.col("url")).alias("source"), F.col("page_id").alias("name"), F.length("html").cast("long").alias("duration")))


def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 turns of each role, as runs."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return reports.history_tail(c.select(F.col("role").alias("root"), F.lit("scan").alias("mode"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq")))


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that differ from the last run's, when only those of over 500 characters were the same."""
    files = _docs(spark, sf_dir).select(F.col("doc_id").alias("path"), "text")
    before = files.withColumn("text", F.when(F.length("text") > 500, F.col("text")).otherwise(F.concat(F.lit("old "), F.coalesce("text", F.lit("")))))
    return reports.changed_files(files, reports.file_state(before)).select("path")


#: Messages by rule: of every rule in English but every fifth, of every third in Italian, made from its name.
TEMPLATES = [(r[0], lang, f"{word} {r[0].replace('-', ' ')}") for i, r in enumerate(audit.RULES) for lang, word, on in (("en", "Check", i % 5), ("it", "Controlla", not i % 3)) if on]


def worded_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each issue's rule in words, Italian where known, else English, else the key: how often each message is given."""
    known = spark.createDataFrame(TEMPLATES, "key string, language string, template string")
    return reports.worded(_issues(spark, sf_dir).select("rule_id"), known, "it").groupBy("rule_id", "message").agg(F.count("*").alias("n"))


def review_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RA1: wording of links and headings of every page, with what follows a heading. The order inside pages is beyond SQL; see the tests."""
    return review.review_candidates(settle(nodes(_pages(spark, sf_dir).select(F.col("page_id").alias("doc_id"), "html"), "doc_id", "html")))


QUERIES = {
    f.__name__: f
    for f in (
        visible_text, marker_split, offline_findings, detector_comparison, best_scores, coverage_totals, judged_findings, unjudged_findings, skipped_fixes, pages_with_issues, audit_summary, scan_counts,
        finding_lines, file_map, report_order, report_lists, briefing_rows, slowest_pages, history_tail, changed_files, worded_issues, review_candidates,
    )
}

_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'serious' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END"
SQL = {
    "visible_text": rf"SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN regexp_matches(c, '[\p{{C}}\p{{Z}}]') AND c <> ' ' THEN format('<U+{{:04X}}>', unicode(c)) ELSE c END), '')) AS text_md5 FROM {SQL_ODD}",
    "marker_split": r"""WITH t AS (SELECT doc_id, coalesce(source, 'none') AS s, regexp_replace(text, '^\s+|\s+$', '', 'g') AS p FROM documents)
        SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND p <> '' THEN md5(p) END AS first_md5, CASE WHEN doc_id % 3 <> 0 AND p <> '' THEN s || ' <<<2>>>' END AS second FROM t""",
    "detector_comparison": f"""SELECT detector, count(*) FILTER (c) AS total, round(coalesce(avg(score) FILTER (c), 0), 6) AS mean_score, coalesce(max(score) FILTER (c), 0) AS max_score
        FROM (SELECT *, confidence <> 'low' AND source <> 'characters' AS c FROM {SQL_FINDINGS}) GROUP BY detector""",
    "best_scores": f"SELECT l.doc_id AS block_id, coalesce(max(score), 0) AS score FROM labels l LEFT JOIN (SELECT * FROM {SQL_FINDINGS} WHERE confidence <> 'low') f ON f.block_id = l.doc_id GROUP BY 1",
    "coverage_totals": """WITH w AS (SELECT coalesce(lang, '-') AS root, count(*) AS n, sum(length(text)) AS b, count(*) FILTER (length(text) < 300) AS s FROM documents GROUP BY 1)
        SELECT sum(n)::BIGINT AS files_read, sum(b)::BIGINT AS blocks_found, sum(s)::BIGINT AS skipped_ignored, coalesce(string_agg(root, ',' ORDER BY root) FILTER (n > 200), '') AS truncated FROM w""",
    "judged_findings": f"""WITH j AS (SELECT doc_id AS block_id, 1 - min(quality) * 0.75::DOUBLE AS s FROM labels GROUP BY 1)
        SELECT block_id, "offset", round(CASE WHEN s IS NULL THEN score ELSE greatest(score, s) END, 6) AS score, CASE WHEN s IS NULL THEN source ELSE 'agent+offline' END AS source,
        CASE WHEN s IS NULL THEN explanation ELSE printf('agent: labelled (score=%.2f); offline: %s', s, coalesce(explanation, '')) END AS explanation
        FROM {SQL_FINDINGS} LEFT JOIN j USING (block_id) WHERE greatest(score, coalesce(s, 0)) >= 0.33""",
    "unjudged_findings": f"SELECT count(*) AS n, 0::BIGINT AS more, 'an ellipsis' AS reasons FROM documents WHERE contains(text || ' ' || ({_list(ODD)})[1 + doc_id % {len(ODD)}], '…')",
    "skipped_fixes": """WITH i AS (SELECT page_id * 100 + s AS seq, rule FROM pages, (VALUES (4, 'image-alt'), (7, 'image-alt'), (8, 'control-name'), (9, 'x'), (10, 'table-headers')) v(s, rule)),
        r AS (SELECT seq, rule, seq % 100 AS why FROM i), s AS (SELECT DISTINCT rule, why FROM (SELECT * FROM r ORDER BY seq LIMIT 40))
        SELECT rule, count(*) AS n, min(seq) AS first FROM r JOIN s USING (rule, why) GROUP BY rule, why""",
    "pages_with_issues": f"SELECT url AS source FROM pages WHERE url IN (SELECT source FROM {SQL_ISSUES} WHERE severity = 'critical')",
    "audit_summary": f"""SELECT to_json({{'total': count(*), 'severities': {{{", ".join(f"'{s}': count(*) FILTER (severity = '{s}')" for s in SEVERITIES)}}},
        'categories': {{{", ".join(f"'{c.replace('-', '_')}': count(*) FILTER (category = '{c}')" for c in reports.CATEGORIES)}}}}})::VARCHAR AS summary FROM {SQL_ISSUES}""",
    "scan_counts": f"""SELECT to_json({{'total': count(*), 'files': count(DISTINCT file), 'distinct': count(DISTINCT (text, replacement, explanation))}})::VARCHAR AS counts FROM {SQL_FINDINGS}""",
    "finding_lines": f"""SELECT '{{' || array_to_string([CASE WHEN file IS NOT NULL THEN '"file":' || to_json(file)::VARCHAR END, '"offset":' || "offset", CASE WHEN detector IS NOT NULL THEN '"detector":' || to_json(detector)::VARCHAR END,
        '"confidence":"' || confidence || '"', CASE WHEN line IS NOT NULL THEN '"line":' || line END], ',') || '}}' AS value FROM {SQL_FINDINGS}""",
    "file_map": f"""WITH i AS (SELECT *, {_RANK} AS r FROM {SQL_ISSUES} WHERE severity <> 'minor'), g AS (SELECT source, string_agg(severity || ':' || rule_id, ',' ORDER BY r, rule_id) AS issues FROM i GROUP BY 1)
        SELECT DISTINCT url AS source, coalesce(issues, '') AS issues FROM pages LEFT JOIN g ON g.source = url""",
    "report_order": f"SELECT page_id, rule_id, severity, category, source AS location, least({_RANK}, 3) AS rank FROM {SQL_ISSUES}",
    "report_lists": f"SELECT block_id, CASE WHEN source = 'characters' THEN 'typography' ELSE 'style' END AS kind FROM {SQL_FINDINGS}",
    "briefing_rows": """SELECT source AS file, doc_id AS line, text[1:200] AS text, coalesce(s, 0) AS score, CASE WHEN s >= 0.5 THEN 'medium' ELSE 'low' END AS confidence, lang AS explanation
        FROM (SELECT *, round(length(text) / (length(text) + 1000)::DOUBLE, 3) AS s FROM documents)""",
    "slowest_pages": rf"""SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS source, page_id AS name, length(html) AS duration, row_number() OVER (PARTITION BY source ORDER BY duration DESC, name) AS rank FROM pages QUALIFY rank <= 5""",
    "history_tail": "SELECT role AS root, 'scan' AS mode, conv_id * 1000 + turn AS seq FROM conversations QUALIFY row_number() OVER (PARTITION BY role ORDER BY seq DESC) <= 20",
    "changed_files": "SELECT doc_id AS path FROM documents WHERE text IS NULL OR length(text) <= 500",
    "worded_issues": f"""WITH t(key, language, template) AS (VALUES {", ".join(str(t) for t in TEMPLATES)}), i AS (SELECT rule_id, count(*) AS n FROM {SQL_ISSUES} GROUP BY 1)
        SELECT rule_id, coalesce((SELECT template FROM t WHERE key = rule_id AND language = 'it'), (SELECT template FROM t WHERE key = rule_id AND language = 'en'), rule_id) AS message, n FROM i""",
}
