"""Queries that call detectors by name, match judgments, audit source files and plan fixes, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import CLICHES, INVISIBLE, SPACES, TYPOGRAPHY
from ..operators import agents, code_blocks, findings, fixes, fragments, matching, registry, reports
from ..sources import payloads
from .rule_queries import RULE_PARTS, audited
from .text_queries import SQL_LANGUAGE, SQL_ODD, SQL_PHRASED, _docs, _sql_cliches, _with_odd, _with_phrases


class Euro(registry.BlockDetector):
    """Counts euros, and can't stand a text with an ellipsis."""

    name = "euro"

    def spans(self, text, language):  # noqa: ANN001, ANN201
        if "…" in text:
            raise ValueError("an ellipsis")
        at = text.find("€")
        while at >= 0:
            yield at, at + 1, 0.7, "euro"
            at = text.find("€", at + 1)


def detector_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.13.2: detectors called by SQL over all texts, one of them failing on some: rows, distinct findings and errors by detector."""
    known = registry.default_registry()
    known.register("euro", Euro)
    known.install(spark)
    phrased = _with_phrases(_docs(spark, sf_dir)).select(F.col("doc_id").alias("block_id"), "text", F.coalesce(T.guess_language_or_null(F.col("text")), F.lit("en")).alias("language_hint"))
    phrased.createOrReplaceTempView("_phrased_blocks")
    _with_odd(_docs(spark, sf_dir)).select(F.col("doc_id").alias("block_id"), "text").createOrReplaceTempView("_odd_blocks")
    return spark.sql("""
        WITH found AS (
          SELECT * FROM detect_phrases(TABLE(_phrased_blocks)) UNION ALL SELECT * FROM detect_characters(TABLE(_odd_blocks)) UNION ALL SELECT * FROM detect_euro(TABLE(_odd_blocks))
        )
        SELECT detector, count(DISTINCT block_id) AS blocks, count(DISTINCT block_id, explanation) AS kinds, count(error) AS errors,
               sum(CASE WHEN detector <> 'phrases' AND error IS NULL THEN `end` - start ELSE 0 END) AS chars
        FROM found GROUP BY detector""")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select(F.col("doc_id").alias("seq"), F.concat(F.lit("b"), F.col("doc_id")).alias("block_id"), F.concat(F.lit("/srv/"), "lang", F.lit("/"), "source", F.lit(".md")).alias("file"), (F.col("doc_id") % 7).cast("int").alias("line"), "text")


def judgment_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What labels say of texts, handed back by id, by file, line and wording, by line alone, or by wording alone; copies get one each."""
    said = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("seq")).distinct().join(_docs(spark, sf_dir).withColumnRenamed("doc_id", "seq"), "seq")
    way = F.col("seq") % 4
    judged = said.select(
        "seq", F.when(way == 0, F.concat(F.lit("b"), "seq")).when(way == 1, "an old one").alias("block_id"), F.when(way.isin(1, 3), F.concat("source", F.lit(".md"))).alias("file"),
        F.when(way.isin(1, 3), (F.col("seq") % 7).cast("string")).alias("line"), F.when(way.isin(1, 2), F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  ")))).alias("text"),
    )
    return matching.match_judgments(_blocks(spark, sf_dir), judged)


# What stands in a file beside a page's own text, by page_id: a component, a template, a page, a test.
_FILES = [("ui/panel{}.tsx", '<img src="a.png">'), ("ui/card{}.vue", '<!-- <img> is replaced --><img src="b.png"><a href="/x" target="_blank">x</a>'), ("site/p{}.html", '<img src="c.png"><button></button>'), ("ui/card.test{}.vue", "<img>")]


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of source files: a line of comment, the planted markup, the page's first heading in a paragraph."""
    p, k = spark.read.parquet(f"{sf_dir}/pages.parquet"), F.col("page_id") % len(_FILES)
    pick = lambda i: F.get(F.array(*[F.lit(f[i]) for f in _FILES]), k)
    heading = F.regexp_extract("html", r"<h1[^>]*>([^<]*)</h1>", 1)
    return p.select(F.replace(pick(0), F.lit("{}"), F.col("page_id").cast("string")).alias("path"), F.concat(F.lit("<!-- about <img> -->\n"), pick(1), F.lit("\n<p>"), heading, F.lit("</p>")).alias("text"))


def source_file_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11, RA3, X11: issues of three element rules over source files; components and tests aren't audited, comments don't count."""
    found = fragments.audit_files(_site(spark, sf_dir)).filter("rule_id in ('image-alt', 'bp-target-blank', 'control-name', 'bp-doctype')")
    return found.select("source", "rule_id", "line", "snippet")


def source_file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy, strings and notes of source files made of each text's first words, by kind, with their lines."""
    d = _docs(spark, sf_dir)
    words = F.array_join(F.slice(F.filter(F.split(F.regexp_replace("text", r"[^a-zA-Z ]", " "), " +"), lambda w: w != ""), 1, 8), " ")
    seen = d.withColumn("w", words).filter(F.length("w") > 50)
    page = F.concat(F.lit("<div>\n<p>"), "w", F.lit("</p>\n<!-- <p>"), "w", F.lit('</p> -->\n<img alt="'), "w", F.lit('">\n<script>var x = "nothing here";</script></div>\n'))
    files = seen.select(F.concat(F.lit("a/f"), "doc_id", F.lit(".html")).alias("path"), page.alias("text"))
    code = seen.select(F.concat(F.lit("b/m"), "doc_id", F.lit(".py")).alias("path"), F.concat(F.lit("import os\n\n# "), "w", F.lit(" and so on\nlabel = \""), "w", F.lit('"\nkey = "some_key"\n')).alias("text"))
    found = code_blocks.code_blocks(files).unionByName(code_blocks.code_blocks(code, "both"))
    return found.select("path", "kind", "line", F.col("start").cast("long").alias("start"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def fixed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted defects of every page as issues, planned on its source and made; the new page and what became of each issue."""
    sources = planted_pages(spark, sf_dir)
    plans = fixes.plan_fixes(planted_issues(sources), sources)
    made, outcomes = fixes.apply_fixes(plans, sources)
    told = outcomes.groupBy("path").agg(*[F.count_if(F.col("outcome") == o).alias(o.replace("-", "_")) for o in ("applied", "needs-input", "ambiguous", "skipped")])
    return made.join(told, "path").select("path", F.md5(F.col("text").cast("binary")).alias("text_md5"), "applied", "needs_input", "ambiguous", "skipped")


#: Written before each page's end: three images on a line, of which the middle one lacks its alt, two equal ones, a heading, a link.
_PLANTED = '\n<img src="a.png" alt="a"><img src="b.png"><img src="c.png" alt="c">\n<img src="d.png"><img src="d.png">\n<h5 class="q">Too <b>deep</b></h5>\n<a href="/out" target="_blank">out</a>\n'


def planted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select(F.concat(F.lit("site/"), "page_id", F.lit(".html")).alias("path"), F.concat(F.regexp_replace("html", "(?i)^\\s*<!doctype[^>]*>", ""), F.lit(_PLANTED)).alias("text"))


def planted_issues(sources: DataFrame) -> DataFrame:
    """Issues as an audit gives them: by line and snippet, some from other engines, some on lines that have moved."""
    rows = [
        (1, "bp-doctype", "static", 0, "<html>", "<!DOCTYPE html>"), (2, "perf-image-loading", "static", 1, '<img src="b.png">', '<img src="b.png" loading="lazy">'), (3, "image-alt", "static", 1, '<img src="c.png">', '<img src="c.png" alt="">'),
        (4, "image-alt", "static", 2, '<img src="d.png">', '<img src="d.png" alt="">'), (5, "heading-order", "static", 9, '<h5 class="q">', "<h2>Too deep</h2>"), (6, "bp-target-blank", "static", 2, '<a href="/out">', '<a href="/out" target="_blank" rel="noopener noreferrer">'),
        (7, "image-alt", "axe", 1, "<img>", '<img alt="">'), (8, "control-name", "static", 1, "<button>", None), (9, "x", "static", 4, '<a target="_blank">', '<a href="/else">'), (10, "table-headers", "static", 1, '<table id="none">', "<table>"),
    ]
    issues = sources.sparkSession.createDataFrame(rows, "seq long, rule_id string, engine string, off int, snippet string, fix_snippet string")
    first = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1 - (len(_PLANTED) - len(_PLANTED.replace("\n", "")))).alias("first")
    return sources.select("path", first).join(F.broadcast(issues)).select("path", "seq", "rule_id", "engine", (F.col("first") + F.col("off")).alias("line"), "snippet", "fix_snippet")  # ten rows


def agent_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose phrases weigh enough, as an agent is handed them."""
    texts = _with_phrases(_docs(spark, sf_dir)).select(F.col("doc_id").alias("block_id"), "text", F.coalesce(T.guess_language_or_null(F.col("text")), F.lit("en")).alias("language_hint"), F.lit("f").alias("file"), F.lit(1).alias("line"))
    spans = registry.default_registry().run(texts, "phrase-load")
    found = agents.candidates(texts, spans)
    lines = agents.payload_lines(found).select(F.get_json_object("value", "$.block_id").cast("long").alias("block_id"), F.get_json_object("value", "$.offline_score").cast("double").alias("score"), F.get_json_object("value", "$.language").alias("language"), F.md5(F.get_json_object("value", "$.text").cast("binary")).alias("text_md5"))
    return lines


def browser_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's own issues about an image with a browser engine's report on the same one; every fifth audit failed."""
    own = audited(spark, sf_dir).filter("rule_id in ('image-alt', 'button-type')").select(F.monotonically_increasing_id().alias("seq"), F.col("doc_id").cast("string").alias("source"), "rule_id", "engine", "severity", "selector", "snippet")
    # A page is its id: two may share a url.
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("source"), F.col("page_id").alias("k"))
    payload = pages.select("source", F.lit('{"violations":[{"id":"image-alt","impact":"critical","help":"h","nodes":[{"target":"img","html":"<img src=\\"a.png\\">"}]}]}').alias("payload"))
    found = payloads.axe_issues(payload).select((F.lit(1 << 60) + F.monotonically_increasing_id()).alias("seq"), "source", "rule_id", "engine", "severity", "selector", "snippet")
    audits = pages.select("source", F.when(F.col("k") % 5 == 0, "timeout").alias("error"))
    none = spark.createDataFrame([], "source string, key string, n long")
    merged, failed = findings.with_browser(own, audits, found, none)
    told = merged.groupBy("rule_id", "engine", F.array_join("also_found_by", ",").alias("also")).agg(F.count("*").alias("n"))
    return told.unionByName(failed.groupBy(F.lit("").alias("rule_id"), F.lit("").alias("engine"), F.col("error").alias("also")).agg(F.count("*").alias("n")))


def review_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty texts whose phrases weigh most (a report's own limit), and whether they are in the gray zone."""
    texts = _with_phrases(_docs(spark, sf_dir)).select(F.col("doc_id").alias("block_id"), "text", F.lit("en").alias("language_hint"))
    top = findings.top_findings(registry.default_registry().run(texts, "phrase-load"), 20)
    return findings.review_band(top).select("block_id", F.round("score", 6).alias("score"), F.col("needs_review").alias("gray"))


def counted_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts each source has, with the noun that agrees, in Ukrainian and Italian."""
    n = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", "n", reports.plural(F.col("n"), "uk", "документ", "документи", "документів").alias("uk"), reports.plural(F.col("n"), "it", "documento", "documenti").alias("it"))


QUERIES = {f.__name__: f for f in (detector_calls, judgment_matches, source_file_audit, source_file_blocks, fixed_pages, agent_candidates, browser_merge, review_pool, counted_nouns)}

_quoted = lambda c: f"'{chr(c)}'"
CLASS = "[" + "".join(dict.fromkeys([*map(chr, INVISIBLE), *map(chr, SPACES), *TYPOGRAPHY])) + "]"
KIND = f"CASE WHEN x IN ({', '.join(_quoted(c) for c in INVISIBLE)}) THEN 'invisible' WHEN x IN ({', '.join(_quoted(c) for c in SPACES)}) THEN 'space' ELSE 'typography' END"
_WORDY = lambda c: c.isalnum() or c == "_"
_LEX = ", ".join(
    "('{}', '(?i){}{}{}', {})".format(p.replace("'", "''"), r"(^|[^\p{L}\p{N}_])" if _WORDY(p[0]) else "", "".join(rf"\{c}" if not (c.isalnum() or c in " _") and ord(c) < 128 else c for c in p).replace("'", "''"), r"($|[^\p{L}\p{N}_])" if _WORDY(p[-1]) else "", 0.3 if " " in p else 0.1)
    for p in dict.fromkeys(CLICHES["en"])
)
SQL = {
    "detector_calls": f"""
WITH hits AS ({_sql_cliches()}), p AS (SELECT doc_id, unnest(string_split(phrases, '|')) AS phrase FROM hits WHERE phrases <> ''),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '{CLASS}+')) AS run FROM {SQL_ODD}),
kinds AS (SELECT doc_id, run, array_to_string(list_sort(list_distinct(list_transform(string_split(run, ''), lambda x: {KIND}))), ',') AS kind FROM runs),
euros AS (SELECT doc_id, contains(text, '…') AS bad, length(text) - length(replace(text, '€', '')) AS n FROM {SQL_ODD})
SELECT 'phrases' AS detector, count(DISTINCT doc_id) AS blocks, count(*) AS kinds, 0::BIGINT AS errors, 0::BIGINT AS chars FROM p
UNION ALL SELECT 'odd-characters', count(DISTINCT doc_id), count(DISTINCT (doc_id, kind)), 0, sum(length(run))::BIGINT FROM kinds
UNION ALL SELECT 'euro', count(*), count(*), count(*) FILTER (bad), coalesce(sum(n) FILTER (NOT bad), 0)::BIGINT FROM euros WHERE bad OR n > 0
""",
    "judgment_matches": r"""
WITH b AS (SELECT doc_id AS seq, source || '.md' AS base, doc_id % 7 AS line, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents),
j AS (SELECT b.* FROM b WHERE seq IN (SELECT doc_id FROM labels)),
m1 AS (SELECT seq AS bs, seq AS js FROM j WHERE seq % 4 = 0),
b2 AS (SELECT * FROM b WHERE seq NOT IN (SELECT bs FROM m1)),
m2 AS (SELECT x.seq AS bs, y.seq AS js FROM (SELECT *, row_number() OVER (PARTITION BY base, line, text ORDER BY seq) AS r FROM b2 WHERE text <> '') x
  JOIN (SELECT *, row_number() OVER (PARTITION BY base, line, text ORDER BY seq) AS r FROM j WHERE seq % 4 = 1 AND text <> '') y USING (base, line, text, r)),
b3 AS (SELECT * FROM b2 WHERE seq NOT IN (SELECT bs FROM m2)),
m3 AS (SELECT x.seq AS bs, y.seq AS js FROM (SELECT *, row_number() OVER (PARTITION BY base, line ORDER BY seq) AS r FROM b3) x
  JOIN (SELECT *, row_number() OVER (PARTITION BY base, line ORDER BY seq) AS r FROM j WHERE seq % 4 = 3 OR seq % 4 = 1 AND text = '') y USING (base, line, r)),
b4 AS (SELECT * FROM b3 WHERE seq NOT IN (SELECT bs FROM m3)),
m4 AS (SELECT x.seq AS bs, y.seq AS js FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY seq) AS r FROM b4 WHERE text <> '') x
  JOIN (SELECT *, row_number() OVER (PARTITION BY text ORDER BY seq) AS r FROM j WHERE text <> '' AND (seq % 4 = 2 OR seq % 4 = 1 AND seq NOT IN (SELECT js FROM m2))) y USING (text, r))
SELECT bs AS block_seq, js AS judgment_seq, 'id' AS tier FROM m1 UNION ALL SELECT bs, js, 'origin' FROM m2 UNION ALL SELECT bs, js, 'line' FROM m3 UNION ALL SELECT bs, js, 'text' FROM m4
""",
    "source_file_audit": """
SELECT 'ui/card' || page_id || '.vue' AS source, v.rule_id, 2 AS line, v.snippet FROM pages, (VALUES ('image-alt', '<img src="b.png">'), ('bp-target-blank', '<a href="/x" target="_blank">')) v(rule_id, snippet) WHERE page_id % 4 = 1
UNION ALL SELECT 'site/p' || page_id || '.html', v.rule_id, 2, v.snippet FROM pages, (VALUES ('image-alt', '<img src="c.png">'), ('control-name', '<button>')) v(rule_id, snippet) WHERE page_id % 4 = 2
""",
    "source_file_blocks": r"""
WITH w AS (SELECT doc_id, array_to_string(list_filter(string_split_regex(regexp_replace(text, '[^a-zA-Z ]', ' ', 'g'), ' +'), lambda x: x <> '')[1:8], ' ') AS w FROM documents), s AS (SELECT * FROM w WHERE length(w) > 50)
SELECT 'a/f' || doc_id || '.html' AS path, 'markup' AS kind, 2 AS line, 9::BIGINT AS start, md5(w) AS text_md5 FROM s
UNION ALL SELECT 'a/f' || doc_id || '.html', 'injected', 4, 41 + 2 * length(w), md5(w) FROM s
UNION ALL SELECT 'b/m' || doc_id || '.py', 'technical', 3, 13, md5(w || ' and so on') FROM s
UNION ALL SELECT 'b/m' || doc_id || '.py', 'injected', 4, 33 + length(w), md5(w) FROM s
""",
    "fixed_pages": f"""
WITH s AS (SELECT page_id, regexp_replace(html, '(?i)^\\s*<!doctype[^>]*>', '') AS html FROM pages)
SELECT 'site/' || page_id || '.html' AS path,
       md5('<!DOCTYPE html>' || chr(10) || html || replace(replace(replace('{_PLANTED}', '<img src="b.png">', '<img src="b.png" loading="lazy">'), '<h5 class="q">Too <b>deep</b></h5>', '<h2>Too deep</h2>'), '<a href="/out" target="_blank">', '<a href="/out" target="_blank" rel="noopener noreferrer">')) AS text_md5,
       4::BIGINT AS applied, 1::BIGINT AS needs_input, 1::BIGINT AS ambiguous, 4::BIGINT AS skipped
FROM s
""",
    "agent_candidates": f"""
WITH hits AS ({_sql_cliches()}), w AS (SELECT doc_id, round(1 - exp(sum(ln(CASE WHEN contains(p, ' ') THEN 0.7 ELSE 0.9 END))), 3) AS s FROM (SELECT doc_id, unnest(string_split(phrases, '|')) AS p FROM hits WHERE phrases <> '') GROUP BY doc_id)
SELECT doc_id AS block_id, s AS score, coalesce({SQL_LANGUAGE}, 'en') AS language, md5(text) AS text_md5 FROM w JOIN {SQL_PHRASED} USING (doc_id) WHERE s >= 0.25""",
    "browser_merge": f"""
WITH {RULE_PARTS}, i AS (SELECT page_id, contains(h, '<img src="a.png">') AS own, page_id % 5 <> 0 AS seen, (SELECT n FROM counted c WHERE c.page_id = p.page_id AND rule_id = 'image-alt') AS alts, (SELECT n FROM counted c WHERE c.page_id = p.page_id AND rule_id = 'button-type') AS types FROM p)
SELECT 'image-alt' AS rule_id, 'static' AS engine, 'axe' AS also, count(*) AS n FROM i WHERE own AND seen HAVING count(*) > 0
UNION ALL SELECT 'image-alt', 'static', '', sum(alts - CASE WHEN own AND seen THEN 1 ELSE 0 END)::BIGINT FROM i HAVING sum(alts - CASE WHEN own AND seen THEN 1 ELSE 0 END) > 0
UNION ALL SELECT 'button-type', 'static', '', sum(types)::BIGINT FROM i HAVING sum(types) > 0
UNION ALL SELECT 'axe:image-alt', 'axe', '', count(*) FROM i WHERE NOT own AND seen HAVING count(*) > 0
UNION ALL SELECT '', '', 'timeout', count(*) FROM i WHERE NOT seen HAVING count(*) > 0""",
    "review_pool": f"""
WITH f AS (SELECT doc_id, phrase, weight FROM (WITH t AS (SELECT doc_id, text FROM {SQL_PHRASED}), lex(phrase, pattern, weight) AS (VALUES {_LEX}) SELECT doc_id, phrase, weight FROM t JOIN lex ON contains(lower(t.text), lower(phrase)) AND regexp_matches(t.text, pattern)))
SELECT doc_id AS block_id, round(1 - exp(sum(ln(1 - weight))), 6) AS score, score >= 0.30 AND score < 0.50 AS gray FROM f GROUP BY doc_id ORDER BY score DESC, block_id LIMIT 20""",
    "counted_nouns": """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT source, n, CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN 'документ' WHEN n % 10 BETWEEN 2 AND 4 AND n % 100 NOT BETWEEN 12 AND 14 THEN 'документи' ELSE 'документів' END AS uk, CASE WHEN n = 1 THEN 'documento' ELSE 'documenti' END AS it FROM c""",
}
