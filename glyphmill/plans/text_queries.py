"""Queries on texts, with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import CLICHES, ITALIAN_MARKERS, SPACES, TYPOGRAPHY
from ..functions.text import _abbreviations
from ..operators import characters, edits, findings, similarity, style
from ..functions.suggestions import SUGGESTIONS


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


# The tables hold neither phrases nor odd characters, so queries about them write some into every text, by doc_id.
PHRASES = [
    " Furthermore, it is important to note the seamless integration.",
    " It's not just fast, but reliable. In conclusion, the game changer.",
    " Plain words stand here.",
]
ODD = ["a​b  c — d…", "“x” ‘y’ 1€", "pаss а word", "no odd ones"]


def _with_phrases(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.concat("text", F.get(F.array(*[F.lit(p) for p in PHRASES]), F.col("doc_id") % len(PHRASES))).alias("text"))


def _with_odd(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", F.concat("text", F.lit(" "), F.get(F.array(*[F.lit(p) for p in ODD]), F.col("doc_id") % len(ODD))).alias("text"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SQL_PHRASED = f"(SELECT doc_id, text || ({_list(PHRASES)})[1 + doc_id % {len(PHRASES)}] AS text FROM documents)"
SQL_ODD = f"(SELECT doc_id, lang, text || ' ' || ({_list(ODD)})[1 + doc_id % {len(ODD)}] AS text FROM documents)"
SQL_LANGUAGE = rf"""CASE
    WHEN length(regexp_replace(text, '[^А-Яа-яЇїІіЄєҐґ]', '', 'g')) / nullif(length(regexp_replace(text, '\P{{L}}', '', 'g')), 0)::DOUBLE >= 0.30 THEN 'uk'
    WHEN len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) < 5 THEN NULL
    WHEN regexp_matches(lower(' ' || text || ' '), ' ({"|".join(ITALIAN_MARKERS)}) ') THEN 'it' ELSE 'en' END"""


def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by script and marker words."""
    return _docs(spark, sf_dir).select("doc_id", T.guess_language(F.col("text")).alias("language"))


def majority_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent guess, per source."""
    d = _docs(spark, sf_dir).select("source", F.col("doc_id").alias("seq"), T.guess_language(F.col("text")).alias("language_hint"))
    return findings.majority_language(d, "source")


def _signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _docs(spark, sf_dir).select(F.col("doc_id").alias("block_id"), "text", F.lit(None).cast("string").alias("language_hint"))
    return style.signals(blocks)


def style_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, words and the three signals of every document; null where a text is too short to measure."""
    r = lambda c: F.round(c, 6).alias(c)
    return _signal_rows(spark, sf_dir).select(F.col("block_id").alias("doc_id"), "n_sentences", "n_words", r("uniformity"), r("repetition"), r("dashes"))


def _sql_unmark(lang: str | None) -> str:
    return rf"regexp_replace(m, '(^|[^\p{{L}}\p{{N}}''-])((?:{_abbreviations(lang)})\.)' || chr(57344), '\1\2', 'gi')"


SQL_SIGNALS = rf"""
marked AS (SELECT doc_id, text, {SQL_LANGUAGE} AS language, regexp_replace(text, '([.!?…])([ \t\n])', '\1' || chr(57344) || '\2', 'g') AS m FROM documents),
cut AS (SELECT doc_id, text, list_filter(list_transform(string_split(CASE language WHEN 'en' THEN {_sql_unmark("en")} WHEN 'it' THEN {_sql_unmark("it")} WHEN 'uk' THEN {_sql_unmark("uk")} ELSE {_sql_unmark(None)} END, chr(57344)), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')), lambda c: c <> '') AS s,
  regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_''’-]+') AS w FROM marked),
counted AS (SELECT *, list_filter(list_transform(s, lambda x: len(regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}_''’-]+'))::DOUBLE), lambda n: n > 0) AS n FROM cut),
signals AS (SELECT doc_id, len(s) AS n_sentences, len(w) AS n_words,
  CASE WHEN len(n) >= 3 THEN greatest(0, least(1, 1 - list_stddev_pop(n) / list_avg(n) / 0.6)) END AS uniformity,
  CASE WHEN len(w) >= 20 THEN greatest(0, least(1, (0.6 - len(list_distinct(w)) / len(w)::DOUBLE) / 0.35)) END AS repetition,
  CASE WHEN len(w) >= 15 THEN greatest(0, least(1, (length(regexp_replace(text, '[^—–]', '', 'g')) / len(w)::DOUBLE * 100 - 0.3) / 1.7)) END AS dashes FROM counted)"""


def style_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and confidence of every document from its signals alone, capped below the reporting line."""
    raw = T.combine_score(F.col("uniformity"), F.col("repetition"), F.col("dashes"), F.lit(False), F.array().cast("array<string>"))
    scored = _signal_rows(spark, sf_dir).withColumn("score", F.when(raw >= style.REPORT, style.CAP).otherwise(raw))
    return scored.select(F.col("block_id").alias("doc_id"), F.round("score", 6).alias("score"), T.confidence(F.col("score")).alias("confidence"))


SQL_SCORE = """coalesce((coalesce(uniformity, 0) * 0.40 + coalesce(repetition, 0) * 0.35 + coalesce(dashes, 0) * 0.25)
  / nullif(CASE WHEN uniformity IS NULL THEN 0 ELSE 0.40::DOUBLE END + CASE WHEN repetition IS NULL THEN 0 ELSE 0.35::DOUBLE END + CASE WHEN dashes IS NULL THEN 0 ELSE 0.25::DOUBLE END, 0), 0)"""


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and tenth of the raw score, totals by grouping sets."""
    raw = T.combine_score(F.col("uniformity"), F.col("repetition"), F.col("dashes"), F.lit(False), F.array().cast("array<string>"))
    rows = _signal_rows(spark, sf_dir).withColumn("tenth", F.floor(F.round(raw, 6) * 10))
    return rows.groupingSets([["language", "tenth"], ["tenth"], []], "language", "tenth").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def lexical_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct and all words of each source, words counted over its documents one by one."""
    w = T.words(F.col("text"))
    rows = _docs(spark, sf_dir).select("source", F.size(F.array_distinct(w)).alias("d"), F.size(w).alias("n"))
    return rows.groupBy("source").agg(F.sum("d").alias("distinct_words"), F.sum("n").alias("words"), F.round(F.sum("d") / F.sum("n"), 6).alias("ratio"))


def cliche_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases found in every text, as one string in the order of the lists."""
    docs = _with_phrases(_docs(spark, sf_dir)).withColumn("language", T.guess_language_or_null(F.col("text")))
    return docs.select("doc_id", F.array_join(style.cliches(F.col("text"), F.col("language")), "|").alias("phrases"))


def _sql_cliches() -> str:
    rows = []
    for lang in CLICHES:
        found = style._candidates(CLICHES, lang)
        for k, p in enumerate(found):
            word = lambda c: c.isalnum() or c == "_"
            body = "".join(rf"\{c}" if not (c.isalnum() or c in " _") and ord(c) < 128 else c for c in p)
            left = r"(^|[^\p{L}\p{N}_])" if word(p[0]) else ""
            right = r"($|[^\p{L}\p{N}_])" if word(p[-1]) else ""
            rows.append(f"('{lang}', {k}, '{p.replace(chr(39), chr(39) * 2)}', '(?i){left}{body.replace(chr(39), chr(39) * 2)}{right}')")
    return f"""
WITH lex(language, k, phrase, pattern) AS (VALUES {", ".join(rows)}),
docs AS (SELECT doc_id, text, lower(text) AS low, {SQL_LANGUAGE} AS language FROM {SQL_PHRASED}),
hits AS (SELECT doc_id, k, phrase FROM docs JOIN lex ON lex.language = coalesce(docs.language, 'en') WHERE CASE WHEN contains(low, phrase) THEN regexp_matches(text, pattern) ELSE false END)
SELECT doc_id, coalesce(string_agg(phrase, '|' ORDER BY k), '') AS phrases FROM docs LEFT JOIN hits USING (doc_id) GROUP BY doc_id"""


def style_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per sentence with offsets, phrases and constructions. Order inside texts is beyond SQL; see the tests."""
    blocks = _with_phrases(_docs(spark, sf_dir)).select(F.col("doc_id").alias("block_id"), "text", F.lit(None).cast("string").alias("language_hint"))
    found = style.style_findings(blocks)
    r = lambda c: F.round(c, 6).alias(c)
    return found.select(F.col("block_id").alias("doc_id"), "start", "end", r("score"), "confidence", F.array_join("structural", "|").alias("structural"), F.array_join("cliches", "|").alias("cliches"))


def first_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of each document that scores 0.25 or more."""
    blocks = _with_phrases(_docs(spark, sf_dir)).select(F.col("doc_id").alias("block_id"), "text", F.lit(None).cast("string").alias("language_hint"))
    return findings.first_per_block(style.style_findings(blocks)).select(F.col("block_id").alias("doc_id"), "start", "end", F.round("score", 6).alias("score"))


def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's ten highest scores."""
    blocks = _with_phrases(_docs(spark, sf_dir)).select(F.col("doc_id").alias("block_id"), "text", F.lit(None).cast("string").alias("language_hint"))
    found = style.style_findings(blocks).withColumn("score", F.round("score", 6))
    return findings.top_findings(found).select(F.col("block_id").alias("doc_id"), "start", "score")


def char_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters off the keyboard by class, of every text."""
    return _with_odd(_docs(spark, sf_dir)).select("doc_id", *[c.cast("long").alias(k) for k, c in characters.class_counts(F.col("text")).items()])


def _sql_class(chars: list[str]) -> str:
    return "length(regexp_replace(text, '[^" + "".join(rf"\x{{{ord(c):X}}}" for c in chars) + "]', '', 'g'))::BIGINT"


def character_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of odd characters with place, category, replacement and score; look-alikes by majority of script."""
    blocks = _with_odd(_docs(spark, sf_dir)).select(F.col("doc_id").alias("block_id"), "text", T.guess_language(F.col("text")).alias("language"))
    return characters.character_findings(blocks).select(F.col("block_id").alias("doc_id"), "start", "end", "original", "replacement", "category", "score", "confidence", "description")


def character_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`category: n` of each text."""
    blocks = _with_odd(_docs(spark, sf_dir)).select(F.col("doc_id").alias("block_id"), "text", T.guess_language(F.col("text")).alias("language"))
    return characters.summarize(characters.anomalies(blocks)).withColumnRenamed("block_id", "doc_id")


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with what has a replacement replaced."""
    blocks = _with_odd(_docs(spark, sf_dir)).select(F.col("doc_id").alias("block_id"), "text", F.lit("en").alias("language"))
    return characters.clean_text(blocks).select(F.col("block_id").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


def _sql_clean() -> str:
    out = "text"
    for ch, new in [*TYPOGRAPHY.items(), *[(chr(cp), " ") for cp in SPACES], ("​", ""), ("pаss", "pass")]:
        if any(ch in s for s in ODD):
            out = f"replace({out}, '{ch}', '{new.replace(chr(39), chr(39) * 2)}')"
    return f"SELECT doc_id, md5({out}) AS text_md5, length({out}) AS n_chars FROM {SQL_ODD}"


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offline rewriting of every text; null where nothing changes. Sequential, so it is tested on small texts."""
    tables = {lang: {p: r for p, r in t.items() if r is not None} for lang, t in SUGGESTIONS.items()}
    tail = F.get(F.array(*[F.lit(p.strip()) for p in PHRASES]), F.col("doc_id") % len(PHRASES))
    return _docs(spark, sf_dir).select("doc_id", edits.suggest(F.concat("text", F.lit(" "), tail), F.lit("en"), {"en": tables["en"]}).alias("suggestion"))


def missing_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases without an offline suggestion, by language; an anti-join of the two tables."""
    lexicon = spark.createDataFrame([(lang, p) for lang, ps in CLICHES.items() for p in dict.fromkeys(ps)], "language string, phrase string")
    known = spark.createDataFrame([(lang, p) for lang, t in SUGGESTIONS.items() for p in t], "language string, phrase string")
    return lexicon.join(known, ["language", "phrase"], "left_anti")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity, content hash and training half of every document."""
    return _docs(spark, sf_dir).select("doc_id", T.fingerprint(F.lit("style"), F.col("source"), F.col("text")).alias("fingerprint"), T.content_hash(F.col("text")).alias("content_hash"), T.training_half(F.col("text")).alias("train"))


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its place among those of equal text and language, and how many others there are."""
    rows = _docs(spark, sf_dir).select("doc_id", F.col("text"), F.lit(None).cast("string").alias("replacement"), F.col("lang").alias("source_kind"), F.lit("").alias("explanation"))
    keyed = rows.withColumn("text", F.xxhash64("text"))
    return findings.group_duplicates(keyed, order="doc_id").select("doc_id", F.col("copy").cast("long").alias("copy"), F.col("copies").alias("copies"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the style score against labels.quality (0 stands for model) at 0.10, 0.15 ... 0.65."""
    raw = T.combine_score(F.col("uniformity"), F.col("repetition"), F.col("dashes"), F.lit(False), F.array().cast("array<string>"))
    scored = _signal_rows(spark, sf_dir).select(F.col("block_id").alias("doc_id"), F.round(raw, 6).alias("score"))
    joined = scored.join(_table(spark, sf_dir, "labels"), "doc_id").withColumn("label", F.when(F.col("quality") == 0, "model").otherwise("human"))
    out = findings.rates(joined, [k / 20 for k in range(2, 14)])
    return out.select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "false_alarms", "humans", "models")


def score_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N, least, upper median and greatest score by label and language."""
    raw = T.combine_score(F.col("uniformity"), F.col("repetition"), F.col("dashes"), F.lit(False), F.array().cast("array<string>"))
    scored = _signal_rows(spark, sf_dir).select(F.col("block_id").alias("doc_id"), F.round(raw, 6).alias("score"))
    docs = _docs(spark, sf_dir).select("doc_id", "lang")
    return findings.score_spread(scored.join(_table(spark, sf_dir, "labels"), "doc_id").join(docs, "doc_id"), "quality", "lang")


def embedding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the stated reference corpus (ids divisible by 100; labels under 5 stand for model)."""
    v = _table(spark, sf_dir, "embeddings")
    refs = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("ref_id"), "embedding", F.when(F.col("label") < 5, "model").otherwise("human").alias("label"))
    out = similarity.scores(v.select("vec_id", "embedding"), refs)
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("ai_similarity", "human_similarity", "score")])


def role_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and greatest dash-free diversity by role of conversation turns."""
    w = T.words(F.col("text"))
    rows = _table(spark, sf_dir, "conversations").select("role", F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))
    return rows.groupBy("role").agg(F.count("*").alias("turns"), F.sum("n").alias("words"), F.max("n").alias("longest"), F.round(F.avg(F.try_divide(F.col("d").cast("double"), F.col("n").cast("double"))), 6).alias("diversity"))


def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of findings over the documents, merged by overlap; both are made from doc_id and length."""
    d = _docs(spark, sf_dir).select("doc_id", F.length("text").alias("n"))
    offline = d.select(F.col("doc_id").alias("block_id"), F.explode(F.array(F.struct(F.lit(0).alias("start"), F.lit(10).alias("end"), (F.col("doc_id") % 10 / 10).alias("score")), F.struct(F.lit(20).alias("start"), F.lit(30).alias("end"), F.lit(0.5).alias("score")))).alias("x"), F.when(F.col("doc_id") % 7 == 0, "characters").otherwise("style").alias("kind")).select("block_id", "x.*", "kind")
    judged = d.filter("n > 12").select(F.col("doc_id").alias("block_id"), F.posexplode(F.array(F.struct(F.lit(5).alias("start"), F.lit(25).alias("end"), (F.col("doc_id") % 4 / 4).alias("score")), F.struct(F.lit(22).alias("start"), F.lit(28).alias("end"), F.lit(0.9).alias("score")))).alias("seq", "x"), F.lit(None).cast("string").alias("error")).select("block_id", "seq", "x.*", "error")
    return findings.merge_hybrid(offline, judged).select("block_id", "start", "end", F.round("score", 6).alias("score"), "kind", "agreement")


SQL_HYBRID = """
WITH d AS (SELECT doc_id AS block_id, length(text) AS n FROM documents),
o AS (SELECT block_id, 0 AS s, 10 AS e, (block_id % 10) / 10.0::DOUBLE AS score, CASE WHEN block_id % 7 = 0 THEN 'characters' ELSE 'style' END AS kind FROM d
  UNION ALL SELECT block_id, 20, 30, 0.5::DOUBLE, CASE WHEN block_id % 7 = 0 THEN 'characters' ELSE 'style' END FROM d),
m AS (SELECT block_id, 0 AS seq, 5 AS s, 25 AS e, (block_id % 4) / 4.0::DOUBLE AS score FROM d WHERE n > 12 UNION ALL SELECT block_id, 1, 22, 28, 0.9::DOUBLE FROM d WHERE n > 12),
st AS (SELECT * FROM o WHERE kind = 'style' AND score >= 0.33),
met AS (SELECT st.block_id, st.s, st.e, st.score, min(seq) AS seq FROM st JOIN m ON st.block_id = m.block_id AND m.s < st.e AND st.s < m.e GROUP BY ALL),
best AS (SELECT block_id, seq, max(score) AS b FROM met GROUP BY ALL)
SELECT m.block_id, m.s AS start, m.e AS "end", round(greatest(m.score, coalesce(b, m.score)), 6) AS score, 'judge' AS kind, CASE WHEN b IS NULL THEN 'model-only' ELSE 'both' END AS agreement FROM m LEFT JOIN best USING (block_id, seq)
UNION ALL SELECT block_id, s, e, round(score, 6), kind, 'offline-only' FROM st WHERE (block_id, s) NOT IN (SELECT (block_id, s) FROM met)
UNION ALL SELECT block_id, s, e, round(score, 6), kind, NULL FROM o WHERE NOT (kind = 'style' AND score >= 0.33)"""


QUERIES = {
    f.__name__: f
    for f in (
        style_scores, language_guess, majority_language, style_signals, score_histogram, lexical_diversity, cliche_hits, style_findings, first_candidates, top_findings,
        char_class_counts, character_findings, character_summary, clean_text, suggestions, missing_suggestions, fingerprints, duplicate_groups, threshold_sweep, score_spread,
        embedding_scores, role_style, hybrid_merge,
    )
}
SQL = {
    "language_guess": f"SELECT doc_id, coalesce({SQL_LANGUAGE}, 'en') AS language FROM documents",
    "majority_language": f"""WITH g AS (SELECT source, coalesce({SQL_LANGUAGE}, 'en') AS g, doc_id FROM documents), c AS (SELECT source, g, count(*) AS n, min(doc_id) AS f FROM g GROUP BY ALL)
        SELECT source, first(g ORDER BY n DESC, f) AS language FROM c GROUP BY source""",
    "style_signals": f"WITH {SQL_SIGNALS} SELECT doc_id, n_sentences, n_words, round(uniformity, 6) AS uniformity, round(repetition, 6) AS repetition, round(dashes, 6) AS dashes FROM signals",
    "style_scores": f"""WITH {SQL_SIGNALS}, r AS (SELECT doc_id, {SQL_SCORE} AS s FROM signals), c AS (SELECT doc_id, CASE WHEN s >= 0.33 THEN 0.32::DOUBLE ELSE s END AS s FROM r)
        SELECT doc_id, round(s, 6) AS score, CASE WHEN s >= 0.66 THEN 'high' WHEN s >= 0.33 THEN 'medium' ELSE 'low' END AS confidence FROM c""",
    "score_histogram": f"""WITH {SQL_SIGNALS}, r AS (SELECT language, floor(round({SQL_SCORE}, 6) * 10)::BIGINT AS tenth FROM signals JOIN marked USING (doc_id))
        SELECT language, tenth, count(*) AS n, grouping(language, tenth)::BIGINT AS level FROM r GROUP BY GROUPING SETS ((language, tenth), (tenth), ())""",
    "lexical_diversity": r"""WITH w AS (SELECT source, regexp_extract_all(lower(text), '[\p{L}\p{N}_''’-]+') AS w FROM documents)
        SELECT source, sum(len(list_distinct(w)))::BIGINT AS distinct_words, sum(len(w))::BIGINT AS words, round(sum(len(list_distinct(w))) / sum(len(w))::DOUBLE, 6) AS ratio FROM w GROUP BY source""",
    "cliche_hits": _sql_cliches(),
    "char_class_counts": f"SELECT doc_id, {_sql_class([chr(0x200B), chr(0xAD)])} AS invisible, {_sql_class(list(map(chr, SPACES)))} AS space, {_sql_class(list(TYPOGRAPHY))} AS typography FROM {SQL_ODD}",
    "clean_text": _sql_clean(),
    "fingerprints": r"SELECT doc_id, substr(sha1('style␟' || source || '␟' || trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 16) AS fingerprint, substr(md5(text), 1, 16) AS content_hash, ('0x' || substr(sha1(text), 1, 2))::INT % 2 = 0 AS train FROM documents",
    "duplicate_groups": "SELECT doc_id, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) - 1 AS copy, count(*) OVER (PARTITION BY text, lang) - 1 AS copies FROM documents",
    "threshold_sweep": f"""WITH {SQL_SIGNALS}, r AS (SELECT doc_id, round({SQL_SCORE}, 6) AS s FROM signals), j AS (SELECT s, quality FROM r JOIN labels USING (doc_id)),
        t AS (SELECT unnest(range(2, 14)) / 20.0::DOUBLE AS threshold)
        SELECT threshold, round(count(*) FILTER (quality = 0 AND s >= threshold) / nullif(count(*) FILTER (s >= threshold), 0)::DOUBLE, 6) AS precision,
          round(count(*) FILTER (quality = 0 AND s >= threshold) / nullif(count(*) FILTER (quality = 0), 0)::DOUBLE, 6) AS recall,
          count(*) FILTER (quality = 1 AND s >= threshold) AS false_alarms, count(*) FILTER (quality = 1) AS humans, count(*) FILTER (quality = 0) AS models FROM t, j GROUP BY threshold""",
    "score_spread": f"""WITH {SQL_SIGNALS}, r AS (SELECT doc_id, round({SQL_SCORE}, 6) AS s FROM signals), j AS (SELECT quality, lang, s, row_number() OVER (PARTITION BY quality, lang ORDER BY s) AS k, count(*) OVER (PARTITION BY quality, lang) AS c FROM r JOIN labels USING (doc_id) JOIN documents USING (doc_id))
        SELECT quality, lang, count(*) AS n, min(s) AS low, max(s) FILTER (k = c // 2 + 1) AS median, max(s) AS high FROM j GROUP BY quality, lang""",
    "embedding_scores": """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
        s AS (SELECT a.vec_id, r.label < 5 AS ai, max(list_dot_product(a.e, r.e) / (a.n * r.n)) AS s FROM n a, n r WHERE r.vec_id % 100 = 0 GROUP BY ALL),
        p AS (SELECT vec_id, coalesce(max(s) FILTER (ai), 0) AS a, coalesce(max(s) FILTER (NOT ai), 0) AS h FROM s GROUP BY vec_id)
        SELECT vec_id, round(a, 6) AS ai_similarity, round(h, 6) AS human_similarity, round(greatest(0, least(1, (a - h + 1) / 2)), 6) AS score FROM p""",
    "role_style": r"""WITH w AS (SELECT role, regexp_extract_all(lower(text), '[\p{L}\p{N}_''’-]+') AS w FROM conversations)
        SELECT role, count(*) AS turns, sum(len(w))::BIGINT AS words, max(len(w)) AS longest, round(avg(len(list_distinct(w)) / nullif(len(w), 0)::DOUBLE), 6) AS diversity FROM w GROUP BY role""",
    "hybrid_merge": SQL_HYBRID,
}


def _values(rows: list[tuple[str, str]]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in rows)


SQL["missing_suggestions"] = f"""SELECT * FROM ({_values([(k, p) for k, ps in CLICHES.items() for p in ps])}) t(language, phrase)
    EXCEPT SELECT * FROM ({_values([(k, p) for k, t in SUGGESTIONS.items() for p in t])})"""
