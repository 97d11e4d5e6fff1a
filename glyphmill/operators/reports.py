"""From findings and issues to what a report says: projections, merges with judgments, roll-ups, orders, state between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lexicon import INVISIBLE
from . import characters, style
from .audit import SEVERITIES, severity_rank

#: Where merged findings are reported, where a briefing calls one medium, how many of a list are shown.
REPORT, MEDIUM, SHOWN_REASONS, SHOWN_SKIPPED, HISTORY, SLOWEST = 0.33, 0.5, 3, 40, 20, 5

# ---------------------------------------------------------------- findings


def offline_findings(blocks: DataFrame, categories: tuple[str, ...] = characters.CATEGORIES) -> DataFrame:
    """Style and character findings as one relation (file, line, offset, end_offset, detector, source, confidence, score, text, replacement, explanation, block_id).

    blocks: (block_id, file, line, start, text, language_hint). Findings of low confidence go, but for characters. Offsets
    count from the file's start. A finding carries its own words, so no text is shuffled to meet its findings again.
    """
    styled = style.style_findings(blocks).filter("confidence <> 'low'").select(
        "block_id", F.col("start").alias("_s"), F.col("end").alias("_e"), F.lit("style").alias("source"), "confidence", "score", "text",
        F.lit(None).cast("string").alias("replacement"), F.array_join(F.concat("structural", "cliches"), ", ").alias("explanation"),
    )
    odd = characters.character_findings(blocks.withColumn("language", F.coalesce("language_hint", F.lit("en"))), categories).select(
        "block_id", F.col("start").alias("_s"), F.col("end").alias("_e"), F.lit("characters").alias("source"), "confidence", "score", F.col("original").alias("text"), "replacement", F.col("description").alias("explanation")
    )
    placed = styled.unionByName(odd).join(blocks.select("block_id", "file", "line", "start"), "block_id")
    return placed.select(
        "file", "line", (F.col("start") + F.col("_s")).alias("offset"), (F.col("start") + F.col("_e")).alias("end_offset"), F.lit("offline").alias("detector"), "source", "confidence",
        F.round("score", 3).alias("score"), "text", "replacement", "explanation", "block_id",
    )


def in_order(findings: DataFrame) -> DataFrame:
    """By file and place; equal places by source and explanation, so that reruns agree."""
    return findings.orderBy("file", "offset", "end_offset", "source", "explanation")


def report_order(findings: DataFrame) -> DataFrame:
    """Worst first, then by category and location; an unknown severity stands last."""
    rank = F.when(F.col("severity").isin("critical", "high"), 0).when(F.col("severity").isin("serious", "medium"), 1).when(F.col("severity").isin("moderate", "low"), 2).when(F.col("severity") == "minor", 3).otherwise(9)
    return findings.withColumn("rank", rank).orderBy("rank", "category", "location")


def kind_of_copy(explanation: Column, source: Column) -> Column:
    """`typography` or `style`: which of a report's two lists a finding stands in."""
    typed = F.contains(F.lower(F.coalesce(explanation, F.lit(""))), F.lit("typography")) | F.contains(F.lower(F.coalesce(source, F.lit(""))), F.lit("characters"))
    return F.when(typed, "typography").otherwise("style")


def briefing(candidates: DataFrame) -> DataFrame:
    """Rows of a briefing from candidates (file, line, text, score, explanation): text to 200 characters, medium from 0.5 on, else low."""
    return candidates.select("file", "line", F.substring("text", 1, 200).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.col("score") >= MEDIUM, "medium").otherwise("low").alias("confidence"), "explanation")


def visible(text: Column) -> Column:
    """What doesn't print becomes <U+XXXX>. Texts without such a character pass as they are."""
    cls = r"[[\p{C}\p{Z}" + "".join(f"\\x{{{c:X}}}" for c in INVISIBLE) + "]&&[^ ]]"
    code = lambda c: F.hex(F.ascii(c))
    shown = lambda c: F.concat(F.lit("<U+"), F.when(F.length(code(c)) < 4, F.lpad(code(c), 4, "0")).otherwise(code(c)), F.lit(">"))
    return F.when(text.rlike(cls), F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(cls), shown(c)).otherwise(c)), "")).otherwise(text)


_STRIP = r"(?U)^\s+|\s+$"


def split_marked(answer: Column, expected: int) -> Column:
    """The expected passages between the lines <<<1>>>, <<<2>>>, ...; null if one is missing, out of order or empty.

    A marker counts only on a line of its own, and only when its number is the next one; else it is part of a passage.
    """
    lines = F.split(answer, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]", -1)

    def cut(rows: Column) -> Column:
        marks = F.filter(F.transform(rows, lambda x, i: F.struct(i.alias("i"), F.regexp_replace(x, _STRIP, "").alias("m"))), lambda x: x["m"].rlike(r"^<<<\d+>>>$"))
        empty = F.array().cast("array<int>")
        starts = F.aggregate(marks, empty, lambda s, x: F.when((F.size(s) < expected) & (x["m"] == F.concat(F.lit("<<<"), (F.size(s) + 1).cast("string"), F.lit(">>>"))), F.array_append(s, x["i"])).otherwise(s))
        pieces = lambda s: F.transform(s, lambda at, k: F.regexp_replace(F.array_join(F.slice(rows, at + 2, F.coalesce(F.get(s, k + 1), F.size(rows)) - at - 1), "\n"), _STRIP, ""))
        return F.element_at(F.transform(F.array(starts), lambda s: F.when(F.size(s) == expected, pieces(s))), 1)

    out = F.element_at(F.transform(F.array(lines), cut), 1)
    return F.when(~F.array_contains(out, ""), out)


# ---------------------------------------------------------------- judgments and drafts


def merge_judgments(offline: DataFrame, judgments: DataFrame) -> DataFrame:
    """offline (block_id, score, source, explanation, ...) with judgments (block_id, score, reason): the higher score counts; under 0.33 a finding goes.

    A block's first judgment (seq, if there is one) counts.
    """
    order = "seq" if "seq" in judgments.columns else "reason"
    mine = judgments.groupBy("block_id").agg(F.min_by(F.struct(F.col("score").alias("_a"), F.coalesce("reason", F.lit("")).alias("_r")), order).alias("_j"))
    met = offline.join(mine, "block_id", "left")
    hit, a = F.col("_j").isNotNull(), F.coalesce(F.col("_j._a"), F.lit(0.0))
    text = F.format_string("agent: %s (score=%.2f); offline: %s", F.col("_j._r"), a, F.coalesce("explanation", F.lit("")))
    out = met.withColumns({"explanation": F.when(hit, text).otherwise(F.col("explanation")), "source": F.when(hit, "agent+offline").otherwise(F.coalesce("source", F.lit("offline"))), "score": F.when(hit, F.greatest("score", a)).otherwise(F.col("score"))})
    return out.drop("_j").filter(F.col("score") >= REPORT)


def with_drafts(findings: DataFrame, drafts: DataFrame) -> DataFrame:
    """findings that a draft (block_id, start, end, replacement) answers, with its replacement as draft."""
    return findings.join(drafts.select("block_id", "start", "end", F.col("replacement").alias("draft")), ["block_id", "start", "end"])


def worded(issues: DataFrame, templates: DataFrame, language: str) -> DataFrame:
    """issues with message: the template (key, language, template) of rule_id in language, else in English, else the key itself.

    Templates are a fixed table, a row a rule and language, and are broadcast: issues have few rules, so they aren't dealt by them.
    """
    of = lambda lang, name: F.broadcast(templates.filter(F.col("language") == lang).groupBy(F.col("key").alias("rule_id")).agg(F.min("template").alias(name)))
    return issues.join(of(language, "_own"), "rule_id", "left").join(of("en", "_en"), "rule_id", "left").withColumn("message", F.coalesce("_own", "_en", "rule_id")).drop("_own", "_en")


def unjudged(spans: DataFrame) -> DataFrame:
    """One row of spans (seq, error): n failed, the first three reasons in the order they came, how many more there are."""
    failed = spans.filter(F.col("error").isNotNull()).groupBy("error").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    first = failed.orderBy("seq").limit(SHOWN_REASONS).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "error"))), lambda x: x["error"]).alias("reasons"))
    return failed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.greatest(F.count("*") - SHOWN_REASONS, F.lit(0)).alias("more")).join(F.broadcast(first), F.lit(True), "left")  # one row each


# ---------------------------------------------------------------- words


def plural(n: Column, language: str, one: str, few: str, many: str | None = None) -> Column:
    """The form that agrees with n: in Ukrainian one of three, where 11 to 14 take the third; elsewhere one of two."""
    if language != "uk":
        return F.when(n == 1, one).otherwise(few)
    last, two = F.abs(n) % 10, F.abs(n) % 100
    teens = two.between(11, 14)
    return F.when((last == 1) & ~teens, one).when(last.between(2, 4) & ~teens, few).otherwise(many if many is not None else few)


# ---------------------------------------------------------------- roll-ups


def compare_detectors(findings: DataFrame) -> DataFrame:
    """total, mean_score, max_score of each detector's findings, without characters and low confidence."""
    counted = (F.col("confidence") != "low") & (F.coalesce("source", F.lit("")) != "characters")
    score = F.when(counted, F.col("score"))
    return findings.groupBy("detector").agg(F.count_if(counted).alias("total"), F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score"), F.coalesce(F.max(score), F.lit(0.0)).alias("max_score"))


def best_scores(rows: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Every key of rows with its highest finding's score, 0 without one."""
    best = findings.groupBy(key).agg(F.max("score").alias("score"))
    return rows.select(key).distinct().join(best, key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def coverage(walks: DataFrame) -> DataFrame:
    """One row of walks (root, files_read, blocks_found, skipped_ignored, truncated): sums, and the roots (few, named by the user) that were cut short."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return walks.agg(total("files_read"), total("blocks_found"), total("skipped_ignored"), F.array_sort(F.collect_set(F.when(F.col("truncated"), F.col("root")))).alias("truncated"))


def skipped_fixes(skipped: DataFrame) -> DataFrame:
    """(rule, reason, n, first) of skipped (seq, rule, reason): what the first 40 rows name, counted over all rows."""
    shown = skipped.orderBy("seq").limit(SHOWN_SKIPPED).select("rule", "reason").distinct()
    counts = skipped.groupBy("rule", "reason").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return counts.join(F.broadcast(shown), ["rule", "reason"], "left_semi").orderBy("first")  # at most SHOWN_SKIPPED rows


def with_issues(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """The documents (source) that have an issue."""
    return documents.join(issues.select("source"), "source", "left_semi")


CATEGORIES = ("accessibility", "seo", "performance", "best-practices")


def audit_summary(issues: DataFrame) -> DataFrame:
    """One row of JSON: issues by severity and by category, zeros included."""
    name = lambda c: c.replace("-", "_")
    counts = [F.struct(*[F.count_if(F.col(field) == v).alias(name(v)) for v in values]).alias(out) for out, field, values in (("severities", "severity", SEVERITIES), ("categories", "category", CATEGORIES))]
    return issues.agg(F.count("*").alias("total"), *counts).select(F.to_json(F.struct("total", "severities", "categories")).alias("summary"))


def scan_counts(findings: DataFrame) -> DataFrame:
    """One row of JSON: findings, files, distinct findings."""
    identity = F.struct("text", "replacement", "explanation")
    out = findings.agg(F.count("*").alias("total"), F.countDistinct("file").alias("files"), F.countDistinct(identity).alias("distinct"))
    return out.select(F.to_json(F.struct("total", "files", "distinct")).alias("counts"))


def finding_lines(findings: DataFrame) -> DataFrame:
    """A JSON object a row, without the columns whose names begin with _; written as text it is a file of JSON lines."""
    return findings.select(F.to_json(F.struct(*[c for c in findings.columns if not c.startswith("_")])).alias("value"))


def file_map(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """Every document (source) with its issues, worst first, as structs; a list is one document's, which bounds it."""
    listed = issues.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(severity_rank(F.col("severity")).alias("rank"), "rule_id", "severity", "line", "snippet"))).alias("issues"))
    none = F.array().cast(listed.schema["issues"].dataType)
    return documents.select("source").distinct().join(listed, "source", "left").withColumn("issues", F.coalesce("issues", none))


def slowest(resources: DataFrame, n: int = SLOWEST) -> DataFrame:
    """The n slowest resources (source, name, duration) of each page, equal ones by name."""
    over = W.partitionBy("source").orderBy(F.desc("duration"), "name")
    return resources.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= n)


# ---------------------------------------------------------------- between runs


def history_tail(history: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last n runs (root, mode, seq) of each root and mode."""
    over = W.partitionBy("root", "mode").orderBy(F.desc("seq"))
    return history.withColumn("_n", F.row_number().over(over)).filter(F.col("_n") <= n).drop("_n")


def file_state(files: DataFrame) -> DataFrame:
    """(path, digest) of files (path, text), to be kept for the next run; a null text counts as empty."""
    return files.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


def changed_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """files that are new or whose text isn't the one of the last run's state."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return files.withColumn("digest", digest).join(state.select("path", "digest"), ["path", "digest"], "left_anti").drop("digest")


def add_suppressions(known: DataFrame, more: DataFrame) -> DataFrame:
    """(kind, value) of both lists, each entry once; adding the same again changes nothing."""
    clean = lambda df: df.select("kind", F.trim("value").alias("value")).filter("value <> ''")
    return clean(known).unionByName(clean(more)).distinct()


def suppression_lines(suppressions: DataFrame) -> DataFrame:
    """Lines of a suppression file, in order: a section's heading, then its entries by name."""
    heads = suppressions.select("kind").distinct().select("kind", F.lit(0).alias("_n"), F.concat(F.lit("["), F.col("kind"), F.lit("s]")).alias("line"))
    return heads.unionByName(suppressions.select("kind", F.lit(1).alias("_n"), F.col("value").alias("line"))).orderBy("kind", "_n", "line").select("line")
