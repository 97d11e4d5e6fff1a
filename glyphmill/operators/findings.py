"""Findings and issues after detection: suppression, rescoring, duplicates, merges across engines and widths, roll-ups."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .audit import SEVERITIES, severity_rank
from .stage import alike, ranked

# ---------------------------------------------------------------- suppression


def path_patterns(suppressions: DataFrame) -> DataFrame:
    """(kind, pattern): regular expressions of the path entries, made once on the driver; the list is written by hand."""
    rows = []
    for (value,) in suppressions.filter("kind = 'path'").select(F.trim("value")).distinct().collect():
        if not value:
            continue
        if value.endswith("/"):
            rows.append(("folder", f"/{value.rstrip('/')}/"))
        else:
            rows += [("glob", f"(?s)^{_java(fnmatch.translate(value))}$"), ("part", value)]
    return suppressions.sparkSession.createDataFrame(rows, "kind string, pattern string")


def _java(pattern: str) -> str:
    """A translated glob as a pattern of this engine."""
    inner = pattern.removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z")
    return inner


def _ignored_path(source: str, suppressions: DataFrame) -> Column:
    table = path_patterns(suppressions).collect()
    posix = F.replace(F.coalesce(source, F.lit("")), F.lit("\\"), F.lit("/"))
    out = F.lit(False)
    for kind, pattern in table:
        if kind == "folder":
            out = out | F.contains(F.concat(F.lit("/"), posix, F.lit("/")), F.lit(pattern))
        elif kind == "part":
            out = out | F.contains(posix, F.lit(pattern))
        else:
            out = out | F.col(source).rlike(pattern) | posix.rlike(pattern) | F.regexp_extract(posix, "[^/]*$", 0).rlike(pattern)
    return F.coalesce(out & (posix != ""), F.lit(False))


def _values(suppressions: DataFrame, kind: str) -> DataFrame:
    return F.broadcast(suppressions.filter(F.col("kind") == kind).select(F.trim("value").alias("_v")).filter("_v <> ''").distinct())  # written by hand


def _without(df: DataFrame, suppressions: DataFrame, kind: str, match: Column) -> DataFrame:
    return df.join(_values(suppressions, kind), match, "left_anti")


def filter_issues(issues: DataFrame, suppressions: DataFrame) -> DataFrame:
    """issues without those whose rule, path, selector or fingerprint is suppressed (kind, value)."""
    print_ = T.fingerprint(F.col("rule_id"), F.col("source"), F.coalesce(F.nullif("snippet", F.lit("")), "selector"))
    out = _without(issues, suppressions, "rule", F.col("rule_id") == F.col("_v"))
    out = out.filter(~_ignored_path("source", suppressions))
    out = _without(out, suppressions, "selector", F.contains(F.coalesce("selector", F.lit("")), F.col("_v")))
    return _without(out.withColumn("_f", print_), suppressions, "fingerprint", F.col("_f") == F.col("_v")).drop("_f")


def filter_findings(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Text findings (source, dom_path, text, kind, category, style columns) without what is suppressed.

    Characters go by their category as rule. Style findings lose suppressed phrases, constructions (rule `structural`)
    and signals (which then count as 0, not as unmeasured) and are scored again, without the cap; one that has neither
    phrase nor construction left and scores below 0.33 goes; one that nothing was taken from stays as it was.
    """
    out = findings.filter(~_ignored_path("source", suppressions))
    out = _without(out, suppressions, "selector", F.contains(F.coalesce("dom_path", F.lit("")), F.col("_v")))
    out = _without(out.withColumn("_f", T.fingerprint(F.col("kind"), F.col("source"), F.col("text"))), suppressions, "fingerprint", F.col("_f") == F.col("_v")).drop("_f")
    out = _without(out, suppressions, "rule", (F.col("kind") == "characters") & (F.col("category") == F.col("_v")))
    lists = suppressions.agg(F.collect_set(F.when(F.col("kind") == "phrase", F.lower(F.trim("value")))).alias("_phrases"), F.collect_set(F.when(F.col("kind") == "rule", F.trim("value"))).alias("_rules")).withColumn("_one", F.lit(1))
    out = out.withColumn("_one", F.lit(1)).join(F.broadcast(lists), "_one", "left")
    cliches = F.filter("cliches", lambda c: ~F.array_contains("_phrases", F.lower(F.trim(c))))
    structural = F.when(F.array_contains("_rules", "structural"), F.array().cast("array<string>")).otherwise(F.col("structural"))
    signal = lambda s: F.when(F.array_contains("_rules", s) & F.col(s).isNotNull(), 0.0).when(F.array_contains("_rules", s), 0.0).otherwise(F.col(s))
    new = out.withColumns({"_c": cliches, "_s": structural, "_u": signal("uniformity"), "_r": signal("repetition"), "_d": signal("dashes")})
    changed = (F.col("kind") == "style") & ((F.size("_c") != F.size("cliches")) | (F.size("_s") != F.size("structural")) | ~F.col("_u").eqNullSafe(F.col("uniformity")) | ~F.col("_r").eqNullSafe(F.col("repetition")) | ~F.col("_d").eqNullSafe(F.col("dashes")))
    new = new.withColumn("suppressed", F.coalesce(changed, F.lit(False)))
    score = T.combine_score(F.col("_u"), F.col("_r"), F.col("_d"), F.size("_s") > 0, F.col("_c"))
    new = new.withColumn("score", F.when(F.col("suppressed"), score).otherwise(F.col("score")))
    new = new.filter(~F.col("suppressed") | (F.size("_c") > 0) | (F.size("_s") > 0) | (F.col("score") >= 0.33))
    for name, short in (("cliches", "_c"), ("structural", "_s"), ("uniformity", "_u"), ("repetition", "_r"), ("dashes", "_d")):
        new = new.withColumn(name, F.when(F.col("suppressed"), F.col(short)).otherwise(F.col(name)))
    return new.withColumn("confidence", F.when(F.col("suppressed"), T.confidence(F.col("score"))).otherwise(F.col("confidence"))).drop("_c", "_s", "_u", "_r", "_d", "_phrases", "_rules", "_one")


# ---------------------------------------------------------------- duplicates and merges


def group_duplicates(findings: DataFrame, keys: tuple[str, ...] = ("text", "replacement", "source_kind", "explanation"), order: str = "seq") -> DataFrame:
    """findings with copy (0 for the first of equal ones, by order) and copies (others of its group); nulls are equal.

    order is a long, unique within a group. A group that holds a third of all findings is ranked in stretches of it, and
    its size is a sum of partial counts.
    """
    sizes = findings.groupBy(*keys).agg((F.count("*") - 1).alias("copies"))
    met = ranked(findings, list(keys), order).withColumnRenamed("rank", "copy")
    return met.alias("f").join(sizes.alias("s"), alike("f", "s", list(keys))).select("f.*", "s.copies")


# Rules of several engines that are about one thing.
FAMILIES = {
    "alt": ["image-alt", "image-alt-filename", "axe:image-alt", "htmlcs:1_1_1"],
    "name": ["control-name", "axe:button-name", "axe:link-name", "axe:input-button-name", "axe:aria-input-field-name", "axe:label", "htmlcs:4_1_2"],
    "lang": ["html-lang", "axe:html-has-lang", "axe:html-lang-valid"],
    "title": ["document-title", "axe:document-title"],
    "heading-order": ["heading-order", "page-has-h1", "axe:heading-order", "axe:page-has-heading-one"],
    "id": ["duplicate-id", "aria-reference-broken", "axe:duplicate-id", "axe:duplicate-id-active"],
    "contrast": ["contrast-inline", "axe:color-contrast", "htmlcs:1_4_3"],
    "table": ["table-headers", "axe:th-has-data-cells"],
    "zoom": ["viewport-zoom", "axe:meta-viewport"],
    "tabindex": ["tabindex-positive", "axe:tabindex"],
    "link-text": ["link-text-vague", "axe:link-in-text-block"],
    "button-type": ["button-type"],
    "media": ["media-captions", "media-autoplay", "axe:video-caption", "axe:audio-caption"],
}


def family(rule_id: Column) -> Column:
    out = F
    for name, rules in FAMILIES.items():
        out = out.when(rule_id.isin(rules), name)
    return out.otherwise(rule_id)


def element_key(snippet: Column) -> Column:
    """Tag and sorted attributes of the first opening tag in a snippet; empty without one."""
    opening = F.regexp_extract(F.coalesce(snippet, F.lit("")), r"(?s)<([a-zA-Z][\w-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)", 0)
    tag = F.lower(F.regexp_extract(opening, r"<([a-zA-Z][\w-]*)", 1))
    raw = F.regexp_extract_all(F.regexp_replace(opening, r"^<[a-zA-Z][\w-]*", ""), F.lit(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+))?"), 0)
    pairs = F.transform(raw, lambda a: F.concat(F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)), F.lit("="), F.regexp_replace(F.regexp_replace(a, r"^[^=]*=?\s*", ""), "^[\"']+|[\"']+$", "")))
    return F.when(opening == "", "").otherwise(F.concat(tag, F.lit("|"), F.array_join(F.array_sort(pairs), ";")))


def element_counts(elements: DataFrame) -> DataFrame:
    """(source, key, n): how many elements of a document share a key of element_key()."""
    pairs = F.transform("attrs", lambda a: F.concat(F.lower(a["k"]), F.lit("="), a["v"]))
    return elements.groupBy("source", F.concat("tag", F.lit("|"), F.array_join(F.array_sort(pairs), ";")).alias("key")).agg(F.count("*").alias("n"))


def deduplicate(issues: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per problem of issues (seq, source, rule_id, engine, severity, selector, snippet, ...) with also_found_by.

    An element that the document holds once is one thing however engines spell it: issues of different engines about it,
    of one family, are one, the first. What isn't such an element goes by selector or snippet. An issue about one of
    several equal elements without a selector merges with none. The first stays, with the worst severity of its group
    and the other engines that found it. Groups are small (a document's issues about one element), so each is folded
    whole; documents never meet in one task by necessity.
    """
    keyed = issues.withColumns({"family": family(F.col("rule_id")), "element": element_key(F.col("snippet"))})
    known = keyed.join(counts.withColumnsRenamed({"key": "element"}), ["source", "element"], "left").withColumn("shared", F.coalesce(F.col("n") > 1, F.lit(False)) & (F.col("element") != ""))
    single = (F.col("element") != "") & ~F.col("shared")
    place = F.coalesce(F.nullif("selector", F.lit("")), "snippet")
    # The first issue about an unshared element of a family; other engines' issues about it join that issue's own place.
    first = W.partitionBy("source", "family", "element").orderBy("seq")
    head_engine, head_place = F.first("engine").over(first), F.first(place).over(first)
    joins = single & (F.col("engine") != head_engine)
    alone = F.col("shared") & (F.coalesce("selector", F.lit("")) == "")
    signature = F.when(alone, F.concat(F.lit("#"), F.col("seq").cast("string"))).when(joins, head_place).otherwise(place)
    signed = known.withColumn("signature", signature)
    over = W.partitionBy("source", "family", "signature")
    rank = severity_rank(F.col("severity"))
    kept = signed.withColumns({"_first": F.row_number().over(over.orderBy("seq")), "_worst": F.min(rank).over(over), "_engines": F.collect_set("engine").over(over)}).filter("_first = 1")
    worst = F.get(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("_worst"))
    return kept.withColumn("severity", F.coalesce(worst, "severity")).withColumn("also_found_by", F.array_sort(F.array_except("_engines", F.array("engine")))).select(*issues.columns, "also_found_by")


def with_browser(issues: DataFrame, audits: DataFrame, found: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues of documents with those of their browser audit merged in, audits that failed).

    issues and found: see deduplicate(), which merges both; found's seq starts behind that of issues. audits: (source,
    error), one per audited document; issues of a failed audit don't count, and a document without an audit keeps its own.
    """
    good = audits.filter(F.col("error").isNull())
    more = found.join(good.select("source"), "source", "left_semi")
    return deduplicate(issues.unionByName(more), counts), audits.filter(F.col("error").isNotNull())


BREAKPOINTS = [("desktop", 1440, 900), ("tablet", 834, 1112), ("mobile", 390, 844)]


def merge_widths(issues: DataFrame) -> DataFrame:
    """One row per problem of issues (seq, width_name, width_order, source, rule_id, selector, snippet, ...), with breakpoints.

    A problem is its rule, source and snippet (without one, selector; without either, the page); the first width's row
    stays, the names stand in the order of the widths, and only_at names the width if there is but one.
    """
    snippet = F.trim(F.coalesce("snippet", F.lit("")))
    identity = F.when(snippet != "", F.concat(F.lit("n"), snippet)).when(F.coalesce("selector", F.lit("")) != "", F.concat(F.lit("s"), F.col("selector"))).otherwise("")
    over = W.partitionBy("source", "rule_id", "_id")
    rows = issues.withColumn("_id", identity)
    rows = rows.withColumns({"_n": F.row_number().over(over.orderBy("width_order", "seq")), "_w": F.collect_set(F.struct("width_order", "width_name")).over(over)}).filter("_n = 1")
    names = F.transform(F.array_sort("_w"), lambda w: w["width_name"])
    return rows.withColumn("breakpoints", names).withColumn("only_at", F.when(F.size("breakpoints") == 1, F.get("breakpoints", F.lit(0))).otherwise("")).drop("_id", "_n", "_w", "width_name", "width_order")


def merge_hybrid(offline: DataFrame, judged: DataFrame) -> DataFrame:
    """Findings of two sources over the same blocks, with agreement `both`, `model-only`, `offline-only` or null.

    offline: (block_id, start, end, score, kind); judged: (block_id, seq, start, end, score, error). A judged finding takes
    the style findings that it overlaps and no earlier judged one took; of the scores the highest counts. Style findings
    of low confidence, characters and errors pass through. An interval join inside blocks, keyed by block.
    """
    style = offline.filter((F.col("kind") == "style") & (F.col("score") >= 0.33))
    rest = offline.filter(~((F.col("kind") == "style") & (F.col("score") >= 0.33)))
    o, m = style.alias("o"), judged.filter(F.col("error").isNull()).alias("m")
    met = m.join(o, (F.col("m.block_id") == F.col("o.block_id")) & (F.col("m.start") < F.col("o.end")) & (F.col("o.start") < F.col("m.end")))
    met = met.select("m.block_id", "m.seq", F.col("o.start").alias("o_start"), F.col("o.end").alias("o_end"), F.col("o.score").alias("o_score"))
    mine = met.withColumn("_n", F.row_number().over(W.partitionBy("block_id", "o_start", "o_end").orderBy("seq"))).filter("_n = 1")
    best = mine.groupBy("block_id", "seq").agg(F.max("o_score").alias("offline_score"))
    agreed = judged.join(best, ["block_id", "seq"], "left").select(
        "block_id", "start", "end", F.greatest("score", F.coalesce("offline_score", "score")).alias("score"), F.lit("judge").alias("kind"),
        F.when(F.col("error").isNotNull(), None).when(F.col("offline_score").isNotNull(), "both").otherwise("model-only").alias("agreement"), "offline_score", F.when(F.col("error").isNull(), F.col("score")).alias("model_score"), "error",
    )
    left = style.join(mine.select("block_id", F.col("o_start").alias("start"), F.col("o_end").alias("end")), ["block_id", "start", "end"], "left_anti")
    plain = lambda df, agreement: df.select("block_id", "start", "end", "score", "kind", F.lit(agreement).cast("string").alias("agreement"), F.col("score").alias("offline_score"), F.lit(None).cast("double").alias("model_score"), F.lit(None).cast("string").alias("error"))
    return agreed.unionByName(plain(left, "offline-only")).unionByName(plain(rest, None))


# ---------------------------------------------------------------- roll-ups


def severity_counts(issues: DataFrame, *keys: str) -> DataFrame:
    """Counts of the four severities, zeros included, by keys."""
    return issues.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def by_rule(issues: DataFrame) -> DataFrame:
    """rule_id, n: most frequent first, then by name."""
    return issues.groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id")


def finding_counts(findings: DataFrame) -> DataFrame:
    """Per detector, and in total (detector null): findings, files, distinct findings; one pass by grouping sets."""
    identity = F.struct("text", "replacement", "source_kind", "explanation")
    return findings.groupingSets([["detector"], []], "detector").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.countDistinct(identity).alias("distinct_findings"))


def first_per_block(findings: DataFrame, threshold: float = 0.25) -> DataFrame:
    """The first finding of each block from the threshold on, by place."""
    over = W.partitionBy("block_id").orderBy("start", "end")
    return findings.filter(F.col("score") >= threshold).withColumn("_n", F.row_number().over(over)).filter("_n = 1").drop("_n")


def top_findings(findings: DataFrame, n: int = 10) -> DataFrame:
    """The n highest scores (a report's own limit); equal ones by block and place."""
    return findings.orderBy(F.desc("score"), "block_id", "start").limit(n)


def majority_language(blocks: DataFrame, *keys: str) -> DataFrame:
    """By keys, or one row without: the most frequent hint, of equals the one first seen (seq); en without any."""
    counts = blocks.groupBy(*keys, "language_hint").agg(F.count("language_hint").alias("n"), F.min("seq").alias("first"))
    told = F.when(F.col("language_hint").isNotNull(), F.struct("n", -F.col("first")))
    return counts.groupBy(*keys).agg(F.coalesce(F.max_by("language_hint", told), F.lit("en")).alias("language"))


def previous_runs(history: DataFrame) -> DataFrame:
    """history (seq, root, mode, total) with the total of the run of the same root and mode before, as previous."""
    return history.withColumn("previous", F.lag("total").over(W.partitionBy("root", "mode").orderBy("seq")))


def review_band(findings: DataFrame, assessment: str | None = None) -> DataFrame:
    """Findings from 0.30 to under 0.50 are for review; an assessor's score moves them: 0.5 and more +0.20, under 0.3 -0.15."""
    gray = F.col("score").between(0.30, 0.4999999999)
    out = findings.withColumn("needs_review", gray)
    if assessment is None:
        return out
    a = F.col(assessment)
    moved = F.when(a >= 0.5, F.least(F.lit(1.0), F.col("score") + 0.20)).when(a < 0.3, F.greatest(F.lit(0.0), F.col("score") - 0.15)).otherwise(F.col("score"))
    return out.withColumn("score", F.when(gray & a.isNotNull(), moved).otherwise(F.col("score")))


# ---------------------------------------------------------------- calibration


def rates(scored: DataFrame, thresholds: list[float], *keys: str) -> DataFrame:
    """Precision, recall and false alarms of scored (label model/human, score) at each threshold; null where nothing counts."""
    hit = lambda label: F.count_if((F.col("label") == label) & (F.col("score") >= F.col("threshold")))
    spread = scored.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    out = spread.groupBy("threshold", *keys).agg(hit("model").alias("_m"), hit("human").alias("false_alarms"), F.count_if(F.col("label") == "human").alias("humans"), F.count_if(F.col("label") == "model").alias("models"))
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return out.select("threshold", *keys, ratio(F.col("_m"), F.col("_m") + F.col("false_alarms")).alias("precision"), ratio(F.col("_m"), F.col("models")).alias("recall"), "false_alarms", "humans", "models")


#: Cells of scores between 0 and 1 whose counts lead to the median.
SPREAD_CELLS = 1000


def score_spread(scored: DataFrame, *keys: str) -> DataFrame:
    """n, least, upper median and greatest score by keys. The median is exact and takes no sort of a group.

    Equal scores are counted before any shuffle; the cell of scores that holds the median is found by the cells' counts,
    and only its different scores are ranked. Null scores don't count.
    """
    cell = F.floor(F.col("score") * SPREAD_CELLS)
    counts = scored.filter(F.col("score").isNotNull()).groupBy(*keys, cell.alias("_cell"), "score").agg(F.count("*").alias("_c"))
    cells = counts.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_c"), F.min("score").alias("_low"), F.max("score").alias("_high"))
    by_cell = W.partitionBy(*keys).orderBy("_cell")
    placed = cells.withColumn("_upto", F.sum("_c").over(by_cell.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(W.partitionBy(*keys)))
    middle = F.floor(F.col("_n") / 2) + 1
    whole = placed.groupBy(*keys).agg(F.max("_n").alias("n"), F.min("_low").alias("low"), F.max("_high").alias("high"))
    held = placed.filter((F.col("_upto") >= middle) & (F.col("_upto") - F.col("_c") < middle)).select(*keys, "_cell", (middle - F.col("_upto") + F.col("_c")).alias("_want"))
    inside = counts.alias("c").join(held.alias("h"), alike("c", "h", [*keys, "_cell"])).select(*[F.col(f"c.{k}").alias(k) for k in keys], "c.score", "c._c", "h._want")
    ranks = inside.withColumn("_upto", F.sum("_c").over(W.partitionBy(*keys).orderBy("score").rowsBetween(W.unboundedPreceding, 0)))
    median = ranks.filter((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_c") < F.col("_want"))).select(*keys, F.col("score").alias("median"))
    return whole.alias("w").join(median.alias("m"), alike("w", "m", list(keys))).select(*[F.col(f"w.{k}").alias(k) for k in keys], "w.n", "w.low", "m.median", "w.high")


def embedding_scores(vectors: DataFrame, references: DataFrame) -> DataFrame:
    """(vec_id, ai_similarity, human_similarity, score, similar_to) of vectors (vec_id, embedding).

    references: (ref_id, embedding, label model/human), a corpus that is collected into one row and broadcast: every
    vector meets all of it inside one expression. score: (best model - best human + 1) / 2, within 0 and 1.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    held = references.select("label", F.struct("ref_id", F.col("embedding").alias("v"), norm(F.col("embedding")).alias("n")).alias("r")).agg(
        F.array_sort(F.collect_list(F.when(F.col("label") == "model", F.col("r")))).alias("_m"), F.array_sort(F.collect_list(F.when(F.col("label") == "human", F.col("r")))).alias("_h")
    )
    joined = vectors.withColumn("_one", F.lit(1)).join(F.broadcast(held.withColumn("_one", F.lit(1))), "_one").withColumn("_n", norm(F.col("embedding")))
    dot = lambda r: F.aggregate(F.zip_with("embedding", r["v"], lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x) / (F.col("_n") * r["n"])
    best = lambda c: F.array_max(F.transform(c, lambda r: F.struct(dot(r).alias("s"), (-r["ref_id"]).alias("i"))))
    scored = joined.withColumn("_a", best("_m")).withColumn("_b", best("_h"))
    a, b = F.coalesce("_a.s", F.lit(0.0)), F.coalesce("_b.s", F.lit(0.0))
    return scored.select("vec_id", a.alias("ai_similarity"), b.alias("human_similarity"), T.clamp((a - b + 1.0) / 2.0).alias("score"), (-F.col("_a.i")).alias("similar_to"))
