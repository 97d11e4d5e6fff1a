"""Fix planning: from an issue and its corrected markup to an exact edit of the source it came from, and the edits made.

Location is a join, not a search: tags of the sources are rows (`sources.tags`), an issue asks for a tag of its name that
has all attributes of its snippet, first on its line, then up to three lines below, then anywhere. The join's key holds
the issue's longest attribute value, so that a page full of equal tags meets few of them. Only a tag that is the only one
of its tier is taken. Elements end where the running depth of their name's tags, a prefix sum, falls back below theirs.

Nothing is guessed and nothing is silent: each issue becomes one row with a status and a reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.dom import VOID
from ..sources.tags import ATTRIBUTE, source_tags
from .edits import splice
from .stage import settle

# Elements that a missing element is put into; marks of a text that someone still has to write; rules whose
# correction is a decision.
CONTAINERS = ("head", "html", "body")
PLACEHOLDERS = ("…", "example.com")
DECISIONS = {
    "image-alt": "an empty alt says that the image is decorative, which only someone who has seen it knows",
    "html-lang": "the language is a default, not read from the page",
    "image-alt-filename": "a text for the image takes a look at it",
}
#: What a writer is asked for, by rule.
ASKED = {
    "seo-meta-description": "a description of this page for search results, 120 to 155 characters, one plain sentence",
    "seo-open-graph": "a title of this page for shared links, under 60 characters",
    "image-alt": "a text that stands for this image, under 125 characters; SKIP if the page doesn't say what it shows",
    "image-alt-filename": "a text that stands for this image instead of a file name; SKIP if the page doesn't say what it shows",
}
#: Lines from an issue's own on which its tag may begin, and how much of a page's text a writer is shown.
WINDOW_LINES, CONTEXT_CHARS = 4, 4000
SKIP = "SKIP"

_NAME = r"<\s*([a-zA-Z][a-zA-Z0-9-]*)"
_ATTRS = "array<struct<k:string,v:string>>"


def tag_name(markup: Column) -> Column:
    """The name of the first opening tag in markup; null without one."""
    return F.lower(F.nullif(F.regexp_extract(F.coalesce(markup, F.lit("")), _NAME, 1), F.lit("")))


def tag_attributes(markup: Column) -> Column:
    """Array of (k, v) of the first opening tag; of equal names the last counts; a name alone has the value ''."""
    inner = F.regexp_extract(F.coalesce(markup, F.lit("")), _NAME + r"""((?:[^"'>]|"[^"]*"|'[^']*')*)""", 2)
    value = lambda x: F.regexp_replace(F.regexp_extract(x, ATTRIBUTE, 2), r"""^(["'])(.*)\1$""", "$2")
    found = F.transform(F.regexp_extract_all(inner, F.lit(ATTRIBUTE), 0), lambda x: F.struct(F.lower(F.regexp_extract(x, ATTRIBUTE, 1)).alias("k"), value(x).alias("v")))
    return F.element_at(F.transform(F.array(found), lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda y: y["k"] == x["k"]))), 1).cast(_ATTRS)


def has_content(markup: Column) -> Column:
    """Whether markup is a whole element, not just its opening tag."""
    return F.coalesce(F.contains(F.lower(markup), F.concat(F.lit("</"), tag_name(markup))), F.lit(False))


def element_ends(tags: DataFrame) -> DataFrame:
    """(path, start, element_end) of opening tags: behind the closing tag of the same name and depth; null if it never comes.

    An opening tag and its closing tag are neighbours among the tags of their name that stand at one level.
    """
    name = W.partitionBy("path", "name").orderBy("start")
    depth = F.sum(F.when(F.col("closing"), -1).otherwise(1)).over(name.rowsBetween(W.unboundedPreceding, 0))
    levels = tags.filter("not nested").withColumn("_level", depth + F.when(F.col("closing"), 1).otherwise(0))
    level = W.partitionBy("path", "name", "_level").orderBy("start")
    return levels.withColumn("element_end", F.lead(F.when(F.col("closing"), F.col("stop"))).over(level)).filter("not closing").select("path", "start", "element_end")


def _key(attrs: Column) -> Column:
    """The longest attribute value, as (k, v); of none ('', '')."""
    sized = F.transform(F.filter(attrs, lambda a: a["v"] != ""), lambda a: F.struct(F.length(a["v"]).alias("n"), a["k"].alias("k"), a["v"].alias("v")))
    best = F.array_max(sized)
    return F.struct(F.coalesce(best["k"], F.lit("")).alias("k"), F.coalesce(best["v"], F.lit("")).alias("v"))


def _met(asked: DataFrame, tags: DataFrame, *more: str) -> DataFrame:
    """asked (path, name, wanted, key, more ...) with the opening tags that have all its attributes: at (start, stop, indent), tag_line."""
    keys = F.explode(F.array_append("attrs", F.struct(F.lit("").alias("k"), F.lit("").alias("v")).cast("struct<k:string,v:string>"))).alias("key")
    by_key = tags.filter("not closing").select("path", "name", "line", "attrs", F.struct("start", "stop", "indent").alias("at"), keys)
    here = by_key.select("path", "name", F.col("key.k").alias("_k"), F.col("key.v").alias("_v"), "attrs", "at", F.col("line").alias("tag_line"))
    named = asked.withColumns({"_k": F.col("key.k"), "_v": F.col("key.v")})
    met = named.join(here, ["path", "name", "_k", "_v", *more])
    fits = F.forall("wanted", lambda w: F.exists("attrs", lambda a: (a["k"] == w["k"]) & ((w["v"] == "") | (a["v"] == w["v"]))))
    return met.filter(fits)


def locate(asked: DataFrame, tags: DataFrame, strict: bool = True) -> DataFrame:
    """(path, name, line, wanted, at, n): where the tags asked for (path, name, line, wanted) stand in the sources.

    n: tags of the first tier that has one: the line itself, its window, the whole source. strict: at is null unless n is
    1; else the first of the window, or else of the source, is taken.
    """
    keyed = asked.distinct().withColumn("key", _key(F.col("wanted")))
    near = keyed.filter("line is not null").withColumn("tag_line", F.explode(F.sequence(F.col("line"), F.col("line") + WINDOW_LINES - 1)))
    same = ["path", "name", "line", "wanted"]
    on = F.col("tag_line") == F.col("line")
    tiers = _met(near, tags, "tag_line").groupBy(*same).agg(F.count_if(on).alias("n1"), F.min(F.when(on, F.col("at"))).alias("a1"), F.count("*").alias("n2"), F.min("at").alias("a2"))
    alike = [F.col(f"k.{c}").eqNullSafe(F.col(f"t.{c}")) for c in same]
    first = keyed.alias("k").join(tiers.alias("t"), alike, "left").select("k.*", "n1", "a1", "n2", "a2")
    first = settle(first)
    rest = first.filter("n2 is null").select("path", "name", "wanted", "key").distinct()
    whole = _met(rest, tags).groupBy("path", "name", "wanted").agg(F.count("*").alias("n3"), F.min("at").alias("a3"))
    found = first.join(whole, ["path", "name", "wanted"], "left")
    n = F.when(F.col("n1") > 0, F.col("n1")).when(F.col("n2") > 0, F.col("n2")).otherwise(F.coalesce("n3", F.lit(0)))
    if strict:
        at = F.when(n == 1, F.when(F.col("n1") > 0, F.col("a1")).when(F.col("n2") > 0, F.col("a2")).otherwise(F.col("a3")))
    else:
        at = F.coalesce("a2", "a3")
    return found.select(*same, at.alias("at"), n.alias("n"))


def _first_of_overlapping(plans: DataFrame) -> DataFrame:
    """Adds clash: the rule of the kept edit that an edit crosses; edits are taken by (start, end, seq) within a source.

    Sources lie behind one another in a task, their edits in order: one pass over the rows, however many sources there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, low, high, by = None, -1, -1, None
        for batch in batches:
            paths, starts, ends, rules = (batch[c].to_pylist() for c in ("path", "start", "end", "rule_id"))
            clash: list[str | None] = [None] * batch.num_rows
            for i, (own, start, end) in enumerate(zip(paths, starts, ends, strict=True)):
                if own != path:
                    path, low, high, by = own, -1, -1, None
                if start < high and end > low:
                    clash[i] = by
                elif end > high:
                    low, high, by = start, end, rules[i]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clash, pa.string())], [*batch.schema.names, "clash"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plans.schema.fields)
    return plans.repartition("path").sortWithinPartitions("path", "start", "end", "seq").mapInArrow(run, f"{fields}, clash string")


PLAN = ["path", "seq", "rule_id", "line", "kind", "start", "end", "original", "replacement", "status", "reason"]


def plan_fixes(issues: DataFrame, texts: DataFrame, strict: bool = True) -> DataFrame:
    """PLAN, one row per issue (path, seq, rule_id, engine, line, snippet, fix_snippet) on texts (path, text).

    kind: insert puts the replacement at start, replace takes the place of original (start up to end). status: ready;
    needs-input (a decision or a placeholder; see fill_languages, with_answers); ambiguous (several tags fit); skipped.
    The doctype goes to the front; an element asked for in head, html or body goes behind that tag, indented; a whole
    element as correction replaces the whole element, else the opening tag alone. Of edits that cross each other the first
    stays. seq orders issues and is returned; a path has one text; sources on the web, null texts and missing paths are
    skipped with a reason.
    """
    issue = issues.select("path", "seq", "rule_id", F.coalesce("engine", F.lit("static")).alias("engine"), F.col("line").cast("int").alias("line"), "snippet", F.nullif("fix_snippet", F.lit("")).alias("fix"))
    # Only tags of a name that an issue of the same source asks for are written.
    asked = issue.groupBy("path").agg(F.collect_set(tag_name(F.col("snippet"))).alias("names"))
    sources = texts.select("path", "text").join(asked, "path")
    tags = settle(source_tags(sources, names="names"))
    web = F.coalesce(F.col("path").rlike("^https?://"), F.lit(False))
    doctype = F.lower(F.ltrim("fix")).startswith("<!doctype")
    early = F.when(web, "a page on the web has no file to write").when(F.col("fix").isNull(), "the rule has no ready correction").when(F.col("engine") != "static", "the engine describes the rendered page, not the file").when(F.coalesce("snippet", F.lit("")) == "", "the issue names no element")
    named = issue.withColumns({"reason": early, "doctype": F.coalesce(doctype, F.lit(False)), "name": tag_name(F.col("snippet")), "wanted": tag_attributes(F.col("snippet")), "fix_name": tag_name(F.col("fix")), "whole": has_content(F.col("fix"))})
    named = named.withColumn("reason", F.coalesce("reason", F.when(~F.col("doctype") & F.col("name").isNull(), "the issue's element can't be read")))
    named = settle(named)
    open_ = F.col("reason").isNull() & ~F.col("doctype")
    places = locate(named.filter(open_).select("path", "name", "line", "wanted"), tags, strict)
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("path", "name", "line", "wanted")]
    placed = named.filter(open_).alias("i").join(places.alias("p"), same, "left").select("i.*", "at", "n")
    placed = placed.unionByName(named.filter(~open_), allowMissingColumns=True)
    ends = element_ends(tags.join(named.filter(open_ & F.col("whole")).select("path", "name").distinct(), ["path", "name"], "left_semi")).withColumnRenamed("start", "_start")
    located = placed.withColumn("_start", F.col("at.start")).join(ends, ["path", "_start"], "left")
    with_text = located.join(sources.select("path", "text", F.lit(True).alias("known")), "path", "left")
    inside = (F.col("fix_name") != F.col("name")) & F.col("name").isin(*CONTAINERS)
    inside = F.coalesce(inside, F.lit(False))
    whole = F.col("whole") & ~F.col("name").isin(*sorted(VOID))
    kind = F.when(F.col("doctype") | inside, "insert").otherwise("replace")
    start = F.when(F.col("doctype"), 0).when(inside, F.col("at.stop")).otherwise(F.col("at.start"))
    end = F.when(F.col("doctype"), 0).when(inside | ~whole, F.col("at.stop")).otherwise(F.col("element_end"))
    new = F.when(F.col("doctype"), F.concat("fix", F.lit("\n"))).when(inside, F.concat(F.lit("\n"), F.col("at.indent"), F.lit("  "), F.col("fix"))).otherwise(F.col("fix"))
    plans = with_text.withColumns({"kind": kind, "start": start, "end": end, "replacement": new})
    plans = plans.withColumn("original", F.when(F.col("kind") == "insert", "").otherwise(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))))
    late = (
        F.when(F.col("known").isNull() | F.col("text").isNull(), "no such file")
        .when(F.col("doctype") & F.col("text").rlike(r"(?i)^\s*<!doctype"), "the file starts with a doctype already")
        .when(F.col("doctype"), F.lit(None))
        .when(F.col("n") > 1, F.when(F.lit(strict), "several tags fit the issue"))
        .when(F.col("at").isNull(), "no tag of the file fits the issue; it may have changed")
        .when(F.col("end").isNull(), "the element's closing tag is missing")
        .when((F.col("kind") == "replace") & (F.col("original") == F.col("fix")), "the file has the correction already")
    )
    plans = plans.withColumn("reason", F.coalesce("reason", late))
    plans = settle(plans.withColumn("status", F.when(F.col("reason").isNotNull(), F.when(F.lit(strict) & (F.col("reason") == "several tags fit the issue"), "ambiguous").otherwise("skipped"))).select(*PLAN))
    decided = F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv])
    hole = F.lit(False)
    for mark in PLACEHOLDERS:
        hole |= F.contains("replacement", F.lit(mark)) & ~F.contains("original", F.lit(mark))
    need = F.coalesce(F.try_element_at(decided, F.col("rule_id")), F.when(hole, "the correction has a placeholder where a text belongs"))
    kept = _first_of_overlapping(plans.filter("status is null").drop("status", "reason"))
    crossed = F.concat(F.lit("crosses the correction for "), "clash", F.lit("; make that one and audit again"))
    status = F.when(F.col("clash").isNotNull(), "skipped").when(need.isNotNull(), "needs-input").otherwise("ready")
    kept = kept.withColumns({"status": status, "reason": F.when(F.col("clash").isNotNull(), crossed).otherwise(need)})
    idle = {c: F.lit(None).cast(plans.schema[c].dataType) for c in ("kind", "start", "end", "original", "replacement")}
    return settle(kept.select(*PLAN)).unionByName(plans.filter("status is not null").withColumns(idle).select(*PLAN))


# ---------------------------------------------------------------- what a rule can't write


def _filled(value: Column) -> Column:
    out = F.col("replacement")
    for mark in PLACEHOLDERS:
        out = F.replace(out, F.lit(mark), value)
    return out


def fill_languages(plans: DataFrame, page_texts: DataFrame) -> DataFrame:
    """plans with html-lang answered from page_texts (path, page_text): the language is read there, so it's no guess."""
    known = page_texts.select("path", T.guess_language(F.coalesce("page_text", F.lit(""))).alias("_lang"))
    met = plans.join(known, "path", "left")
    here = (F.col("status") == "needs-input") & (F.col("rule_id") == "html-lang") & F.col("_lang").isNotNull()
    put = F.when(F.contains("replacement", F.lit("…")), _filled(F.col("_lang"))).otherwise(F.regexp_replace("replacement", F.lit(r'lang="[^"]*"'), F.concat(F.lit('lang="'), "_lang", F.lit('"'))))
    return met.withColumns({"replacement": F.when(here, put).otherwise(F.col("replacement")), "reason": F.when(~here, F.col("reason")), "status": F.when(here, "ready").otherwise(F.col("status"))}).select(*plans.columns)


def prompts(plans: DataFrame, page_texts: DataFrame) -> DataFrame:
    """(path, n, prompt): one question per source for all its plans that a writer can answer, numbered by start and seq."""
    asked = F.create_map(*[F.lit(x) for kv in ASKED.items() for x in kv])
    open_ = plans.filter((F.col("status") == "needs-input") & F.col("rule_id").isin(*ASKED))
    item = F.struct("start", "seq", F.concat_ws("\n", F.concat(F.lit("Element: "), F.coalesce(F.nullif("original", F.lit("")), F.trim("replacement"))), F.concat(F.lit("Needed: "), F.element_at(asked, F.col("rule_id")))).alias("says"))
    items = open_.groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("items"))
    shown = F.substring(F.trim(F.regexp_replace(F.coalesce("page_text", F.lit("")), r"\s+", " ")), 1, CONTEXT_CHARS)
    lines = F.transform("items", lambda x, i: F.concat(F.format_string("<<<%d>>>\n", i + 1), x["says"]))
    met = items.join(page_texts.select("path", "page_text"), "path", "left")
    return met.select("path", F.size("items").alias("n"), F.concat_ws("\n", F.lit("Page text:"), shown, F.lit(""), F.lit("Items:"), F.array_join(lines, "\n")).alias("prompt"))


def with_answers(plans: DataFrame, answers: DataFrame) -> DataFrame:
    """plans with what a writer answered to prompts(): answers (path, n, answer), a null answer being a failed one.

    A value goes where the placeholder stands, for images into the empty alt; its quotes are escaped. Values stand between
    marker lines; an answer without all its markers in order fills nothing; an empty value or SKIP
    leaves its plan waiting.
    """
    lines = F.split(F.coalesce("answer", F.lit("")), "\n", -1)

    def step(acc: Column, x: Column) -> Column:
        turn = (acc["at"] < F.col("n")) & (F.trim(x) == F.concat(F.lit("<<<"), (acc["at"] + 1).cast("string"), F.lit(">>>")))
        grown = F.concat(F.slice(acc["v"], F.lit(1), F.size(acc["v"]) - 1), F.array(F.concat(F.element_at(acc["v"], -1), F.lit("\n"), x)))
        return F.struct(F.when(turn, acc["at"] + 1).otherwise(acc["at"]).alias("at"), F.when(turn, F.array_append(acc["v"], F.lit(""))).otherwise(grown).alias("v"))

    # v holds what stands before marker 1, then the value of each marker; a marker out of turn is part of a value.
    nothing = F.struct(F.lit(0).alias("at"), F.array(F.lit("")).alias("v")).cast("struct<at:int,v:array<string>>")
    cut = F.aggregate(lines, nothing, step)
    values = answers.withColumn("_c", cut).filter(F.col("_c.at") == F.col("n")).select("path", F.posexplode("_c.v").alias("_n", "_value")).filter("_n > 0")
    waiting = (F.col("status") == "needs-input") & F.col("rule_id").isin(*ASKED)
    numbered = plans.withColumn("_n", F.when(waiting, F.row_number().over(W.partitionBy("path", waiting).orderBy("start", "seq"))))
    met = numbered.join(values, ["path", "_n"], "left")
    value = F.regexp_replace("_value", r"(?U)^\s+|\s+$", "")
    good = waiting & F.coalesce((value != "") & (F.upper(value) != SKIP), F.lit(False))
    quoted = F.replace(value, F.lit('"'), F.lit("&quot;"))
    alt = F.replace("replacement", F.lit('alt=""'), F.concat(F.lit('alt="'), quoted, F.lit('"')))
    put = F.when(F.col("rule_id").startswith("image-alt"), alt).otherwise(_filled(quoted))
    return met.withColumns({"replacement": F.when(good, put).otherwise(F.col("replacement")), "reason": F.when(~good, F.col("reason")), "status": F.when(good, "ready").otherwise(F.col("status"))}).select(*plans.columns)


# ---------------------------------------------------------------- making the edits


def apply_fixes(plans: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts with all ready plans made, outcomes (path, seq, rule_id, outcome)).

    outcome: applied; stale (the text isn't what the plan was made on); missing (no such path, or no text); else the
    plan's own status: what waits for input is never written. Edits are cut into the original text by offset. At one
    offset insertions come before a replacement, and of several insertions the last planned stands first, as if all had
    been made back to front.
    """
    ready = plans.filter("status = 'ready'").join(texts.select("path", F.col("text").alias("_text")), "path", "left")
    now = F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start"))
    outcome = F.when(F.col("_text").isNull(), "missing").when((F.col("kind") == "replace") & (now != F.col("original")), "stale").when(F.col("start") > F.length("_text"), "stale").otherwise("applied")
    judged = settle(ready.withColumn("outcome", outcome).drop("_text"))
    made = judged.filter("outcome = 'applied'").select("path", "start", "end", F.col("replacement").alias("new"), F.row_number().over(W.partitionBy("path").orderBy(F.desc("start"), F.desc("kind"), "seq")).alias("_step"))
    outcomes = judged.select("path", "seq", "rule_id", "outcome").unionByName(plans.filter("status <> 'ready'").select("path", "seq", "rule_id", F.col("status").alias("outcome")))
    return splice(texts, made, "path", order=-F.col("_step")), outcomes
