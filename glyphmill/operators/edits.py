"""Edits to texts: overlap resolution, splicing, offline suggestions. Results are new columns; nothing is written in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _let


def splice(texts: DataFrame, edits: DataFrame, key: str = "block_id", order: Column | None = None) -> DataFrame:
    """(key, text) of texts (key, text) with edits (key, start, end, new) made.

    Edits don't overlap (see keep_disjoint); insertions (start is end) at one place stand in the order of `order`, before
    what is replaced there. The pieces between edits are cut from the original, so order and lengths of
    the replacements don't matter; a text without edits stays as it is.
    """
    by_text = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", (F.lit(0) if order is None else order).alias("_o"), "new"))).alias("_e"))
    joined = texts.join(by_text, key, "left")

    def pieces(e: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1)["end"])
        parts = F.transform(e, lambda x, i: F.concat(F.substring(F.col("text"), before(i) + 1, x["start"] - before(i)), x["new"]))
        return F.concat(F.array_join(parts, ""), F.substring(F.col("text"), F.element_at(e, -1)["end"] + 1, F.length("text")))

    out = F.when(F.size("_e") > 0, F.element_at(F.transform(F.array("_e"), pieces), 1)).otherwise(F.col("text"))
    return joined.select(*[c if c != "text" else out.alias("text") for c in texts.columns])


def keep_disjoint(edits: DataFrame, key: str = "path") -> DataFrame:
    """edits (key, start, end, ...) with applied: false for one that overlaps an earlier kept one of its text.

    Edits are taken by (start, end); the fold over a text's edits carries the end of the last one kept.
    """
    extra = [c for c in edits.columns if c not in (key, "start", "end")]
    grouped = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.struct(*extra).alias("rest")))).alias("e"))
    kind = "struct<at:int,kept:array<boolean>>"

    def step(acc: Column, x: Column) -> Column:
        ok = x["start"] >= acc["at"]
        return F.struct(F.when(ok, x["end"]).otherwise(acc["at"]).cast("int").alias("at"), F.concat(acc["kept"], F.array(ok)).alias("kept"))

    kept = F.aggregate("e", F.struct(F.lit(0).alias("at"), F.array().cast("array<boolean>").alias("kept")).cast(kind), step)["kept"]
    rows = grouped.select(key, F.explode(F.arrays_zip("e", kept.alias("k"))).alias("x"))
    return rows.select(key, "x.e.start", "x.e.end", "x.e.rest.*", F.col("x.k").alias("applied"))


def plan_edits(edits: DataFrame, texts: DataFrame) -> DataFrame:
    """status of edits (path, start, end, original, new, allow_empty) against texts (path, text).

    no-text: nothing new, or an empty text that isn't allowed; overlap: it crosses an earlier edit; stale: the text isn't
    what the edit was made for; missing: no such path; else applied.
    """
    idle = (F.col("new") == F.col("original")) | ((F.coalesce("new", F.lit("")) == "") & ~F.col("allow_empty"))
    idle = F.coalesce(idle, F.lit(False))
    disjoint = keep_disjoint(edits.filter(~idle))
    joined = disjoint.join(texts, "path", "left")
    now = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    status = F.when(F.col("text").isNull(), "missing").when(~F.col("applied"), "overlap").when(now != F.col("original"), "stale").otherwise("applied")
    return joined.withColumn("status", status).drop("text", "applied").unionByName(edits.filter(idle).withColumn("status", F.lit("no-text")))


def apply_edits(edits: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, text) of all texts, edits with status applied made."""
    good = plan_edits(edits, texts).filter("status = 'applied'").select("path", "start", "end", "new")
    return splice(texts, good, "path")


# Words of which a doubled one is a slip.
FUNCTION_WORDS = "into in on at to of for with the a an di da del della il la le un una per con у в на до з із за про".split()


def tidy(text: Column) -> Column:
    """Repairs what a deleted phrase leaves: doubled words and blanks, blanks before marks, marks in front, a small first letter."""
    doubled = r"(?iu)(?<![\p{L}\p{N}_])(" + "|".join(FUNCTION_WORDS) + r")(?U:\s+)\1(?![\p{L}\p{N}_])"
    out = F.regexp_replace(text, doubled, "$1")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    out = F.regexp_replace(out, r"(?U)\s+([,.;:!?])", "$1")
    out = F.regexp_replace(out, r"(?U)^[\s,;:—–-]+", "")
    out = F.regexp_replace(out, r"(?U),\s*,", ",")
    out = F.regexp_replace(out, r"(?U)^\s+|\s+$", "")
    capital = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))
    return _let(out, capital)


def suggest(text: Column, language: Column, phrases: dict[str, dict[str, str]]) -> Column:
    """text with phrases (language: phrase: replacement) replaced in order, capitals kept, then tidied; null if nothing changed.

    A language's table is followed by the English one. Dashes with blanks become commas in en and it.
    """
    from .style import _longest_here, phrase_pattern

    def replaced(whole: Column, table: dict[str, str]) -> Column:
        """One look decides whether a text, and then each of its pieces, goes through the table at all.

        Pieces end with a mark that no phrase or replacement holds and that is no part of a word, so no match crosses it.
        """
        if not table:
            return whole
        some = _longest_here(list(table))
        marks = "".join(c for c in ".!?;:\n" if not any(c in x for pair in table.items() for x in pair))

        def fold(out: Column) -> Column:
            for phrase, new in table.items():
                pattern = phrase_pattern(phrase)
                upper = new[:1].upper() + new[1:]
                capital = r"(?=(?-i:\p{Lu}))"
                at = pattern.index(")", 0) + 1
                out = F.regexp_replace(out, pattern[:at] + _after_boundary(pattern[at:], capital), _literal(upper))
                out = F.regexp_replace(out, pattern, _literal(new))
            return out

        pieces = F.split(whole, f"(?<=[{marks}])", -1) if marks else F.array(whole)
        return F.when(whole.rlike(some), F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(some), fold(p)).otherwise(p)), "")).otherwise(whole)

    english = phrases.get("en", {})
    out = F.when(F.coalesce(language, F.lit("en")) == "en", replaced(text, english))
    for lang, table in phrases.items():
        if lang != "en":
            out = out.when(language == lang, replaced(replaced(text, table), english))
    out = out.otherwise(replaced(text, english))
    out = F.when(F.coalesce(language, F.lit("en")).isin("en", "it"), F.regexp_replace(out, r"(?U)\s+[—–]\s+", ", ")).otherwise(out)
    return _let(tidy(out), lambda x: F.when((x != "") & (x != text), x))


def _after_boundary(pattern: str, look: str) -> str:
    head = r"(?<![\p{L}\p{N}_])"
    return head + look + pattern[len(head) :] if pattern.startswith(head) else look + pattern


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")
