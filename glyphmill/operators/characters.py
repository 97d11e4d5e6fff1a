"""Characters that a keyboard doesn't produce: found, placed, merged, replaced."""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lexicon import CATEGORY_SCORES, CYRILLIC_TO_LATIN, ENTITIES, EXEMPT, GREEK_TO_LATIN, INVISIBLE, LATIN_TO_CYRILLIC, SPACES, TYPOGRAPHY, styled_characters
from ..functions.text import confidence

CATEGORIES = ("invisible", "space", "homoglyph", "styled", "typography")
HARD = CATEGORIES[:4]
_CYRILLIC, _GREEK, _LATIN = "[\u0400-\u052f]", "[\u0370-\u03ff]", "[A-Za-zÀ-ɏ]"


def describe(ch: str, replacement: str) -> str:
    name = unicodedata.name(ch, "UNNAMED CONTROL CHARACTER")
    return f"U+{ord(ch):04X} {name} -> {replacement!r}" if replacement else f"U+{ord(ch):04X} {name} -> removed"


def reported_characters() -> dict[str, tuple[str, str]]:
    """Category and replacement of every single character that is reported."""
    rows = {ch: ("styled", r) for ch, r in styled_characters().items()}
    rows |= {ch: ("typography", r) for ch, r in TYPOGRAPHY.items()}
    rows |= {chr(cp): ("space", " ") for cp in SPACES}
    return rows | {chr(cp): ("invisible", "") for cp in INVISIBLE}


def character_map(spark: SparkSession) -> DataFrame:
    """(ch, category, replacement, description) of every single character that is reported; about 1500 rows by rule and tables."""
    return spark.createDataFrame([(ch, c, r, describe(ch, r)) for ch, (c, r) in reported_characters().items()], "ch string, category string, replacement string, description string")


def _class(codes: Iterable[int]) -> str:
    """A character class of these code points, neighbours as ranges."""
    spans: list[list[int]] = []
    for c in sorted(set(codes)):
        if spans and c == spans[-1][1] + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" if hi > lo else f"\\x{{{lo:X}}}" for lo, hi in spans) + "]"


def _heads(blocks: DataFrame, cut: Column, head: Column, *keep: str | Column) -> DataFrame:
    """(block_id, start, head, keep ...): what head finds at the beginning of a piece of the cut text, and where the piece begins.

    Texts are cut in front of matches, so there is a row for a match, not for a character, and only lengths and heads are
    shuffled. The pattern looks behind itself for a letter at most, so it fits a piece's beginning as it fits the text.
    """
    parts = blocks.select("block_id", *keep, F.posexplode(cut).alias("nth", "part"))
    narrow = parts.withColumns({"_n": F.length("part"), "head": head}).drop("part")
    start = F.coalesce(F.sum("_n").over(W.partitionBy("block_id").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return narrow.withColumn("start", start).filter("head <> ''").drop("nth", "_n")


def _look_alikes(spark: SparkSession) -> DataFrame:
    rows = [(a, "latin", b) for a, b in CYRILLIC_TO_LATIN.items()] + [(a, "latin", b) for a, b in GREEK_TO_LATIN.items()] + [(a, "cyrillic", b) for a, b in LATIN_TO_CYRILLIC.items()]
    return spark.createDataFrame([(a, m, b, f"U+{ord(a):04X} {unicodedata.name(a)}") for a, m, b in rows], "ch string, majority string, replacement string, named string")


def script(ch: Column) -> Column:
    return F.when(ch.rlike(_CYRILLIC), "cyrillic").when(ch.rlike(_GREEK), "greek").when(ch.rlike(_LATIN), "latin")


def _majority(counts: dict[str, Column], first: dict[str, Column]) -> Column:
    """The script with most letters; of equals the one that stands first."""
    return F.array_max(F.array(*[F.struct(counts[s].alias("n"), (-F.coalesce(first[s], F.lit(2**30))).alias("f"), F.lit(s).alias("s")) for s in counts]))["s"]


def _single(blocks: DataFrame) -> DataFrame:
    """Reported characters of the map: (block_id, start, end, original, replacement, category, description)."""
    known = character_map(blocks.sparkSession)
    exempt = F.when(F.col("language") == "uk", F.array(*[F.lit(c) for c in EXEMPT["uk"]])).when(F.col("language") == "it", F.array(*[F.lit(c) for c in EXEMPT["it"]])).otherwise(F.array().cast("array<string>"))
    codes = [ord(ch) for ch in reported_characters()]
    plain = [c for c in range(0x80) if c not in codes]  # one look settles these
    reported = f"(?!{_class(plain)}){_class(codes)}"
    chars = _heads(blocks.filter(F.col("text").rlike(reported)), F.split("text", f"(?={reported})", -1), F.regexp_extract("part", f"^{reported}", 0), exempt.alias("_exempt")).withColumnRenamed("head", "ch")
    found = chars.join(F.broadcast(known), "ch").filter(~F.array_contains("_exempt", F.col("ch")))
    return found.select("block_id", "start", (F.col("start") + 1).alias("end"), F.col("ch").alias("original"), "replacement", "category", "description")


_SCRIPTS = {"cyrillic": _CYRILLIC, "greek": _GREEK, "latin": _LATIN}
#: A character of a word, and letters of each script.
_LETTER = r"[\p{L}\p{Nl}\p{No}]"
_LETTERS = {s: f"[{c}&&{_LETTER}]" for s, c in _SCRIPTS.items()}
#: No letter in front; looked for over two units, as a letter may be a pair of them.
_START = f"(?<!{_LETTER}{{1,2}})"


def _scripts(text: Column) -> Column:
    """An array of one struct: most, the script of most letters of a text, and kinds, how many scripts it has."""
    counts = [(F.length(text) - F.length(F.regexp_replace(text, f"{c}+", ""))).alias(s) for s, c in _LETTERS.items()]
    firsts = [F.nullif(F.regexp_instr(text, F.lit(c)), F.lit(0)).alias(f"{s}_at") for s, c in _LETTERS.items()]
    return F.transform(F.array(F.struct(*counts, *firsts)), lambda x: F.struct(_majority({s: x[s] for s in _LETTERS}, {s: x[f"{s}_at"] for s in _LETTERS}).alias("most"), sum((F.when(x[s] > 0, 1).otherwise(0) for s in _LETTERS), F.lit(0)).alias("kinds")))


def _odd_words(majority: str) -> str:
    """Where a word begins that has letters of two scripts, or is one letter of another script than the majority."""
    lone = "|".join(c for s, c in _LETTERS.items() if s != majority)
    pairs = "|".join(f"(?={_LETTER}*?{_LETTERS[a]})(?={_LETTER}*?{_LETTERS[b]})" for a, b in itertools.combinations(_LETTERS, 2))
    # Each of these words has a letter that isn't Latin, unless it is a lone Latin one.
    foreign = r"(?=[\p{L}\p{Nl}\p{No}&&[^\u0370-\u052f]]*+[\u0370-\u052f])"
    return f"{_START}(?:{foreign}(?:(?:{lone})(?!{_LETTER})|{pairs}))" if majority == "latin" else f"{_START}(?:(?:{lone})(?!{_LETTER})|{foreign}(?:{pairs}))"


def _homoglyphs(blocks: DataFrame) -> DataFrame:
    """Letters of another script than the rest of their word, and lone ones of another script than the rest of the text.

    A lone letter has no replacement: it is reported for review. Only texts with letters of two scripts are looked at, and
    of these only words with letters of two scripts and lone letters of another script than most.
    """
    spark = blocks.sparkSession
    # The generator has each text's scripts counted once.
    mixed = blocks.filter(F.col("text").rlike("[\u0370-\u052f]")).select("block_id", "text", F.explode(_scripts(F.col("text"))).alias("s")).filter("s.kinds >= 2").select("block_id", "text", F.col("s.most").alias("_most"))

    def by_majority(of) -> Column:  # noqa: ANN001
        out = F
        for s in _LETTERS:
            out = out.when(F.col("_most") == s, of(_odd_words(s)))
        return out

    found = _heads(mixed, by_majority(lambda p: F.split("text", f"(?={p})", -1)), by_majority(lambda p: F.regexp_extract("part", f"^(?={p}){_LETTER}+", 0)), "_most")
    words = found.select("block_id", "start", "_most", F.col("head").alias("word"), F.explode(_scripts(F.col("head"))).alias("s"))
    lone = F.length("word") == 1
    words = words.select("block_id", F.col("start").alias("_from"), "word", lone.alias("lone"), F.when(lone, F.col("_most")).otherwise(F.col("s.most")).alias("majority"), F.posexplode(F.split("word", "")).alias("_at", "ch"))
    wanted = words.filter(script(F.col("ch")) != F.col("majority")).withColumn("start", F.col("_from") + F.col("_at"))
    met = wanted.join(F.broadcast(_look_alikes(spark)), ["ch", "majority"])
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    inside = F.concat(F.col("named"), F.lit(" inside a "), F.col("majority"), F.lit(" word ("), quoted(F.col("word")), F.lit(") -> "), quoted(F.col("replacement")))
    alone = F.concat(F.col("named"), F.lit(" alone in "), F.col("majority"), F.lit(" text -> looks like "), quoted(F.col("replacement")), F.lit("; review manually"))
    return met.select("block_id", "start", (F.col("start") + 1).alias("end"), F.col("ch").alias("original"), F.when(~F.col("lone"), F.col("replacement")).alias("replacement"), F.lit("homoglyph").alias("category"), F.when(F.col("lone"), alone).otherwise(inside).alias("description"))


def _entities(blocks: DataFrame) -> DataFrame:
    """HTML entities of characters off the keyboard; they are reported whatever categories are asked for."""
    pattern = "|".join(e.replace("&", "&") for e in ENTITIES)
    marked = F.split(F.regexp_replace("text", f"({pattern})", "\ue001$1\ue002"), "\ue001", -1)
    parts = blocks.filter(F.col("text").rlike(pattern)).select("block_id", F.posexplode(marked).alias("nth", "part"))
    bare = F.length(F.replace("part", F.lit("\ue002"), F.lit("")))
    start = F.coalesce(F.sum(bare).over(W.partitionBy("block_id").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    found = parts.withColumn("start", start).filter("nth > 0").withColumn("original", F.substring_index("part", "\ue002", 1))
    replacement = F.try_element_at(F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv]), F.col("original"))
    return found.select("block_id", "start", (F.col("start") + F.length("original")).alias("end"), "original", replacement.alias("replacement"), F.lit("typography").alias("category"), F.concat(F.lit("HTML entity "), F.col("original"), F.lit(" -> '"), replacement, F.lit("'")).alias("description"))


def merge_adjacent(found: DataFrame) -> DataFrame:
    """Neighbours of one category become one row: texts and replacements joined, descriptions with "; " between.

    A run with a part for review (replacement null) is for review as a whole.
    """
    order = W.partitionBy("block_id").orderBy("start", "end")
    new = ~((F.col("start") == F.lag("end").over(order)) & (F.col("category") == F.lag("category").over(order)))
    runs = found.withColumn("_run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("start", "original", "replacement", "description")))
    grouped = runs.groupBy("block_id", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("category").alias("category"), parts.alias("p"), F.count_if(F.col("replacement").isNull()).alias("_open"))
    text = lambda field, sep: F.array_join(F.transform("p", lambda x: x[field]), sep)
    return grouped.select("block_id", "start", "end", text("original", "").alias("original"), F.when(F.col("_open") == 0, text("replacement", "")).alias("replacement"), "category", text("description", "; ").alias("description"))


def anomalies(blocks: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(block_id, start, end, original, replacement, category, description) of blocks (block_id, text, language), merged.

    replacement: what the keyboard has instead, empty to delete, null for review by a person. Offsets are code points.
    Null texts have none. A character of the map is not reported as a homoglyph as well.
    """
    blocks = blocks.select("block_id", "text", "language").filter(F.col("text").isNotNull())
    single = _single(blocks).filter(F.col("category").isin(list(categories)))
    found = single
    if "homoglyph" in categories:
        found = found.unionByName(_homoglyphs(blocks).join(single.select("block_id", "start"), ["block_id", "start"], "left_anti"))
    return merge_adjacent(found.unionByName(_entities(blocks)))


def character_findings(blocks: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """anomalies() with score and confidence by category."""
    score = F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_SCORES.items() for x in kv]), F.col("category"))
    return anomalies(blocks, categories).withColumn("score", score).withColumn("confidence", confidence(F.col("score")))


#: Letters, digits and marks of keyboards, none of which is in a class: texts are mostly made of them.
_USUAL = ((0x00, 0x7F), (0xC0, 0xD6), (0xD8, 0x24F), (0x370, 0x4FF), (0x4E00, 0x9FFF))


def class_counts(text: Column) -> dict[str, Column]:
    """Number of characters of the simple classes, without a place; inside one codegen span.

    Runs of usual characters are taken out in one pass of a few ranges; the long classes see only what is left.
    """
    classes = {"invisible": list(INVISIBLE), "space": list(SPACES), "typography": [ord(c) for c in TYPOGRAPHY]}
    assert not any(lo <= c <= hi for cs in classes.values() for c in cs for lo, hi in _USUAL)
    rest = F.regexp_replace(text, "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in _USUAL) + "]+", "")
    return {name: F.regexp_count(rest, F.lit("[" + "".join(f"\\x{{{c:X}}}" for c in cs) + "]")) for name, cs in classes.items()}


def clean_text(blocks: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(block_id, text) with every replacement made; what is for review stays as it is."""
    from .edits import splice

    edits = anomalies(blocks, categories).filter(F.col("replacement").isNotNull()).select("block_id", "start", "end", F.col("replacement").alias("new"))
    return splice(blocks, edits)


def summarize(found: DataFrame) -> DataFrame:
    """(block_id, summary): `category: n` of each, by name."""
    counts = found.groupBy("block_id", "category").count()
    return counts.groupBy("block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "count"))), lambda x: F.concat(x["category"], F.lit(": "), x["count"])), ", ").alias("summary"))
