"""The style detector: one finding per sentence from block-level signals, phrases and constructions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import CLICHES, STRUCTURAL

#: Where findings begin to be reported; without phrase or construction a score stays just below.
REPORT, CAP = 0.33, 0.32
_OPEN, _CLOSE = "\ue001", "\ue002"


def _candidates(lexicon: dict[str, list[str]], language: str | None) -> list[str]:
    """A language's phrases, then English ones; without a language all, each once."""
    lists = [lexicon["en"], *[v for k, v in lexicon.items() if k != "en"]] if language is None else [lexicon.get(language, []) if language != "en" else [], lexicon["en"]]
    return list(dict.fromkeys(p for ps in lists for p in ps))


def _by_language(language: Column, of, lexicon) -> Column:
    out = F.when(language.isNull(), of(None))
    for lang in lexicon:
        out = out.when(language == lang, of(lang))
    return out.otherwise(of("en"))


#: Characters that match a plain letter without regard to case, though lower-casing doesn't give it; and these letters.
_FOLDED = ("ſİıKÅς", "siikåσ")
_BEFORE, _BEHIND = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def phrase_pattern(phrase: str) -> str:
    """Case-insensitive; a word boundary on the sides where the phrase has a word character."""
    return f"(?iu){_BEFORE if _is_word(phrase[0]) else ''}{re.escape(phrase)}{_BEHIND if _is_word(phrase[-1]) else ''}"


def _longest_here(phrases: list[str]) -> str:
    """A pattern that matches nothing but captures the longest phrase that begins where it stands.

    Phrases are dealt by their first character and by whether a word may stand before, so most places cost one look.
    """
    heads: dict[str, list[str]] = {}
    for p in sorted(phrases, key=len, reverse=True):
        heads.setdefault(p[0], []).append(re.escape(p[1:]) + (_BEHIND if _is_word(p[-1]) else ""))
    branch = lambda c: f"{re.escape(c)}(?:{'|'.join(heads[c])})"
    inside, free = ([c for c in heads if _is_word(c) == w] for w in (True, False))
    parts = [f"(?=[{''.join(inside)}]){_BEFORE}(?:{'|'.join(map(branch, inside))})"] if inside else []
    return f"(?iu)(?=({'|'.join(parts + list(map(branch, free)))}))"


def _begins(phrase: str, other: str) -> bool:
    """Whether other also stands where phrase was found: it is a beginning of it that ends at a word's end."""
    return phrase.startswith(other) and (len(phrase) == len(other) or not (_is_word(other[-1]) and _is_word(phrase[len(other)])))


def cliches(sentence: Column, language: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """Array of the phrases found, in the order of the lists.

    One pass finds the longest phrase at each place; what else begins there is a beginning of that phrase, so a fixed table
    of them gives the rest. Phrases may overlap. The work grows with the text, hardly with the number of phrases.
    """
    lexicon = lexicon or CLICHES

    def of(lang: str | None) -> Column:
        found = _candidates(lexicon, lang)
        low = [p.lower() for p in found]
        places = {p: [k for k, q in enumerate(low) if _begins(p, q)] for p in low}
        table = F.str_to_map(F.lit("\n".join(f"{p}\t{','.join(map(str, ks))}" for p, ks in places.items())), F.lit("\n"), F.lit("\t"))
        names = F.split(F.lit("\n".join(found)), "\n")
        seen = F.array_distinct(F.transform(F.regexp_extract_all(sentence, F.lit(_longest_here(found)), F.lit(1)), lambda m: F.lower(F.translate(m, *_FOLDED))))
        order = F.array_sort(F.array_distinct(F.flatten(F.transform(seen, lambda m: F.transform(F.split(F.try_element_at(table, m), ","), lambda k: k.cast("int"))))))
        return F.transform(order, lambda k: F.get(names, k))

    return _by_language(language, of, lexicon)


def constructions(text: Column, language: Column) -> Column:
    """Array of struct(offset, text) of all construction matches in a whole text, by offset."""

    def matches(pattern: str) -> Column:
        java = pattern.replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\b", r"(?U:\b)")
        marked = F.regexp_replace(text, f"(?iu){java}", _OPEN + "$0" + _CLOSE)
        parts = F.split(marked, _OPEN, -1)
        before = lambda i: F.length(F.replace(F.array_join(F.slice(parts, F.lit(1), i), ""), F.lit(_CLOSE), F.lit("")))
        rows = F.transform(parts, lambda p, i: F.struct(before(i).alias("offset"), F.substring_index(p, _CLOSE, 1).alias("text"), (i > 0).alias("hit")))
        return F.when(text.rlike(f"(?iu){java}"), F.transform(F.filter(rows, lambda r: r["hit"]), lambda r: F.struct(r["offset"].alias("offset"), r["text"].alias("text")))).otherwise(F.array().cast("array<struct<offset:int,text:string>>"))

    return F.array_sort(F.concat(*[F.when(_wanted(language, lang), matches(p)).otherwise(F.array().cast("array<struct<offset:int,text:string>>")) for lang, ps in STRUCTURAL.items() for p in ps]))


def _wanted(language: Column, lang: str) -> Column:
    return F.lit(True) if lang == "en" else language.isNull() | (language == lang)


def signals(blocks: DataFrame) -> DataFrame:
    """Adds language, chunks, uniformity, repetition, dashes to (block_id, text, language_hint)."""
    language = F.coalesce(F.nullif("language_hint", F.lit("")), T.guess_language_or_null(F.col("text")))
    with_language = blocks.withColumn("language", language).withColumn("chunks", T.sentence_chunks(F.col("text"), F.col("language"))).withColumn("_words", T.words(F.col("text")))
    trimmed = F.filter(F.transform("chunks", lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), lambda c: c != "")
    return with_language.withColumns({"uniformity": T.uniformity(trimmed), "repetition": T.repetition(F.col("_words")), "dashes": T.dashes(F.col("text"), F.size("_words")), "n_words": F.size("_words"), "n_sentences": F.size(trimmed)}).drop("_words")


def style_findings(blocks: DataFrame) -> DataFrame:
    """(block_id, start, end, score, confidence, uniformity, repetition, dashes, structural, cliches, language, text), a row per sentence.

    blocks: (block_id, text, language_hint); a null hint is guessed, and stays null under five words: then all lists
    count. Offsets are code points. A construction belongs to the sentence that it starts in. Blank texts give no row.
    """
    base = signals(blocks.select("block_id", "text", "language_hint").filter(F.col("text").isNotNull())).withColumn("_found", constructions(F.col("text"), F.col("language")))
    # Starts and each chunk's own constructions are found inside the text's row: nothing is shuffled, and no sentence carries the list of its whole text.
    at = base.withColumn("_starts", T.running_starts(F.transform("chunks", F.length)))
    piece = lambda c, s: F.struct(c.alias("chunk"), s.alias("at"), F.filter("_found", lambda m: (m["offset"] >= s) & (m["offset"] < s + F.length(c))).alias("own"))
    rows = at.select("block_id", "language", "uniformity", "repetition", "dashes", F.explode(F.zip_with("chunks", "_starts", piece)).alias("p"))
    lead = F.length("p.chunk") - F.length(F.regexp_replace("p.chunk", r"(?U)^\s+", ""))
    placed = rows.withColumn("start", F.col("p.at") + lead).withColumn("sentence", F.regexp_replace("p.chunk", r"(?U)^\s+|\s+$", "")).filter("sentence <> ''").withColumn("end", F.col("start") + F.length("sentence"))
    own = F.transform(F.filter("p.own", lambda m: (m["offset"] >= F.col("start")) & (m["offset"] < F.col("end"))), lambda m: m["text"])
    hit = placed.withColumn("structural", own).withColumn("cliches", cliches(F.col("sentence"), F.col("language")))
    raw = T.combine_score(F.col("uniformity"), F.col("repetition"), F.col("dashes"), F.size("structural") > 0, F.col("cliches"))
    bare = (F.size("structural") == 0) & (F.size("cliches") == 0)
    scored = hit.withColumn("_raw", raw).withColumn("score", F.when(bare & (F.col("_raw") >= REPORT), CAP).otherwise(F.col("_raw")))
    return scored.select("block_id", "start", "end", "score", T.confidence(F.col("score")).alias("confidence"), "uniformity", "repetition", "dashes", "structural", "cliches", "language", F.col("sentence").alias("text"))
