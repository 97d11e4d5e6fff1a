"""Detectors by name: a registry with aliases, detectors as plans or as polymorphic Python UDTFs, and errors as rows.

A detector is one of two kinds. A plan is a function of blocks (block_id, text, language_hint) that gives spans; it is
Spark all through. A block detector is a class whose `spans(text, language)` looks at one text (and may remember what it
saw before in its partition); it is registered as a UDTF, so that SQL can call it on any table:

    SELECT * FROM detect_phrases(TABLE(SELECT block_id, text FROM blocks))
    SELECT * FROM detect_repeats(TABLE(blocks) PARTITION BY source ORDER BY line)

The function's schema follows the table it is given: the id keeps its type. A text on which a detector raises gives one
row with the error instead of failing the scan: a text that nobody judged isn't a clean one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.lexicon import CLICHES, INVISIBLE, SPACES, TYPOGRAPHY


class Unavailable(RuntimeError):
    """A detector that is registered but can't be used now."""


def confidence(score: float) -> str:
    return "high" if score >= 0.66 else "medium" if score >= 0.33 else "low"


class BlockDetector:
    """Base of block detectors. spans() yields (start, end, score, explanation), offsets in code points."""

    name = "base"
    #: Whether a finding is about its own words; one about a whole text quotes none of them.
    quotes = True

    @classmethod
    def ready(cls) -> None:
        """Raises Unavailable where the detector can't be used."""

    def spans(self, text: str, language: str | None) -> Iterator[tuple[int, int, float, str]]:
        raise NotImplementedError


def as_udtf(detector: type[BlockDetector], placed: bool = False):
    """The detector as a polymorphic UDTF over a table with block_id and text (language_hint, if there is one).

    placed: a finding also has its text (empty, if the detector doesn't quote) and the line that it begins in, from 1.
    """

    class Detect:
        def __init__(self) -> None:
            self._detector = detector()

        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError("the argument is a table: TABLE(...)")
            known = {f.name: f.dataType for f in table.dataType.fields}
            for need in ("block_id", "text"):
                if need not in known:
                    raise ValueError(f"the table has no column {need}")
            out = StructType().add("block_id", known["block_id"]).add("start", IntegerType()).add("end", IntegerType()).add("score", DoubleType())
            out = out.add("confidence", StringType()).add("detector", StringType()).add("explanation", StringType()).add("error", StringType())
            return AnalyzeResult(out.add("text", StringType()).add("line", LongType()) if placed else out)

        def eval(self, row):  # noqa: A003, ANN001, ANN201
            text = row["text"]
            if text is None:
                return
            try:
                found = list(self._detector.spans(text, row["language_hint"] if "language_hint" in row else None))
            except Exception as problem:  # noqa: BLE001
                yield row["block_id"], 0, len(text), 0.0, "low", detector.name, f"detector error: {problem}", str(problem), *(("", 1) if placed else ())
                return
            ends = [i for i, c in enumerate(text) if c == "\n"] if placed and found else []
            for start, end, score, why in found:
                place = (text[start:end] if detector.quotes else "", bisect_left(ends, start) + 1) if placed else ()
                yield row["block_id"], start, end, float(score), confidence(score), detector.name, why, None, *place

    return udtf(Detect)


class Registry:
    """Detectors by name. Names that were retired may stay as aliases: they resolve, but aren't listed."""

    def __init__(self) -> None:
        self._known: dict[str, Any] = {}
        self._aliases: dict[str, str] = {}

    def register(self, name: str, detector: type[BlockDetector] | Callable[[DataFrame], DataFrame]) -> None:
        self._known[name] = detector

    def alias(self, name: str, target: str) -> None:
        self._aliases[name] = target

    def resolve(self, name: str) -> str:
        """The name that an alias (of an alias ...) stands for; a ring of aliases ends where it began."""
        seen: set[str] = set()
        while name in self._aliases and name not in seen:
            seen.add(name)
            name = self._aliases[name]
        return name

    def available(self) -> list[str]:
        return sorted(self._known)

    def lookup(self, name: str) -> Any:
        """What is registered, or None."""
        return self._known.get(self.resolve(name))

    def create(self, name: str) -> Any:
        if (found := self.lookup(name)) is None:
            raise KeyError(f"no detector {name!r}; there are: {', '.join(self.available()) or 'none'}")
        if isinstance(found, type):
            found.ready()
        return found

    def install(self, spark: SparkSession, prefix: str = "detect_") -> list[str]:
        """Registers the block detectors as SQL functions, aliases too; returns their names."""
        named = {n: d for n, d in self._known.items() if isinstance(d, type)}
        named |= {a: self.lookup(a) for a in self._aliases if isinstance(self.lookup(a), type)}
        made = []
        for n, d in sorted(named.items()):
            spark.udtf.register(function := prefix + n.replace("-", "_"), as_udtf(d))
            made.append(function)
        return made

    def run(self, blocks: DataFrame, *names: str, placed: bool = False) -> DataFrame:
        """(block_id, start, end, score, confidence, detector, explanation, error) of all named detectors over blocks.

        Block detectors run where the blocks are, without a shuffle; plans as they say. placed, for block detectors only,
        adds text and line (as_udtf): a finding then needs no second look at its block.
        """
        spark, out = blocks.sparkSession, None
        if not placed:
            self.install(spark)
        columns = ["block_id", "start", "end", "score", "confidence", "detector", "explanation", "error", *(("text", "line") if placed else ())]
        for name in names:
            found = self.create(name)
            if isinstance(found, type):
                view = f"_blocks_{self.resolve(name).replace('-', '_')}"
                blocks.createOrReplaceTempView(view)
                function = f"detect_{self.resolve(name).replace('-', '_')}"
                if placed:
                    spark.udtf.register(function := function + "_placed", as_udtf(found, True))
                rows = spark.sql(f"SELECT * FROM {function}(TABLE({view}))")
            elif placed:
                raise ValueError(f"{name} is a plan, which gives no lines")
            else:
                rows = found(blocks)
                rows = rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string"))
            out = rows.select(*columns) if out is None else out.unionByName(rows.select(*columns))
        if out is None:
            raise ValueError("no detector was named")
        return out


# ---------------------------------------------------------------- detectors


def fold(text: str) -> str:
    """The text such that what matches without regard to case is equal; some that doesn't match may be equal too."""
    return text.replace("İ", "i").replace("ı", "i").casefold()


class Phrases(BlockDetector):
    """Phrases of the lists at their places, English ones and those of the block's language (null: of any); overlaps are kept.

    A phrase with a blank is strong, a single word weak.
    """

    name = "phrases"
    # What one strong and one weak phrase weigh.
    STRONG, WEAK = 0.30, 0.10

    def __init__(self) -> None:
        import regex

        edge = r"[\p{L}\p{N}_]"

        def pattern(p: str):  # noqa: ANN202
            before, behind = (edge if p[i].isalnum() or p[i] == "_" else "" for i in (0, -1))
            return regex.compile((f"(?<!{before})" if before else "") + regex.escape(p, literal_spaces=True) + (f"(?!{behind})" if behind else ""), regex.I)

        self.patterns = {lang: [(p, pattern(p)) for p in ps] for lang, ps in CLICHES.items()}
        self.folded = {lang: [fold(p) for p in ps] for lang, ps in CLICHES.items()}

    def spans(self, text: str, language: str | None) -> Iterator[tuple[int, int, float, str]]:
        low = fold(text)
        for lang in [x for x in self.patterns if x == "en" or x == language or not language]:
            for (phrase, found), part in zip(self.patterns[lang], self.folded[lang], strict=True):
                if part in low:
                    for m in found.finditer(text):
                        yield m.start(), m.end(), self.STRONG if " " in phrase else self.WEAK, phrase


class PhraseLoad(Phrases):
    """One finding over a text that holds phrases: each different one takes its weight of what the others left."""

    name = "phrase-load"
    quotes = False

    def spans(self, text: str, language: str | None) -> Iterator[tuple[int, int, float, str]]:
        weights = {why: weight for _, _, weight, why in super().spans(text, language)}
        rest = 1.0
        for phrase in sorted(weights):
            rest *= 1 - weights[phrase]
        if weights:
            yield 0, len(text), round(1 - rest, 6), f"{len(weights)} phrases"


class OddCharacters(BlockDetector):
    """Runs of characters that aren't on a keyboard: invisible ones, odd blanks, typographic marks."""

    name = "odd-characters"

    def __init__(self) -> None:
        import re

        self.kinds = {**{c: "typography" for c in TYPOGRAPHY}, **{chr(c): "space" for c in SPACES}, **{chr(c): "invisible" for c in INVISIBLE}}
        self.run = re.compile("[" + "".join(re.escape(c) for c in self.kinds) + "]+")

    def spans(self, text: str, language: str | None) -> Iterator[tuple[int, int, float, str]]:
        for m in self.run.finditer(text):
            yield m.start(), m.end(), 0.5, ",".join(sorted({self.kinds[c] for c in m[0]}))


class Repeats(BlockDetector):
    """A text that stood in its partition before, word for word; call it with PARTITION BY and ORDER BY.

    It remembers 8 bytes for each text of a partition, so partitions are documents or files, not whole sources.
    """

    name = "repeats"

    def __init__(self) -> None:
        self.seen: set[bytes] = set()

    def spans(self, text: str, language: str | None) -> Iterator[tuple[int, int, float, str]]:
        import hashlib

        digest = hashlib.blake2b(" ".join(text.split()).encode(), digest_size=8).digest()
        if digest in self.seen:
            yield 0, len(text), 0.4, "stood here before"
        self.seen.add(digest)


def offline(blocks: DataFrame) -> DataFrame:
    """The style and character detectors as one plan over (block_id, text, language_hint)."""
    from .reports import offline_findings

    named = blocks.select("block_id", F.col("block_id").cast("string").alias("file"), F.lit(1).alias("line"), F.lit(0).alias("start"), "text", F.lit(None).cast("string").alias("language_hint") if "language_hint" not in blocks.columns else F.col("language_hint"))
    found = offline_findings(named)
    return found.withColumns({"start": F.col("offset").cast("int"), "end": F.col("end_offset").cast("int")})


def default_registry() -> Registry:
    """The library's own detectors: offline (also heuristic), phrases, phrase-load, odd-characters (also characters), repeats."""
    out = Registry()
    out.register("offline", offline)
    for detector in (Phrases, PhraseLoad, OddCharacters, Repeats):
        out.register(detector.name, detector)
    out.alias("heuristic", "offline")
    out.alias("characters", "odd-characters")
    return out
