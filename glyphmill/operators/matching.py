"""One-to-one matching of judgments that come back from outside with the blocks of a new scan.

Ids of an earlier run may be gone, so a judgment is matched by its id, then by base name, line and wording, then by base
name and line if it has no wording, then by wording alone. Every tier ranks both sides inside its key and joins on (key,
rank): each side is consumed once, equal texts in several files get a judgment each as long as there are some, and what
is left goes to the next tier by an anti-join. A key that holds a third of all rows is ranked in stretches. Wordings are
only ever asked whether they are equal, so keys hold their SHA-256: no tier shuffles or writes a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import STRETCH, ranked, settle

TIERS = ("id", "origin", "line", "text")


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)$", 1)


def plain(text: Column) -> Column:
    """Words joined by single blanks; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def wording(text: Column) -> Column:
    """SHA-256 of plain(text), 32 bytes; of an empty one no bytes."""
    return F.transform(F.array(plain(text)), lambda t: F.when(t == "", F.lit(b"")).otherwise(F.unhex(F.sha2(t, 256))))[0]


def match_judgments(blocks: DataFrame, judgments: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(block_seq, judgment_seq, tier) of blocks (seq, block_id, file, line, text) and judgments (the same columns).

    tier: id, origin, line or text, see TIERS. Of judgments with one id the last counts for that tier, and of blocks the
    first. Null ids, files and empty wordings match nothing by themselves; seq is unique on each side.
    """

    def prepared(df: DataFrame, line: Column) -> DataFrame:
        return settle(df.select("seq", "block_id", base_name(F.col("file")).alias("base"), line.alias("line"), wording(F.col("text")).alias("wording")))

    left = prepared(blocks, F.col("line").cast("int"))
    right = prepared(judgments, F.coalesce(F.col("line").try_cast("int"), F.lit(-1)))
    found = None
    for tier in TIERS:
        mine, theirs = left, right
        if tier == "id":
            key = ["block_id"]
            first = mine.filter("block_id is not null").groupBy("block_id").agg(F.min("seq").alias("block_seq"))
            last = theirs.filter("block_id is not null").groupBy("block_id").agg(F.max("seq").alias("judgment_seq"))
            met = first.join(last, key).select("block_seq", "judgment_seq")
        else:
            key = {"origin": ["base", "line", "wording"], "line": ["base", "line"], "text": ["wording"]}[tier]
            if tier == "line":
                theirs = theirs.filter("wording = X''")
            else:
                mine, theirs = mine.filter("wording <> X''"), theirs.filter("wording <> X''")
            sides = [ranked(df.select(*key, "seq"), key, "seq", stretch).withColumnRenamed("seq", name) for df, name in ((mine, "block_seq"), (theirs, "judgment_seq"))]
            met = sides[0].join(sides[1], [*key, "rank"]).select("block_seq", "judgment_seq")
        met = settle(met.withColumn("tier", F.lit(tier)))
        found = met if found is None else found.unionByName(met)
        left = left.join(met.select(F.col("block_seq").alias("seq")), "seq", "left_anti")
        right = right.join(met.select(F.col("judgment_seq").alias("seq")), "seq", "left_anti")
    return found


def judged_blocks(blocks: DataFrame, judgments: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """blocks (seq, block_id, file, line, text) with score, reason and tier of their judgment, null without one; judgments
    without a block but with a text follow as blocks of their own (tier `unmatched`, no seq)."""
    met = match_judgments(blocks, judgments, stretch)
    said = judgments.select(F.col("seq").alias("judgment_seq"), "score", "reason")
    own = blocks.select("seq", "block_id", "file", "line", "text").join(met.join(said, "judgment_seq").select(F.col("block_seq").alias("seq"), "score", "reason", "tier"), "seq", "left")
    rest = judgments.join(met.select(F.col("judgment_seq").alias("seq")), "seq", "left_anti").filter(plain(F.col("text")) != "")
    rest = rest.select("block_id", "file", F.col("line").try_cast("int").alias("line"), "text", "score", "reason", F.lit("unmatched").alias("tier"))
    return own.unionByName(rest.withColumns({"seq": F.lit(None).cast("long"), "block_id": F.col("block_id").cast(blocks.schema["block_id"].dataType)}))


def locate_findings(findings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(finding_seq, block_seq): the block that a finding from outside (seq, block_id, file, line, text) speaks of.

    By id; else the first block of its base name and line whose wording holds the finding's, or is held by it; a finding
    without wording takes the first of its line. Blocks may be spoken of more than once.
    """
    asked = findings.select(F.col("seq").alias("finding_seq"), "block_id", base_name(F.col("file")).alias("base"), F.coalesce(F.col("line").try_cast("int"), F.lit(-1)).alias("line"), plain(F.col("text")).alias("said"))
    known = blocks.select(F.col("seq").alias("block_seq"), "block_id", base_name(F.col("file")).alias("base"), F.col("line").cast("int").alias("line"), plain(F.col("text")).alias("text"))
    by_id = settle(asked.join(known.groupBy("block_id").agg(F.min("block_seq").alias("block_seq")), "block_id").select("finding_seq", "block_seq"))
    rest = asked.join(by_id, "finding_seq", "left_anti").drop("block_id")
    near = rest.join(known.drop("block_id"), ["base", "line"]).filter((F.col("said") == "") | F.contains("text", F.col("said")) | F.contains("said", F.col("text")))
    return by_id.unionByName(near.groupBy("finding_seq").agg(F.min("block_seq").alias("block_seq")))


def remap_spans(spans: DataFrame, blocks: DataFrame, pipeline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans under the ids of an earlier run, blocks with that run's own added).

    pipeline: the earlier run's blocks (seq, block_id, file, line, text), handed back. A span of a block at the same file
    and line gets the last such id; blocks of the earlier run whose id the new scan doesn't know are added.
    """
    named = pipeline.filter("block_id is not null and block_id <> ''")
    there = named.groupBy(F.coalesce("file", F.lit("")).alias("file"), F.coalesce(F.col("line").cast("int"), F.lit(0)).alias("line")).agg(F.max_by("block_id", "seq").alias("_new"))
    ids = blocks.select("block_id", "file", F.col("line").cast("int").alias("line")).join(there, ["file", "line"]).groupBy("block_id").agg(F.min("_new").alias("_new"))
    moved = spans.join(ids, "block_id", "left").withColumn("block_id", F.coalesce("_new", "block_id")).select(*spans.columns)
    columns = ["block_id", "file", "line", "text"]
    more = named.groupBy("block_id").agg(F.min_by(F.struct("file", "line", "text"), "seq").alias("b")).select("block_id", "b.file", F.col("b.line").cast("int").alias("line"), "b.text")
    more = more.join(blocks.select("block_id"), "block_id", "left_anti")
    return moved, blocks.select(*columns).withColumn("line", F.col("line").cast("int")).unionByName(more)
