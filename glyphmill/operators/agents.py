"""What an agent is handed and what comes back: candidates as JSON lines, judgments and findings merged into a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import matching

#: Score from which a block is a candidate, and from which a merged finding is reported.
THRESHOLD, REPORT = 0.25, 0.33


def candidates(blocks: DataFrame, spans: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(block_id, file, line, text, language, offline_score, offline_explanation), a row per block with a span from the threshold on.

    blocks: (block_id, file, line, text, language_hint); spans: (block_id, start, end, score, explanation, error). The first
    such span by place speaks for its block; spans that are errors don't count.
    """
    good = spans.filter((F.col("score") >= threshold) & F.col("error").isNull())
    first = good.groupBy("block_id").agg(F.min(F.struct("start", "end", "score", "explanation")).alias("s"))
    return blocks.join(first, "block_id").select(
        "block_id", "file", "line", "text", F.coalesce("language_hint", F.lit("en")).alias("language"), F.round("s.score", 3).alias("offline_score"), F.col("s.explanation").alias("offline_explanation")
    )


def payload_lines(found: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(kind, value): a JSON object per candidate and, in full mode, per block; written as text these are the payload's lines."""
    line = lambda df, kind, *names: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*names)).alias("value"))
    out = line(found, "candidate", *found.columns)
    if blocks is None:
        return out
    return out.unionByName(line(blocks.withColumn("language", F.coalesce("language_hint", F.lit("en"))), "block", "block_id", "file", "line", "text", "language"))


def payload_totals(found: DataFrame, blocks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row: how many blocks and candidates there are, and the threshold."""
    n = blocks.agg(F.count("*").alias("total_blocks"))
    return n.crossJoin(found.agg(F.count("*").alias("total_candidates"))).withColumn("threshold", F.lit(threshold))  # one row each


def merged_report(blocks: DataFrame, spans: DataFrame, judgments: DataFrame) -> DataFrame:
    """(seq, block_id, score, source, explanation): per block its best offline score and its judgment, the higher counts; under REPORT it goes.

    judgments are matched with blocks one to one, see matching.match_judgments; those without a block are blocks of their
    own with a null seq.
    """
    best = spans.filter(F.col("error").isNull()).groupBy("block_id").agg(F.max(F.struct("score", "explanation")).alias("o"))
    met = matching.judged_blocks(blocks, judgments).join(best, "block_id", "left")
    offline, agent = F.col("o.score"), F.col("score")
    both = offline.isNotNull() & agent.isNotNull()
    source = F.when(both, "agent+offline").when(agent.isNotNull(), "agent").otherwise("offline")
    said = F.format_string("agent: %s (score=%.2f)", F.coalesce("reason", F.lit("")), agent)
    why = F.when(both, F.concat(said, F.lit("; offline: "), F.coalesce("o.explanation", F.lit("")))).when(agent.isNotNull(), said).otherwise(F.col("o.explanation"))
    out = met.select("seq", "block_id", F.greatest(F.coalesce(offline, F.lit(0.0)), F.coalesce(agent, F.lit(0.0))).alias("score"), source.alias("source"), why.alias("explanation"))
    return out.filter(F.col("score") >= REPORT)
