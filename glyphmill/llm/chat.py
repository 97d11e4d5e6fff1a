"""Operator 5, chat formatting by event-sourced reconstruction.

A log of events is partitioned by conversation and ordered by sequence; streamed deltas, edits and regenerations are
folded into the messages as they stand at the end, which are then rendered with a loss mask. Only DataFrame functions:
the fold is two windows over a conversation and an ordered aggregate per message.

The template is one turn after another:  <|turn|>role\\ntext<|end|>\\n
Inside texts and roles a backslash goes into every control string ("<|", "<s>", "</s>", "[INST]", "[/INST]" and such
with backslashes already inside get one more), which is undone by taking one out. A role's own line ends are escaped too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: A control string is one of these heads, any number of backslashes, and one of these tails.
_CONTROL = r"(<|\[)(\\*)(\||/?s>|/?INST\])"
_ESCAPED = r"(<|\[)\\(\\*)(\||/?s>|/?INST\])"
#: The role whose texts are under the loss mask.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$2$3")


def _escape_role(role: Column) -> Column:
    """Line ends become %0A, percent signs %25, then as texts."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def fold(events: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) out of events (conv_id, seq, kind, turn, role, text).

    kind: `message` sets a turn's role and text; `delta` appends to it; `edit` replaces its text; `regenerate` empties
    it and takes back all later turns that were written before. The last set, edit or regeneration of a turn counts, and
    the deltas after it. Events of equal seq apply in the order message, edit, regenerate, delta, then by turn, role and
    text. A null kind is a message, a null text is empty, a null role keeps the turn's; a null conv_id is a conversation.
    """
    rank = F.when(F.col("kind") == "delta", 3).when(F.col("kind") == "regenerate", 2).when(F.col("kind") == "edit", 1).otherwise(0)
    log = events.select("conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"), rank.alias("rank"))
    by_turn = ["conv_id", "turn"]
    order = ["seq", "rank", "turn", "role", "text"]
    later = W.partitionBy("conv_id").orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    taken_back = F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later)
    alive = log.withColumn("_back", taken_back).filter(F.col("_back").isNull() | (F.col("turn") <= F.col("_back")) | F.col("turn").isNull())
    so_far = W.partitionBy(*by_turn).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    marked = alive.withColumn("_era", F.sum(F.when(F.col("kind") == "delta", 0).otherwise(1)).over(so_far))
    place = F.struct("seq", "rank", "role", "text")
    eras = marked.groupBy(*by_turn).agg(
        F.max("_era").alias("_last"),
        F.max_by("role", F.when(F.col("role").isNotNull(), place)).alias("role"),
        F.collect_list(F.struct("_era", "seq", "rank", "text")).alias("_all"),
    )
    kept = F.filter(F.array_sort("_all"), lambda e: e["_era"] == F.col("_last"))
    return eras.select(*by_turn, "role", F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) of messages (conv_id, turn, role, text), one row per conversation.

    mask: for each turn (start, length) of its text inside the turn's own part of the output (what follows TURN up to the
    next), null where the turn isn't learned from. Rows stand by turn, then role, then text; repeated rows are turns of
    their own; null text and role are empty. A conversation becomes one string, so its size is what a task must hold.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("t"))
    parts = turns.select("conv_id", F.transform("t", lambda x: F.struct(_escape_role(x["role"]).alias("role"), escape(x["text"]).alias("text"), (x["role"] == LEARNED).alias("learned"))).alias("p"))
    return parts.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(F.lit(TURN), x["role"], F.lit("\n"), x["text"], F.lit(END))), "").alias("formatted"),
        F.transform("p", lambda x: F.when(x["learned"], F.struct((F.length(x["role"]) + 1).alias("start"), F.length(x["text"]).alias("length")))).alias("mask"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns, learned, formatted): roles and texts parsed from the output, and the text under the mask."""
    chunk = F.filter(F.split("formatted", r"<\|turn\|>", -1), lambda x, i: i > 0)
    body = rendered.select("conv_id", "formatted", "mask", F.transform(chunk, lambda x: F.substring(x, F.lit(1), F.length(x) - len(END))).alias("c"))
    return body.select(
        "conv_id",
        "formatted",
        F.transform("c", lambda x: F.struct(_unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substring(x, F.locate("\n", x) + 1, F.length(x))).alias("text"))).alias("turns"),
        F.transform(
            F.filter(F.arrays_zip("c", "mask"), lambda z: z["mask"].isNotNull()),
            lambda z: unescape(F.substring(z["c"], z["mask"]["start"] + 1, z["mask"]["length"])),
        ).alias("learned"),
    )


def as_events(rows: DataFrame) -> DataFrame:
    """Rows of a finished conversation as an event log: one message each.

    Rows of one turn (repeated ones, too) are messages of their own, so turns are numbered by (turn, role, text).
    """
    number = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select("conv_id", "role", "text", number.alias("turn")).withColumn("seq", F.col("turn")).withColumn("kind", F.lit("message"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    back = read_back(render(fold(as_events(rows.unionByName(more)))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op5_chat_formatting": op5_chat_formatting}
SQL = {
    "op5_chat_formatting": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), made AS (
  SELECT *, length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '(<|\[)(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS role_chars,
         length(regexp_replace(text, '(<|\[)(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS text_chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(8 + role_chars + 1 + text_chars + 8)::BIGINT AS formatted_chars
FROM made GROUP BY conv_id
"""
}
