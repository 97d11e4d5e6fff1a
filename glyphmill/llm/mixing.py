"""Operator 2, mixing sources to target weights.

The words of each source are laid end to end and cut into blocks of fixed length. An output shard has a fixed number of
slots; how many of them each source fills is a multinomial draw, taken under the condition that all shards together hit
each source's target (a multivariate hypergeometric draw). The k-th slot of a source takes the block that a
pseudorandom permutation of the source's block indices gives for k, a new permutation for each pass over the source.
Slots and the documents that a block covers are joined by (source, block), which gives each slot its spans of documents;
what is taken of a document, and the texts that the mix holds, are made from those spans.

The draws for a shard come from a splitting tree whose nodes have their own seeds, so any executor finds its shard's
counts, and where they begin, in a logarithm of steps, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quality import words
from .shared import mix, seed, settle, small

#: Words in a block, slots in an output shard, passes over a source at most.
BLOCK, SHARD_SLOTS, MOST = 64, 4096, 3
#: Weights by the order of the sources, repeating.
WEIGHTS = (1, 2, 3)
#: Rows of a source whose places are summed up in one window.
STRETCH = 20_000


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of sum(sizes) by weight, none above most * size: what is above is shared again by weight among the rest."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


# ---------------------------------------------------------------- permutations


def _rounds(x: np.ndarray, key: int, bits: int, back: bool) -> np.ndarray:
    half = np.uint64(bits // 2)
    mask = np.uint64((1 << (bits // 2)) - 1)
    left, right = x >> half, x & mask
    for r in reversed(range(4)) if back else range(4):
        if back:
            left, right = right ^ (mix(left ^ seed("round", key, r)) & mask), left
        else:
            left, right = right, left ^ (mix(right ^ seed("round", key, r)) & mask)
    return left << half | right


def permute(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n) (a Feistel network that walks on until it is inside), or its inverse."""
    bits = max(2, (max(n - 1, 1)).bit_length())
    bits += bits % 2
    out = _rounds(x.astype(np.uint64), key, bits, back)
    while (far := out >= n).any():
        out[far] = _rounds(out[far], key, bits, back)
    return out.astype(np.int64)


# ---------------------------------------------------------------- slots


@dataclass
class Source:
    """What one source gives: words, target, passes that take all, then rest words from the first blocks of one more."""

    name: str | None
    words: int
    target: float
    blocks: int
    passes: int
    draws: int
    last: int

    @property
    def slots(self) -> int:
        return self.passes * self.blocks + self.draws


def plan(name: str | None, size: int, target: float, index: int, block: int) -> Source:
    """The last draw takes only the words that are still missing, so the taken words meet the target, rounded."""
    take, n = round(target), -(-size // block)
    passes, rest = divmod(take, size) if size else (0, 0)
    if not rest:
        return Source(name, size, target, n, passes, 0, 0)
    short = block * n - size  # words that the source's last block lacks
    at = int(permute(np.array([n - 1]), n, _key(index, passes), back=True)[0])
    draws = -(-rest // block)
    if at < draws and draws * block - short < rest:
        draws += 1
    before = (draws - 1) * block - (short if at < draws - 1 else 0)
    return Source(name, size, target, n, passes, draws, rest - before)


def _key(index: int, pass_: int) -> int:
    return int(seed("source", index, "pass", pass_))


def _divide(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of n slots drawn without return fall to each source; beyond 10**9 slots by the normal approximation."""
    total = int(counts.sum())
    if total < 10**9:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    out, left = np.zeros_like(counts), n
    for i, c in enumerate(counts.tolist()):
        rest = total - c
        mean = left * c / total if total else 0
        var = mean * (rest / total) * ((total - left) / max(total - 1, 1)) if total else 0
        out[i] = min(max(round(rng.normal(mean, var**0.5)), left - rest, 0), c, left)
        left, total = left - int(out[i]), rest
    return out


def shard_counts(counts: np.ndarray, shards: int, shard_slots: int, salt: int):
    """A function: shard to (slots of each source, the first of them)."""
    whole = int(counts.sum())

    @lru_cache(maxsize=4096)
    def node(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if (lo, hi) == (0, shards):
            return counts, np.zeros_like(counts)
        above_lo, above_hi = _above(lo, hi)
        have, first = node(above_lo, above_hi)
        mid = (above_lo + above_hi) // 2
        rng = np.random.default_rng([salt, above_lo, above_hi])
        left = _divide(have, min(mid * shard_slots, whole) - above_lo * shard_slots, rng)
        return (left, first) if lo == above_lo else (have - left, first + left)

    def _above(lo: int, hi: int) -> tuple[int, int]:
        a, b = 0, shards
        while True:
            mid = (a + b) // 2
            if (a, mid) == (lo, hi) or (mid, b) == (lo, hi):
                return a, b
            a, b = (a, mid) if hi <= mid else (mid, b)

    def at(shard: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = 0, shards
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (a, mid) if shard < mid else (mid, b)
        return node(a, b)

    return at


def slots(spark: SparkSession, sources: list[Source], shard_slots: int = SHARD_SLOTS, salt: int = 0, block: int = BLOCK) -> DataFrame:
    """(shard, slot, source, block, take, pass): take is the words of the block that the slot takes, from its start."""
    counts = np.array([s.slots for s in sources], np.int64)
    shards = max(1, -(-int(counts.sum()) // shard_slots))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = shard_counts(counts, shards, shard_slots, salt)
        for batch in batches:
            for shard in batch["id"].tolist():
                n, first = of(shard)
                parts = []
                for i in np.flatnonzero(n).tolist():
                    s, k = sources[i], first[i] + np.arange(n[i])
                    pass_ = k // s.blocks
                    where = np.empty(len(k), np.int64)
                    for p in np.unique(pass_).tolist():
                        where[pass_ == p] = permute(k[pass_ == p] % s.blocks, s.blocks, _key(i, p))
                    take = np.where(k == s.slots - 1, s.last or block, block)
                    parts.append(pd.DataFrame({"shard": shard, "source": i, "block": where, "take": take, "pass": pass_}))
                if parts:
                    out = pd.concat(parts, ignore_index=True)
                    out["slot"] = permute(np.arange(len(out)), len(out), int(seed("shard", salt, shard)))
                    yield out

    ids = spark.range(0, shards, 1, max(1, min(shards, max(12, shards // 64))))
    return ids.mapInPandas(run, "shard long, source int, block long, take int, pass int, slot long")


# ---------------------------------------------------------------- documents


def places(sized: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Adds start, the words before the row in its source, to (source, doc_id, h, size).

    Sums go up in two steps, so a source of any size is spread over many windows: rows within a stretch, then stretches.
    """
    stretches = max(1, -(-sized.count() // stretch))
    dealt = sized.withColumn("_s", F.pmod(F.xxhash64("doc_id", "h"), F.lit(stretches)))
    total = dealt.groupBy("source", "_s").agg(F.sum("size").alias("_n"))
    before = total.select("source", F.col("_s").alias("_s2"), (F.sum("_n").over(W.partitionBy("source").orderBy("_s").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_b"))
    inside = F.sum("size").over(W.partitionBy("source", "_s").orderBy("doc_id", "h").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    joined = dealt.withColumn("_i", inside).join(before.withColumnRenamed("source", "_src"), F.col("source").eqNullSafe(F.col("_src")) & (F.col("_s") == F.col("_s2")))
    return joined.withColumn("start", F.col("_b") + F.col("_i")).select(*sized.columns, "start")


def _deal(docs: DataFrame, weights: tuple[float, ...], most: float, block: int, shard_slots: int, salt: int) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, h, source, size, source_size, target, i), and those with words, with their start, once for each
    block that they lie in and slot that it fills (once without a slot if none): block, lo, shard, slot, pass, n."""
    spark = docs.sparkSession
    sized = settle(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "source", F.size(words(F.col("text"))).cast("long").alias("size")))
    found = sorted(((r[0], r[1]) for r in sized.groupBy("source").agg(F.sum("size")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets([n for _, n in found], [weights[i % len(weights)] for i in range(len(found))], most)
    sources = [plan(name, n, t, i, block) for i, ((name, n), t) in enumerate(zip(found, goal, strict=True))]
    table = spark.createDataFrame([(i, s.name, s.words, float(s.target)) for i, s in enumerate(sources)], "i int, _name string, source_size long, target double")
    named = sized.join(small(table, len(sources)), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    laid = places(named.filter("size > 0"))
    cut = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    cut = cut.withColumn("lo", F.greatest(F.col("start") - F.col("block") * block, F.lit(0))).withColumn("hi", F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block)))
    drawn = slots(spark, sources, shard_slots, salt, block).withColumnRenamed("source", "i")
    # The planner takes the slots for as small as the shard numbers that they are made from; they grow with the corpus.
    joined = cut.join(drawn.hint("merge"), ["i", "block"], "left")
    took = F.greatest(F.least(F.coalesce("take", F.lit(0)).cast("long"), F.col("hi")) - F.col("lo"), F.lit(0))
    return named, joined.withColumn("n", took).drop("hi", "take")


def mix_spans(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, salt: int = 0) -> DataFrame:
    """The mix: (shard, slot, source, block, pass, at, doc_id, h, start, first, n), the spans of documents in each slot.

    A slot's words are its spans by at, their place in the block: n words of the row from its word number first (from 0)
    on. start tells the rows of a source apart. See mix_documents().
    """
    _, dealt = _deal(docs, weights, most, block, shard_slots, salt)
    return dealt.filter("n > 0").select("shard", "slot", "source", "block", "pass", F.col("lo").alias("at"), "doc_id", "h", "start", (F.col("block") * block + F.col("lo") - F.col("start")).alias("first"), "n")


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, salt: int = 0) -> DataFrame:
    """(doc_id, h, source, size, source_size, target, taken), one row per row of docs (doc_id, text, source).

    size: words [^\\x20\\x09-\\x0D]+ (null text: 0). Sources stand in code point order, null last, and weigh `weights`,
    repeating; see targets(). taken: words of the row in the spans of all slots, at most `most` times its size, as no
    block is in more than that many passes. h: hash of the text. A source without words has target 0. Null doc_ids and
    repeated rows are rows like others; an empty table gives an empty result. One row per source, not per document,
    comes to the driver.
    """
    named, dealt = _deal(docs, weights, most, block, shard_slots, salt)
    taken = dealt.groupBy("doc_id", "h", "source", "size", "source_size", "target", "i", "start").agg(F.sum("n").alias("taken")).drop("i", "start")
    return taken.unionByName(named.filter("size = 0").drop("i").withColumn("taken", F.lit(0).cast("long"))).select("doc_id", "h", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, salt: int = 0) -> DataFrame:
    """docs as the mix has them: of each row one for each pass that takes words of it, with just these words as its text.

    A text that is taken whole stays as it is; else spans keep the white space inside them, and where words between two
    spans aren't taken stands a line end. Other columns stay the row's. All texts together have the words that the slots take.
    """
    _, dealt = _deal(docs, weights, most, block, shard_slots, salt)

    def key(h: str):
        parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("doc_id", "source")]
        return F.concat_ws("\x1f", F.col(h).cast("string"), F.length(parts[0]).cast("string"), *parts)

    first = F.col("block") * block + F.col("lo") - F.col("start")
    by_pass = dealt.filter("n > 0").groupBy(key("h").alias("_k"), "start", "size", "pass").agg(F.array_sort(F.collect_list(F.struct(first.alias("first"), "n"))).alias("spans"))
    whole = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["n"]) == F.col("size")
    lists = by_pass.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("start", "pass", whole.alias("whole"), "spans"))).alias("_lists"))
    lists = settle(lists)
    here = docs.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_k", key("_hash"))
    # Rows alike in id, text and source share their lists: the r-th of m takes every m-th.
    alike = W.partitionBy("_k")
    here = here.withColumn("_r", F.row_number().over(alike.orderBy("_hash"))).withColumn("_m", F.count("*").over(alike))
    joined = here.join(lists.hint("shuffle_hash"), "_k")
    mine = F.filter("_lists", lambda x, i: F.pmod(i, F.col("_m")) == F.col("_r") - 1)
    # Each word with the white space behind it.
    cut = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    out = joined.withColumn("_mine", mine).withColumn("_w", F.when(F.exists("_mine", lambda x: ~x["whole"]), cut)).withColumn("_x", F.explode("_mine"))
    gap = lambda i: F.coalesce(F.get("_x.spans", i - 1)["first"] + F.get("_x.spans", i - 1)["n"] < F.get("_x.spans", i)["first"], F.lit(False))
    spans = F.transform("_x.spans", lambda x, i: F.concat(F.when(gap(i), F.lit("\n")).otherwise(F.lit("")), F.array_join(F.slice("_w", (x["first"] + 1).cast("int"), x["n"].cast("int")), "")))
    text = F.when(F.col("_x.whole"), F.col("text")).otherwise(F.regexp_replace(F.array_join(spans, ""), r"[\x20\x09-\x0D]+\z", ""))
    return out.withColumn("text", text).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source")


QUERIES = {"op2_mixing": op2_mixing}
SQL: dict[str, str] = {}
