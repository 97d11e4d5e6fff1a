"""Operator 8, quality rules: adaptive thresholds from mergeable quantile sketches per language and source.

Only DataFrame functions. Signals are computed inside each row (no shuffle of texts); what is shuffled to learn the
thresholds are quantile sketches, merged map-side: one per (language, source), and the same sketches merged again per
language and over all rows for groups too small to speak for themselves.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, quoted, settle, small

#: Signals under adaptive fences: the fence is the median plus so many times the distance of the quartiles; and the
#: distance of the fence in groups whose quartiles agree (spread 0), in the signal's own unit, since without it such a group
#: would reject any row that differs at all. Wherever rows differ, their spread alone decides.
SIGNALS = {"r_symbols": (20.0, 0.1), "r_marks": (20.0, 1.2), "r_dup_lines": (20.0, 0.6), "r_same": (20.0, 0.2), "r_length": (8.0, 3.0)}
#: Signals with a fence below the median as well, as far away.
TWO_SIDED = ("r_length",)
#: Groups of fewer rows use the sketch of their language, then of all rows.
LEAST_ROWS = 100
#: Words in a repeated window, base limits.
WINDOW, BASE_LEAST_WORDS, BASE_REPEAT_PERCENT = 5, 10, 20


def words(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+; null text: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def windows(word_array: Column) -> Column:
    """Array of the 64-bit hashes of all windows of five words, by position."""
    hashes = F.transform(word_array, lambda w: F.xxhash64(w))
    return F.element_at(
        F.transform(
            F.array(hashes),
            lambda h: F.when(
                F.size(h) >= WINDOW,
                F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])),
            ).otherwise(F.array().cast("array<bigint>")),
        ),
        1,
    )


def repeated_words(window_array: Column) -> Column:
    """Words inside windows that occur twice or more. The common case, no repeat, ends at a hash set's size."""

    def count(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = F.element_at(
            F.transform(
                F.array(ordered),
                lambda a: F.filter(
                    a,
                    lambda x, k: ((k > 0) & (F.get(a, k - 1)["h"] == x["h"])) | ((k < F.size(a) - 1) & (F.get(a, k + 1)["h"] == x["h"])),
                ),
            ),
            1,
        )
        spots = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.element_at(
            F.transform(
                F.array(spots),
                lambda p: F.aggregate(
                    F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
                    F.lit(0).cast("bigint"),
                    lambda s, x: s + x,
                ),
            ),
            1,
        )

    return F.element_at(
        F.transform(F.array(window_array), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(count(h))), 1
    )


def signals(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, then n_words, word_chars, n_symbols, n_marks, n_lines, n_dup_lines, n_repeat_words, n_same (long) of each text.

    n_same: words equal to the word before them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    with_words = docs.select(*keep, text.alias("_t"), words(F.col("text")).alias("_w"))
    lines = F.filter(F.split(F.col("_t"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.array_join(F.col("_w"), "")
    return with_words.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit(r"\p{Punct}")).cast("long").alias("n_marks"),
        F.element_at(F.transform(F.array(lines), lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("d"))), 1).alias("_l"),
        repeated_words(windows(F.col("_w"))).alias("n_repeat_words"),
        # The array is bound once: were the column named inside, a filter pushed down would split the text anew for each word.
        F.element_at(F.transform(F.array(F.col("_w")), lambda w: F.size(F.filter(w, lambda x, i: (i > 0) & (F.get(w, i - 1) == x)))), 1).cast("long").alias("n_same"),
    ).select(
        *keep, "n_words", "word_chars", "n_symbols", "n_marks",
        F.col("_l.n").cast("long").alias("n_lines"), F.col("_l.d").cast("long").alias("n_dup_lines"), "n_repeat_words", "n_same",
    )


def _rates(df: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return df.select(
        "*",
        (F.col("n_symbols") / n).alias("r_symbols"),
        (F.col("n_marks") / n).alias("r_marks"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("r_dup_lines"),
        (F.col("n_same") / n).alias("r_same"),
        (F.col("word_chars") / n).alias("r_length"),
    )


def fences(rated: DataFrame, reach: float = 1.0, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(_lang, _source, hi_<signal>, lo_<two-sided signal>): fences per group, `reach` times as far as SIGNALS says; a small group takes its language's, then everyone's.

    One KLL sketch per signal and group, built map-side and checkpointed (a few kB per group); the language's and the
    total sketch are merges of those, so the rows are read and aggregated once. Null languages and sources are groups of their own.
    """
    group = settle(rated.groupBy("_lang", "_source").agg(F.count("*").alias("n"), *[F.expr(f"kll_sketch_agg_double({s})").alias(s) for s in SIGNALS]))
    merged = lambda keys: group.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.expr(f"kll_merge_agg_double({s})").alias(s) for s in SIGNALS])

    def named(df: DataFrame, tag: str, keys: list[str]) -> DataFrame:
        out = df.select(*keys, F.col("n").alias(f"n_{tag}"), *[F.expr(f"kll_sketch_get_quantile_double({s}, array(0.25D, 0.5D, 0.75D))").alias(s) for s in SIGNALS])

        def fence(s: str) -> Column:
            wide, alike = SIGNALS[s]
            spread = F.col(s)[2] - F.col(s)[0]
            away = reach * F.when(spread > 0, wide * spread).otherwise(alike)
            return F.struct((F.col(s)[1] - away).alias("lo"), (F.col(s)[1] + away).alias("hi")).alias(f"{s}_{tag}")

        return out.select(*keys, f"n_{tag}", *map(fence, SIGNALS))

    by_group = named(group, "g", ["_lang", "_source"])
    by_lang = named(merged(["_lang"]), "l", ["_lang"]).withColumnRenamed("_lang", "_lang2")
    over_all = named(merged([]), "a", []).withColumn("_one", F.lit(1))
    joined = by_group.withColumn("_one", F.lit(1)).join(by_lang, F.col("_lang").eqNullSafe(F.col("_lang2")), "left").join(F.broadcast(over_all), "_one", "left")  # one row
    pick = lambda s: F.when(F.col("n_g") >= least_rows, F.col(f"{s}_g")).when(F.col("n_l") >= least_rows, F.col(f"{s}_l")).otherwise(F.col(f"{s}_a"))
    return joined.select("_lang", "_source", *[pick(s)["hi"].alias(f"hi_{s[2:]}") for s in SIGNALS], *[pick(s)["lo"].alias(f"lo_{s[2:]}") for s in TWO_SIDED])


def judge(docs: DataFrame, keep: list[str], reach: float = 1.0, least_rows: int = LEAST_ROWS, store: bool = True) -> DataFrame:
    """The columns keep of docs, then signals, fences, base_failed and kept.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated windows. kept: not base_failed, and no
    signal beyond the fences that its language and source set (symbols and punctuation a word, repeated lines, words equal to
    the one before, characters a word; the last one on both sides). Null text counts as empty and is base_failed; null lang or
    source is a group of its own; repeated rows are judged alike; an empty table gives an empty result. `docs` needs
    text, lang, source; other columns don't matter unless named in keep. store: the signals are checkpointed, so texts are
    read once; right where keep is narrow. Without it, texts are read twice and nothing of them is written.
    """
    base = docs.select(*[quoted(c).alias(f"_k{i}") for i, c in enumerate(keep)], "text", F.col("lang").alias("_lang"), F.col("source").alias("_source"))
    own = [f"_k{i}" for i in range(len(keep))]
    rated = _rates(signals(base, [*own, "_lang", "_source"]))
    rated = settle(rated) if store else rated
    bounds = fences(rated if store else _rates(signals(base, ["_lang", "_source"])), reach, least_rows).select(F.col("_lang").alias("_l2"), F.col("_source").alias("_s2"), *(limits := [*[f"hi_{s[2:]}" for s in SIGNALS], *[f"lo_{s[2:]}" for s in TWO_SIDED]]))
    failed = (F.col("n_words") < BASE_LEAST_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))
    over = reduce(or_, [*[F.col(s) > F.col(f"hi_{s[2:]}") for s in SIGNALS], *[F.col(s) < F.col(f"lo_{s[2:]}") for s in TWO_SIDED]])
    bounds = small(bounds, bounds.count())
    joined = rated.join(bounds, F.col("_lang").eqNullSafe(F.col("_l2")) & F.col("_source").eqNullSafe(F.col("_s2")), "left")
    return joined.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        # One term of both sides of the join: a filter by it stays above, so no signal is computed a second time to filter early.
        (F.greatest(failed.cast("int"), over.cast("int")) == 0).alias("kept"),
        *limits,
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])


QUERIES = {"op8_quality_rules": op8_quality_rules}
SQL: dict[str, str] = {}
