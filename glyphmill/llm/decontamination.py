r"""Operator 11, benchmark decontamination by a distributed positional inverted index.

The index holds a posting (text key, term, position) for every training word that a test item may ask for, sorted by term
within the documents' own partitions: it is made in one narrow pass, without a shuffle, and written once to the shared
folder. A test item is asked for by its windows of ten words. The posting lists of a window's rarest terms come first:
each occurrence of the rarest names an alignment of item and text (its position less its offset in the item), the list
of the second rarest, adjusted by its own offset, keeps the alignments where both stand, and only their windows ask for
the remaining lists. What is matched in every position is an exact phrase; `near_matches` intersects the same lists
within a reach instead, for proximity.

Words are A-Z lower-cased, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+. A term is the word's 64-bit hash and a text key two such
hashes of the whole text, so equal texts are asked once. A sieve of bounded size (3 % of other words pass in vain, more
beyond half a million terms) keeps words out of the index that no item holds. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Shelf, settle, sieve, small

WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, before A-Z are lower-cased.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KEY = ["k1", "k2"]


def _pieces(text: Column) -> Column:
    """Words and, at a text's ends, empty strings. Positions are indices here."""
    return F.split(text, _GAP, -1)


def _lowered(word: Column) -> Column:
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(_pieces(F.coalesce(text, F.lit(""))), "")).cast("long")


def text_key(text: Column) -> list[Column]:
    """k1, k2: the key under which a text's postings and spans stand."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2")]


def postings(docs: DataFrame, terms: DataFrame | None = None, n: int = 0) -> DataFrame:
    """(k1, k2, term, pos) of texts, sorted by term in each partition; of those words whose term may be among terms (k; about n of them).

    Null texts have no words; equal texts have a posting each.
    """
    texts = docs.filter(F.col("text").isNotNull()).select(*text_key(F.col("text")), "text")
    found = texts.select(*KEY, F.posexplode(_pieces(F.col("text"))).alias("pos", "word")).filter("word <> ''")
    found = found.select(*KEY, F.xxhash64(_lowered(F.col("word"))).alias("term"), "pos")
    if terms is not None:
        found = sieve(found, F.col("term"), terms, n).filter("maybe").select(*KEY, "term", "pos")
    return found.sortWithinPartitions("term")


class Items:
    """Test items as relations: texts (item, size), terms (item, p, term), windows (item, s, size) and ids (item, item_id).

    Items of the same words are one item with several ids; items without words are none.
    """

    def __init__(self, items: DataFrame, shelf: Shelf, width: int) -> None:
        words = F.transform(F.filter(_pieces(F.coalesce("text", F.lit(""))), lambda w: w != ""), _lowered)
        asked = items.select("item_id", words.alias("words")).filter(F.size("words") > 0)
        once = shelf.put(asked.select("words").distinct().withColumn("item", F.monotonically_increasing_id()))
        self.ids = asked.join(once, "words").select("item", "item_id").distinct()
        self.texts = once.select("item", F.size("words").alias("words"), F.least(F.size("words"), F.lit(width)).alias("size"))
        self.terms = shelf.put(once.select("item", F.posexplode("words").alias("p", "word")).select("item", "p", F.xxhash64("word").alias("term")))
        self.windows = self.texts.select("item", F.explode(F.sequence(F.lit(0), F.col("words") - F.col("size"))).alias("s"), "size")
        self.distinct = self.terms.select(F.col("term").alias("k")).distinct()

    def spread(self) -> DataFrame:
        """(item, s, size, p, term): each window's terms."""
        return self.windows.select("item", "s", "size", F.explode(F.expr("sequence(s, s + size - 1)")).alias("p")).join(self.terms, ["item", "p"])


def _leads(index: DataFrame, items: Items) -> DataFrame:
    """(item, s, size, p1, term1, p2, term2): a window's rarest term in the index and the next one (the same, if it has but one).

    A window with a term that the index lacks is left out: it occurs nowhere.
    """
    often = index.groupBy("term").agg(F.count("*").alias("n")).join(items.distinct.withColumnRenamed("k", "term"), "term", "left_semi")
    ranked = items.spread().join(often, "term").groupBy("item", "s", "size").agg(F.sort_array(F.collect_list(F.struct("n", "p", "term"))).alias("t"))
    second = F.coalesce(F.get("t", F.lit(1)), F.get("t", F.lit(0)))
    return ranked.filter(F.size("t") == F.col("size")).select("item", "s", "size", F.col("t")[0]["p"].alias("p1"), F.col("t")[0]["term"].alias("term1"), second["p"].alias("p2"), second["term"].alias("term2"))


def _held(asked: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """Those of asked (k1, k2, term, pos, ...; n rows) that have a posting. Postings that nothing asks for stay out of the shuffle, but for a few."""
    whole = F.xxhash64(*KEY, "term", "pos")
    near = sieve(index, whole, asked.select(whole.alias("k")).distinct(), n).filter("maybe").select(*KEY, "term", "pos")
    return asked.join(near, [*KEY, "term", "pos"], "left_semi")


def _first(index: DataFrame, leads: DataFrame) -> DataFrame:
    """(k1, k2, item, p1, diagonal): occurrences of the rarest terms; diagonal: where the item's word 0 would stand."""
    lists = leads.select("item", "p1", F.col("term1").alias("term")).distinct()
    met = index.join(small(lists, lists.count()), "term")
    return met.select(*KEY, "item", "p1", (F.col("pos") - F.col("p1")).alias("diagonal")).distinct()


def phrase_spans(index: DataFrame, items: Items, shelf: Shelf) -> DataFrame:
    """(k1, k2, item, start, stop): the longest stretches of an item, of a window or more, that stand in a text word for word.

    start and stop are positions, both included.
    """
    leads = shelf.put(_leads(index, items))
    one = shelf.put(_first(index, leads))
    pairs = leads.select("item", "p1", "p2", F.col("term2").alias("term")).distinct()
    asked = shelf.put(one.join(small(pairs, pairs.count()), ["item", "p1"]).withColumn("pos", F.col("diagonal") + F.col("p2")).filter("pos >= 0"))
    seconds = pairs.select("term").distinct()
    listed = index.join(small(seconds, seconds.count()), "term", "left_semi")  # the lists of second terms alone
    two = shelf.put(_held(asked, listed, asked.count()))
    rest = two.join(leads.select("item", "p1", "p2", "s", "size"), ["item", "p1", "p2"]).filter("diagonal + s >= 0")
    rest = rest.select(*KEY, "item", "diagonal", F.explode(F.expr("sequence(s, s + size - 1)")).alias("p")).distinct()
    asked = shelf.put(rest.join(items.terms, ["item", "p"]).withColumn("pos", F.col("diagonal") + F.col("p")))
    here = _held(asked, index, asked.count())
    line = W.partitionBy(*KEY, "item", "diagonal").orderBy("p")
    runs = here.withColumn("run", F.col("p") - F.row_number().over(line)).groupBy(*KEY, "item", "diagonal", "run").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"))
    return runs.join(items.texts, "item").filter("stop - start + 1 >= size").select(*KEY, "item", "start", "stop")


def _within(asked: DataFrame, index: DataFrame, reach: int) -> DataFrame:
    """(k1, k2, item, s, anchor, term, off): for asked (k1, k2, item, s, anchor, term) with a posting at most reach words away, the nearest one's distance."""
    cell = lambda c: F.floor(c / F.lit(reach))
    spread = asked.withColumn("cell", F.explode(F.array(*[cell(F.col("anchor")) + d for d in (-1, 0, 1)])))
    near = sieve(index, F.col("k1"), asked.select(F.col("k1").alias("k")).distinct(), asked.count()).filter("maybe")
    met = spread.join(near.select(*KEY, "term", "pos", cell(F.col("pos")).alias("cell")).distinct(), [*KEY, "term", "cell"])
    off = F.abs(F.col("pos") - F.col("anchor"))
    return met.filter(off <= reach).groupBy(*KEY, "item", "s", "anchor", "term").agg(F.min(F.struct(off.alias("far"), "pos"))["pos"].alias("pos"))


def near_matches(index: DataFrame, items: Items, shelf: Shelf, reach: int) -> DataFrame:
    """(k1, k2, item, s, anchor, start, stop): windows all of whose terms stand within reach words of an occurrence (anchor) of the rarest.

    In any order; a term that a window holds twice need stand there once. start and stop bound the nearest occurrences.
    """
    leads = shelf.put(_leads(index, items))
    lists = leads.select("item", "s", F.col("term1").alias("term"), "term2").distinct()
    first = index.join(small(lists, lists.count()), "term").select(*KEY, "item", "s", F.col("pos").alias("anchor"), F.col("term2").alias("term")).distinct()
    two = shelf.put(_within(shelf.put(first), index, reach).select(*KEY, "item", "s", "anchor"))
    need = items.spread().select("item", "s", "term").distinct()
    met = _within(shelf.put(two.join(need, ["item", "s"])), index, reach)
    found = met.groupBy(*KEY, "item", "s", "anchor").agg(F.count("*").alias("n"), F.min("pos").alias("start"), F.max("pos").alias("stop"))
    whole = need.groupBy("item", "s").agg(F.count("*").alias("n"))
    return found.join(whole, ["item", "s", "n"]).select(*KEY, "item", "s", "anchor", "start", "stop")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of docs (doc_id, text).

    A window is `width` words of an item in a row, or the whole of a shorter item; a word inside any occurrence of one is
    hit. items_sha256: of the item_ids with occurring windows, sorted as strings, joined by commas; none: of ''. Null and
    empty texts have no words and aren't contaminated; null doc_id is kept; repeated rows give a row each; an item_id that
    is null marks words but is neither counted nor listed; other columns are ignored; without documents the result is
    empty, without items nothing is hit. Texts and items may have any length.
    """
    shelf = Shelf(docs.sparkSession)
    items = Items(benchmark, shelf, width)
    index = shelf.put(postings(docs, items.distinct, items.distinct.count()))
    spans = shelf.put(phrase_spans(index, items, shelf))
    hit = spans.select(*KEY, F.explode(F.expr("sequence(start, stop)")).alias("pos")).distinct().groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    named = spans.select(*KEY, "item").distinct().join(items.ids, "item").select(*KEY, "item_id").distinct()
    listed = named.groupBy(*KEY).agg(F.count("item_id").alias("n_items"), F.array_join(F.sort_array(F.collect_list(F.col("item_id").cast("string"))), ",").alias("listed"))
    found = settle(hit.join(listed, KEY))
    shelf.close()
    key1, key2 = text_key(F.col("text"))
    out = docs.select("doc_id", n_words(F.col("text")).alias("n_words"), key1, key2).join(small(found, found.count()), KEY, "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("listed", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op11_benchmark_decontamination": op11_benchmark_decontamination}
SQL = {
    "op11_benchmark_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)
), grams AS (
  SELECT r, s, size, array_to_string(w[s:s + size - 1], ' ') AS gram
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), found AS (SELECT r, s, size, item_id FROM grams JOIN windows USING (size, gram)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS p FROM found) GROUP BY r),
listed AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
"""
}
