"""Operator 12, fill-in-middle by relational units.

The units of a text (here its lines) become rows of an ordinal and a length; a running sum of the lengths says where
each unit ends; a document's cut requests meet the units by ordinal, and what comes back is two offsets per document, by
which the text is cut into prefix, middle and suffix. Units travel as two numbers under a 128-bit key of their
document; texts are shuffled once, when the offsets meet them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = (PREFIX, SUFFIX, MIDDLE)


def draws(seed: str, doc_id: Column) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of seed and decimal doc_id (null: none), as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def unit_ends(docs: DataFrame, key: list[str], unit: str = LINES) -> DataFrame:
    """key, ord (from 1), end: where each unit of text ends, in code points. Rows that are equal in key are taken once."""
    units = docs.select(*key, F.posexplode(F.regexp_extract_all("text", F.lit(unit), 0)).alias("ord", "unit"))
    once = units.groupBy(*key, (F.col("ord") + 1).alias("ord")).agg(F.max(F.length("unit")).cast("long").alias("chars"))
    return once.select(*key, "ord", F.sum("chars").over(W.partitionBy(*key).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)).alias("end"))


def cut_offsets(ends: DataFrame, requests: DataFrame, key: list[str]) -> DataFrame:
    """key, prefix_end, middle_end of requests (key, first, second): code points before the cuts after so many units."""
    met = requests.join(ends, key, "left")
    at = lambda c: F.coalesce(F.max(F.when(F.col("ord") == F.col(c), F.col("end"))), F.lit(0).cast("long"))
    return met.groupBy(*key).agg(at("first").alias("prefix_end"), at("second").alias("middle_end"))


def _lines(text: Column) -> Column:
    """How many lines LINES finds."""
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return (breaks + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


def fill_in_middle(docs: DataFrame, seed: str = "7:", percent: int = 100, suffix_first: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per row of docs (doc_id, text).

    n lines; two draws modulo n + 1 say after how many the prefix and the middle end. form: plain for empty texts (null is
    empty), texts that hold a marker and those beyond `percent` of the third draw; else spm for `suffix_first` percent of
    the fourth, else psm. Null doc_id draws as an empty one; repeated rows give a row each; other columns are ignored;
    long texts are whole; an empty table gives an empty result.
    """
    text, (h1, h2, h3, h4) = F.coalesce("text", F.lit("")), draws(seed, F.col("doc_id"))
    n = _lines(text)
    marked = F.lit(False)
    for m in _MARKS:
        marked |= text.contains(m)
    form = F.when((text == "") | marked | (h3 % 100 >= percent), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    key = ["k1", "k2"]
    named = docs.select("doc_id", text.alias("text"), n.alias("n"), form.alias("form"), F.xxhash64(text, "doc_id").alias("k1"), F.xxhash64(F.lit("units"), "doc_id", text).alias("k2"))
    cut = named.filter("form <> 'plain'")
    requests = cut.select(*key, F.least(h1 % (n + 1), h2 % (n + 1)).alias("first"), F.greatest(h1 % (n + 1), h2 % (n + 1)).alias("second"))
    offsets = cut_offsets(unit_ends(cut, key), requests.distinct(), key)
    met = named.join(offsets, key, "left")
    whole, p, m = F.col("text"), F.col("prefix_end"), F.col("middle_end")
    prefix, middle, suffix = whole.substr(F.lit(1), p.cast("int")), whole.substr((p + 1).cast("int"), (m - p).cast("int")), whole.substr((m + 1).cast("int"), F.length(whole))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", whole).when(F.col("form") == "psm", psm).otherwise(spm)
    return met.select("doc_id", "n", "form", p.alias("prefix_chars"), (m - p).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text from its output and form. No text that holds a marker is cut, and none can arise where parts meet."""
    parts = F.split(F.substring(output, len(PREFIX) + 1, 2**31 - 1), "|".join(_MARKS), -1)
    one, two, three = (F.get(parts, F.lit(k)) for k in range(3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
SQL = {
    "op12_fill_in_middle": r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS u1, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS u2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT *, coalesce(array_to_string(units[1:least(u1, u2)], ''), '') AS p, coalesce(array_to_string(units[least(u1, u2) + 1:greatest(u1, u2)], ''), '') AS m,
         coalesce(array_to_string(units[greatest(u1, u2) + 1:], ''), '') AS s
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
}
