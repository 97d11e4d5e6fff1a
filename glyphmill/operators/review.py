"""Elements whose wording is worth a second opinion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How much of what surrounds an element goes with it, and after how much no more is gathered.
CONTEXT, ADDRESS, GATHERED = 300, 80, 400
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
UNSEEN = ["script", "style", "template", "noscript"]


def following_text(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, context) of each heading that elements follow beside it: their text up to the next heading, 300 characters.

    rows: DOM rows. A section is a range of the document's texts, from the heading's end to the next heading under the same
    parent or the parent's end; it meets its first texts by their numbers, never more than it shows.
    """
    shown = (F.col("tag") == "#text") & ~F.arrays_overlap("ancestors", F.array(*[F.lit(t) for t in UNSEEN])) & (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    by_doc = W.partitionBy("doc_id").orderBy("pos")
    numbered = rows.select("doc_id", "pos", "parent", "parent_last", "last", "tag", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), shown.alias("shown")).withColumn("n", F.count_if("shown").over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
    texts = numbered.filter("shown").select("doc_id", "n", "text", "parent")
    heads = rows.filter(F.col("tag").isin(HEADINGS)).select("doc_id", "pos", "last", (F.lead("pos").over(W.partitionBy("doc_id", "parent").orderBy("pos")) - 1).alias("_next"), "parent_last", "parent")
    heads = heads.withColumn("_end", F.coalesce("_next", F.when(F.col("parent") >= 0, F.col("parent_last")), F.col("parent_last") - 1))
    at = lambda name, c: numbered.select("doc_id", F.col("pos").alias(c), F.col("n").alias(name))
    ranged = heads.join(at("_from", "last"), ["doc_id", "last"]).join(at("_to", "_end"), ["doc_id", "_end"])
    asked = ranged.filter("_to > _from").select("doc_id", "pos", "parent", F.explode(F.sequence(F.col("_from") + 1, F.least(F.col("_to"), F.col("_from") + GATHERED + 1))).alias("n"))
    owned = asked.join(texts.withColumnRenamed("parent", "_beside"), ["doc_id", "n"]).filter(F.col("_beside") != F.col("parent"))
    so_far = F.coalesce(F.sum(F.length("text")).over(W.partitionBy("doc_id", "pos").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    near = owned.withColumn("_so_far", so_far).filter(F.col("_so_far") <= GATHERED)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ")
    return near.groupBy("doc_id", "pos").agg(F.substring(joined, 1, CONTEXT).alias("context"))


def review_candidates(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, text, context, selector, line): images' texts, links, headings with what follows, buttons.

    Only elements that have text: what lacks it is a finding already. rows: DOM rows of whole documents.
    """
    attr = lambda name: F.trim(F.coalesce(F.try_element_at("attr", F.lit(name)), F.lit("")))
    own = F.coalesce("text", F.lit(""))
    kind = F.when(F.col("tag") == "img", "img").when((F.col("tag") == "a") & F.map_contains_key("attr", F.lit("href")), "link").when(F.col("tag").isin(HEADINGS), "heading").when(F.col("tag") == "button", "button")
    text = F.when(F.col("tag") == "img", attr("alt")).when((F.col("tag") == "button") & (own == ""), attr("aria-label")).otherwise(own)
    address = F.when(F.col("tag") == "img", F.substring(attr("src"), 1, ADDRESS)).when(F.col("tag") == "a", F.substring(attr("href"), 1, ADDRESS)).otherwise("")
    found = rows.select("doc_id", "pos", kind.alias("kind"), text.alias("text"), address.alias("_address"), "selector", "line").filter("kind IS NOT NULL AND text <> ''")
    return found.join(following_text(rows), ["doc_id", "pos"], "left").select("doc_id", "pos", "kind", "text", F.when(F.col("kind") == "heading", F.coalesce("context", F.lit(""))).otherwise(F.col("_address")).alias("context"), "selector", "line")
