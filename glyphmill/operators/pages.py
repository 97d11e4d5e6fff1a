"""Web pages: blocks of copy, links, diagnosis, and the crawl over a link relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.dom import elements, nodes
from .stage import numbered, settle

# Fixed values.
SKIP = ["script", "style", "noscript", "template", "svg", "path", "iframe", "head", "meta", "link"]
CANDIDATES = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "a", "button", "span", "figcaption", "blockquote", "td", "th", "label"]
CONTAINERS = ["div", "section", "article", "dd", "dt", "figure", "summary", "caption"]
SHORTEST, BLOCKED = 20, [401, 403, 405, 429]


def _block_id(kind: str):
    return F.substring(F.sha2(F.concat_ws("|", F.col("source"), F.col("selector"), F.col("pos").cast("string"), F.lit(kind)), 256), 1, 16)


def page_blocks(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, tallies) of pages (doc_id, source, html).

    A block is a candidate element's text of 20 characters or more, outside what is never read, unless an element around
    it has the same text; or the text that stands directly in a container. tallies: candidates, kept, dropped by reason.
    """
    rows = settle(nodes(pages, "doc_id", "html", "source"))
    e = elements(rows)
    c = e.filter(F.col("tag").isin(CANDIDATES)).withColumn("skipped", F.arrays_overlap("ancestors", F.array(*[F.lit(s) for s in SKIP])))
    judged = c.withColumn("fate", F.when(F.col("skipped"), "skipped").when(F.length("text") < SHORTEST, F.when(F.col("text") != "", "short").otherwise("empty")).when(F.col("repeats"), "repeat").otherwise("kept"))
    own = e.filter(F.col("tag").isin(CONTAINERS) & ~F.arrays_overlap("ancestors", F.array(*[F.lit(s) for s in SKIP])) & (F.col("own") != ""))
    own = own.withColumn("fate", F.when(F.length("own") < SHORTEST, "short").otherwise("kept"))
    cols = lambda text, kind: (_block_id(kind).alias("block_id"), F.col("doc_id"), F.col("source"), F.col("selector").alias("dom_path"), F.col("pos"), F.col("line"), F.col(text).alias("text"), T.guess_language(F.col(text)).alias("language_hint"), F.lit(kind).alias("kind"))
    blocks = judged.filter("fate = 'kept'").select(*cols("text", "element")).unionByName(own.filter("fate = 'kept'").select(*cols("own", "container")))
    fates = judged.select("doc_id", "fate", F.lit(1).alias("candidate")).unionByName(own.select("doc_id", "fate", F.lit(0).alias("candidate")))
    tallies = fates.groupBy("doc_id").agg(F.sum("candidate").alias("candidates_found"), F.count_if(F.col("fate") == "kept").alias("blocks_kept"), F.count_if(F.col("fate") == "short").alias("dropped_too_short"), F.count_if(F.col("fate") == "repeat").alias("dropped_duplicate"))
    return blocks, tallies


def diagnose(pages: DataFrame, tallies: DataFrame) -> DataFrame:
    """Why a page gave little: pages (doc_id, source, html, status_code, final_url) with measures and reasons."""
    joined = pages.join(tallies, "doc_id", "left").fillna(0, ["candidates_found", "blocks_kept", "dropped_too_short", "dropped_duplicate"])
    measured = joined.withColumns({"html_bytes": F.length("html"), "text_ratio": F.bround(T.text_ratio(F.col("html")), 4), "js_framework": T.framework(F.col("html")), "has_noscript_notice": F.contains(F.lower("html"), F.lit("<noscript"))})
    none = F.col("blocks_kept") == 0
    shell = (F.col("js_framework") != "") | ((F.col("text_ratio") < 0.05) & (F.col("html_bytes") > 500))
    why = F.when(shell, "js-rendered").when(F.col("dropped_too_short") > 0, "too-short").when((F.col("candidates_found") == 0) | (F.col("text_ratio") < 0.01), "no-text").otherwise("too-short")
    moved = F.coalesce(T.normalise_url(F.col("final_url")) != T.normalise_url(F.col("source")), F.lit(False))
    reasons = F.array_compact(F.array(F.when(moved, "redirected"), F.when(none & F.col("status_code").isin(BLOCKED), "blocked"), F.when(none, why)))
    return measured.withColumn("reasons", reasons).drop("html")


def needs_render(mode: str):
    """Whether a page goes to a browser: always, never, or where reading it gave nothing."""
    if mode == "auto":
        return F.array_contains("reasons", "js-rendered") | (F.col("blocks_kept") == 0)
    return F.lit(mode == "always")


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, nth) of pages (source, html): addresses of a[href], resolved and normalised; no anchors, mail or scripts.

    Attributes are read by pattern, without the tree: that keeps the whole operator inside one codegen span.
    """
    href = F.regexp_extract_all(F.regexp_replace("html", r"(?s)<!--.*?-->|<(script|style)\b.*?</\1\s*>", ""), F.lit(r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"), 1)
    rows = pages.select("source", F.posexplode(href).alias("nth", "raw"))
    bare = F.trim(F.replace(F.regexp_replace("raw", "^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&")))
    wanted = rows.withColumn("href", bare).filter((F.col("href") != "") & ~F.col("href").rlike("^(#|mailto:|tel:|javascript:)"))
    return wanted.select(F.col("source").alias("src"), T.normalise_url(T.resolve_url(F.col("source"), F.col("href"))).alias("dst"), "nth")


def crawl(edges: DataFrame, roots: DataFrame, max_pages: int = 30, same_domain: bool = True, max_depth: int = 50) -> DataFrame:
    """(url, depth, place) in breadth-first order from roots (url) over edges (src, dst, nth); 0 pages: without limit.

    One join per level: the frontier meets the edges, pages seen before drop out, and each level is settled. Pages of a
    level stand in the order in which the level before names them.
    """
    seen = settle(numbered(roots.select("url", F.lit(0).alias("depth")).distinct(), "url", name="place").withColumn("place", F.col("place") + 1))
    frontier, depth, total = seen, 0, seen.count()
    host = T.host_key
    while depth < max_depth and (not max_pages or total < max_pages):
        depth += 1
        out = frontier.join(edges, F.col("url") == F.col("src"))
        if same_domain:
            out = out.filter(host(F.col("src")) == host(F.col("dst")))
        new = out.groupBy("dst").agg(F.min(F.struct("place", "nth")).alias("o")).withColumnRenamed("dst", "url").join(seen.select("url"), "url", "left_anti")
        # a level is numbered by (place of the parent, place in the parent), in ranges
        new = new.orderBy("o", "url").limit(max_pages - total) if max_pages else new
        new = settle(numbered(new, "o", "url", name="place").select("url", F.lit(depth).alias("depth"), (F.col("place") + total + 1).alias("place")))
        n = new.count()
        if not n:
            break
        seen = settle(seen.unionByName(new))
        frontier, total = new, total + n
    return seen
