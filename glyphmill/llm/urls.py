"""Operator 4, URL filters by a sort-merge range join.

A rule (host, path) holds for its host and all subdomains below its path prefix. With the host's labels reversed and
the path behind them, the addresses under a rule are one interval of keys: [prefix, prefix + 0xFF). An address has one
such key for every number of labels that rules name. Keys and interval ends are sorted together and swept in order; the
sweep keeps a stack of the rules whose intervals are open (rules below one another nest, they never cross), and the
innermost is the longest path that fits. The longest rule over all label counts wins.

The stack is a set of window columns, one per nesting level. Windows are cut by (reversed host prefix, salt): no rule
reaches beyond its own host prefix, and a prefix with many addresses is dealt over as many windows as it needs, each
with a copy of that prefix's rules. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import quoted, settle

#: Addresses that one window sweeps, about; at least RULE_SHARE times the rules that it is given a copy of.
WINDOW_ROWS, RULE_SHARE = 2_000, 10
#: The rules of op4: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: What an address gets that no rule fits.
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; without ://, empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _prefix(labels: Column, depth: Column) -> Column:
    """The first labels of the reversed host, each with a / behind it (a host has no /)."""
    return F.concat(F.array_join(F.slice(labels, F.lit(1), depth), "/"), F.lit("/"))


def _reversed(host_: Column) -> Column:
    return F.reverse(F.split(host_, r"\."))


def _sweep(events: DataFrame, part: list[str], levels: int) -> DataFrame:
    """Adds active, the innermost open rule at each event, by a sweep in key order.

    events: key binary, kind int (0 an interval's end, 1 its start, 2 a probe), level int, rule struct.
    """
    order = W.partitionBy(*part).orderBy("key", "kind", "level").rowsBetween(W.unboundedPreceding, 0)
    depth = F.sum(F.when(F.col("kind") == 1, 1).when(F.col("kind") == 0, -1).otherwise(0)).over(order)
    stack = [F.last(F.when((F.col("kind") == 1) & (F.col("level") == k + 1), F.col("rule")), ignorenulls=True).over(order) for k in range(levels)]
    return events.withColumn("_depth", depth).withColumns({f"_s{k}": c for k, c in enumerate(stack)}).withColumn(
        "active", F.when(F.col("_depth") > 0, F.get(F.array(*[F.col(f"_s{k}") for k in range(levels)]), F.col("_depth") - 1))
    )


def rule_keys(rules: DataFrame) -> DataFrame:
    """(depth, prefix, lo, hi, level, rule) of rules (host, path, verdict); of equal (host, path) the least verdict stays.

    level: 1 for a rule inside no other of its host, 2 inside one such, and so on: the sweep's own stack, on the rules.
    """
    named = rules.filter(F.col("host").isNotNull() & (F.col("host") != "")).groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.min("verdict").alias("verdict"))
    labels = _reversed(F.col("host"))
    keyed = named.select(
        F.size(labels).alias("depth"), _prefix(labels, F.size(labels)).alias("prefix"), "path",
        F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("hosts"), F.concat("host", "path").alias("rule"), "verdict").alias("rule"),
    )
    keyed = keyed.withColumn("lo", F.concat("prefix", F.lit("?"), "path").cast("binary")).withColumn("hi", F.concat(F.col("lo"), F.unhex(F.lit("FF"))))
    ends = keyed.select("depth", "prefix", F.explode(F.array(F.struct(F.col("lo").alias("key"), F.lit(1).alias("kind"), F.lit(1).alias("step")), F.struct(F.col("hi").alias("key"), F.lit(0).alias("kind"), F.lit(-1).alias("step")))).alias("e"))
    order = W.partitionBy("depth", "prefix").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)
    level = ends.select("depth", "prefix", "e.*").withColumn("level", F.sum("step").over(order)).filter("kind = 1").select("depth", "prefix", F.col("key").alias("lo"), "level")
    return keyed.join(level, ["depth", "prefix", "lo"]).select("depth", "prefix", "lo", "hi", F.col("level").cast("int").alias("level"), "rule")


def filter_urls(pages: DataFrame, rules: DataFrame, keep: list[str], default: str = DEFAULT, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """The columns keep of pages, then host, path, rule and verdict.

    rule: the longest that fits (by characters of host and path; then the longer host), host and path as one string, or
    null; verdict: its own, else `default`. A null url or one without :// has an empty host, which no rule fits. Distinct
    addresses are swept once, so copies cost nothing; repeated rows and an empty table pass through; without rules, all
    get the default. Extra columns of pages are ignored unless named in keep.
    """
    ruled = settle(rule_keys(rules))
    shape = ruled.agg(F.max("level"), F.collect_set("depth")).first()
    own = [f"_k{i}" for i in range(len(keep))]
    named = pages.select(*[quoted(c).alias(o) for c, o in zip(keep, own, strict=True)], host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    back = dict(zip(own, keep, strict=True))
    if not shape[1]:
        return named.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}).withColumnsRenamed(back)
    unique = named.select("host", "path").distinct()
    labels = _reversed(F.col("host"))
    depths = F.filter(F.array(*[F.lit(d) for d in sorted(shape[1])]), lambda d: d <= F.size(labels))
    probes = unique.withColumn("depth", F.explode(depths)).withColumn("prefix", _prefix(labels, F.col("depth")))
    heads = ruled.groupBy("depth", "prefix").agg(F.count("*").alias("rules"))
    probes = settle(probes.join(heads.select("depth", "prefix"), ["depth", "prefix"], "left_semi"))
    asked_of = probes.groupBy("depth", "prefix").agg(F.count("*").alias("n")).join(heads, ["depth", "prefix"])
    salts = asked_of.select("depth", "prefix", F.ceil(F.col("n") / F.greatest(F.lit(window_rows), RULE_SHARE * F.col("rules"))).cast("int").alias("salts"))
    nothing = F.lit(None).cast(ruled.schema["rule"].dataType)
    asked = probes.join(salts, ["depth", "prefix"]).select(
        "depth", "prefix", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int").alias("salt"),
        F.concat("prefix", F.lit("?"), "path").cast("binary").alias("key"), F.lit(2).alias("kind"), F.lit(0).alias("level"), nothing.alias("rule"), "host", "path",
    )
    copies = ruled.join(salts, ["depth", "prefix"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    empty = F.lit(None).cast("string")
    ends = copies.select("depth", "prefix", "salt", F.explode(F.array(F.struct(F.col("lo").alias("key"), F.lit(1).alias("kind")), F.struct(F.col("hi").alias("key"), F.lit(0).alias("kind")))).alias("e"), "level", "rule")
    ends = ends.select("depth", "prefix", "salt", "e.key", "e.kind", "level", "rule", empty.alias("host"), empty.alias("path"))
    dealt = asked.unionByName(ends).repartition("depth", "prefix", "salt")  # by itself the plan would leave out the salt
    swept = _sweep(dealt, ["depth", "prefix", "salt"], shape[0]).filter((F.col("kind") == 2) & F.col("active").isNotNull())
    won = swept.groupBy("host", "path").agg(F.max("active").alias("won"))
    joined = named.join(won.withColumnsRenamed({"host": "_h", "path": "_p"}), (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return joined.select(*own, "host", "path", F.col("won.rule").alias("rule"), F.coalesce(F.col("won.verdict"), F.lit(default)).alias("verdict")).withColumnsRenamed(back)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules, ["page_id"])


QUERIES = {"op4_url_filters": op4_url_filters}
SQL = {
    "op4_url_filters": r"""
WITH named AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), rules(h, p, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), keyed AS (SELECT row_number() OVER () AS k, * FROM named),
fits AS (
  SELECT k, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM keyed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM keyed LEFT JOIN fits USING (k)
"""
}
