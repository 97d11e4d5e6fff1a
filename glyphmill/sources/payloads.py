"""JSON that engines and judges return, as issue and judgment rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AXE = "error string, violations array<struct<id:string,impact:string,help:string,description:string,helpUrl:string,tags:array<string>,nodes:array<struct<target:string,html:string,failureSummary:string>>>>, incomplete array<struct<id:string,impact:string,help:string,description:string,helpUrl:string,tags:array<string>,nodes:array<struct<target:string,html:string,failureSummary:string>>>>"
_HTMLCS = "error string, messages array<struct<type:int,code:string,msg:string,tag:string,html:string>>"
_STATES = "error string, findings array<struct<rule:string,selector:string,html:string,why:string>>"
# Measure, budget, severity, rule.
BUDGETS = [
    ("firstContentfulPaint", 1800.0, "serious", "perf-first-paint"),
    ("loadComplete", 5000.0, "moderate", "perf-load-time"),
    ("transferBytes", 1_600_000.0, "moderate", "perf-page-weight"),
    ("requestCount", 50.0, "minor", "perf-request-count"),
    ("domNodes", 1500.0, "moderate", "perf-dom-size"),
]


def strict_json(raw: Column, schema: str) -> Column:
    """The document as a struct; null if it is none."""
    read = F.from_json(raw, f"{schema}, _corrupt_record string")
    return F.when(read["_corrupt_record"].isNull(), read)


def relaxed_json(raw: Column, schema: str) -> Column:
    """The document, or what stands between its first { and last }."""
    return F.coalesce(strict_json(raw, schema), strict_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")), schema))


def _rows(df: DataFrame, rule: Column, severity: Column, engine: str, selector: Column, snippet: Column, confidence: Column, details: Column) -> DataFrame:
    return df.select("source", rule.alias("rule_id"), F.lit("accessibility").alias("category"), severity.alias("severity"), confidence.alias("confidence"), F.coalesce(selector, F.lit("")).alias("selector"), F.coalesce(snippet, F.lit("")).alias("snippet"), details.alias("details"), F.lit(engine).alias("engine"))


def _broken(df: DataFrame, engine: str) -> DataFrame:
    error = F.coalesce("p.error", F.when(F.col("p").isNull(), "engine returned a non-JSON result"))
    return _rows(df.withColumn("_e", error).filter("_e IS NOT NULL"), F.lit(engine), F.lit("moderate"), engine, F.lit(""), F.lit(""), F.lit("exact"), F.create_map(F.lit("engine_error"), F.col("_e")))


def axe_issues(payloads: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Issues of (source, payload); what the engine couldn't decide needs a browser; excluded: (rule) left out."""
    read = payloads.select("source", strict_json(F.col("payload"), _AXE).alias("p"))
    both = read.filter("p.error IS NULL").select("source", F.explode(F.array(F.struct(F.lit("violation").alias("bucket"), F.col("p.violations").alias("entries")), F.struct(F.lit("incomplete").alias("bucket"), F.col("p.incomplete").alias("entries")))).alias("b"))
    entries = both.select("source", "b.bucket", F.explode("b.entries").alias("e"))
    if excluded is not None:
        entries = entries.join(F.broadcast(excluded.select(F.col("rule").alias("_r"))), F.col("e.id") == F.col("_r"), "left_anti")  # a handful by hand
    found = entries.select("source", "bucket", "e", F.explode("e.nodes").alias("n"))
    severity = F.when(F.col("e.impact").isin("critical", "serious", "moderate", "minor"), F.col("e.impact")).otherwise("moderate")
    details = F.create_map(*[x for k, c in (("engine", F.lit("axe-core")), ("rule", F.col("e.id")), ("help", F.col("e.help")), ("why", F.col("n.failureSummary")), ("url", F.col("e.helpUrl")), ("bucket", F.col("bucket"))) for x in (F.lit(k), c)])
    rows = _rows(found, F.concat(F.lit("axe:"), F.col("e.id")), severity, "axe", F.col("n.target"), F.col("n.html"), F.when(F.col("bucket") == "incomplete", "needs-browser").otherwise("exact"), details)
    return rows.unionByName(_broken(read, "axe"))


def htmlcs_issues(payloads: DataFrame) -> DataFrame:
    """Errors and warnings of (source, payload); notices are no findings. Codes are cut to their first numeric part."""
    read = payloads.select("source", strict_json(F.col("payload"), _HTMLCS).alias("p"))
    found = read.filter("p.error IS NULL").select("source", F.explode("p.messages").alias("m")).filter("m.type IN (1, 2)")
    parts = F.split("m.code", r"\.")
    code = F.coalesce(F.get(F.filter(parts, lambda x: x.rlike("^[0-9]")), F.lit(0)), F.element_at(parts, -1))
    details = F.create_map(F.lit("engine"), F.lit("HTML_CodeSniffer"), F.lit("code"), F.col("m.code"), F.lit("why"), F.col("m.msg"), F.lit("element"), F.col("m.tag"))
    rows = _rows(found, F.concat(F.lit("htmlcs:"), code), F.when(F.col("m.type") == 1, "serious").otherwise("moderate"), "htmlcs", F.lit(""), F.col("m.html"), F.lit("exact"), details)
    return rows.unionByName(_broken(read, "htmlcs"))


def measurement_issues(payloads: DataFrame, budgets: list[tuple[str, float, str, str]] | None = None) -> DataFrame:
    """An issue where a measure of (source, payload) is over its budget."""
    budgets = budgets or BUDGETS
    schema = ", ".join(f"{b[0]} double" for b in budgets) + ", error string"
    read = payloads.select("source", strict_json(F.col("payload"), schema).alias("p")).filter("p IS NOT NULL AND p.error IS NULL")
    over = [F.when(F.col(f"p.{k}") > limit, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(k).alias("metric"), F.col(f"p.{k}").alias("value"), F.lit(limit).alias("budget"))) for k, limit, severity, rule in budgets]
    rows = read.select("source", F.explode(F.array_compact(F.array(*over))).alias("i")).select("source", "i.*")
    return rows.withColumns({"category": F.lit("performance"), "engine": F.lit("browser")})


# Severity of the checks of element states.
STATE_SEVERITY = {
    "keyboard-trap": "serious", "focus-not-visible": "serious", "focus-order-mismatch": "moderate",
    "hover-only-content": "moderate", "no-skip-link": "moderate", "focus-outside-viewport": "moderate",
}


def state_issues(payloads: DataFrame, severities: dict[str, str] | None = None) -> DataFrame:
    """Issues `state:*` of (source, payload); a check without a severity of its own is moderate."""
    table = severities or STATE_SEVERITY
    read = payloads.select("source", strict_json(F.col("payload"), _STATES).alias("p")).filter("p.error IS NULL")
    found = read.select("source", F.explode("p.findings").alias("f"))
    severity = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("f.rule")), F.lit("moderate"))
    return _rows(found, F.concat(F.lit("state:"), F.col("f.rule")), severity, "states", F.col("f.selector"), F.col("f.html"), F.lit("exact"), F.create_map(F.lit("why"), F.col("f.why")))


def judge_spans(replies: DataFrame) -> DataFrame:
    """(block_id, seq, start, end, score, error) of (block_id, text, reply): quotes placed in their text.

    A reply is {"findings": [{"quote", "score", "reason"}]} with anything around it. A quote that the text doesn't hold
    stands for the whole text; scores are clamped to 0..1; a reply that isn't JSON is an error row.
    """
    read = replies.withColumn("p", relaxed_json(F.col("reply"), "findings array<struct<quote:string,score:double,reason:string>>"))
    found = read.filter("p IS NOT NULL").select("block_id", "text", F.posexplode("p.findings").alias("seq", "f"))
    at = F.expr("locate(f.quote, text)")
    hit = (F.coalesce("f.quote", F.lit("")) != "") & (at > 0)
    start, end = F.when(hit, at - 1).otherwise(0), F.when(hit, at - 1 + F.length("f.quote")).otherwise(F.length("text"))
    rows = found.select("block_id", "seq", start.cast("int").alias("start"), end.cast("int").alias("end"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("f.score"))).alias("score"), F.lit(None).cast("string").alias("error"))
    broken = read.filter("p IS NULL").select("block_id", F.lit(0).alias("seq"), F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(0.0).alias("score"), F.lit("reply is not JSON").alias("error"))
    return rows.unionByName(broken)
