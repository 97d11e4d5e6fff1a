"""Reports in one pass, with a history of runs: totals are observed while the rows are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .audit import SEVERITIES

RUN = "root string, mode string, seq long, total long, by_severity map<string,long>, by_category map<string,long>"


def totals(categories: tuple[str, ...]) -> dict[str, Column]:
    """What is observed of issues (severity, category): one figure each, zeros included."""
    count = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False)))
    return {"total": F.count(F.lit(1))} | {f"severity_{s}": count("severity", s) for s in SEVERITIES} | {f"category_{c}": count("category", c) for c in categories}


def write_report(issues: DataFrame, folder: str, root: str, mode: str, seq: int, categories: tuple[str, ...] = ("accessibility", "seo", "performance", "best-practices")) -> dict:
    """Writes issues as the rows of run seq and the run's record, in one pass over issues; returns the record.

    Rows stand in folder/rows/run=seq, the record in folder/runs/run=seq. A run that is written again replaces itself, so
    a retried job adds no second record; the record is written last and names a run only when its rows are whole.
    """
    spark, seen = issues.sparkSession, Observation()
    columns = [c.alias(n) for n, c in totals(categories).items()]
    issues.observe(seen, *columns).write.mode("overwrite").parquet(f"{folder}/rows/run={seq}")
    got = seen.get
    part = lambda prefix: {k[len(prefix) :]: v for k, v in got.items() if k.startswith(prefix)}
    record = {"root": root, "mode": mode, "seq": seq, "total": got["total"], "by_severity": part("severity_"), "by_category": part("category_")}
    spark.createDataFrame([tuple(record.values())], RUN).coalesce(1).write.mode("overwrite").parquet(f"{folder}/runs/run={seq}")
    return record


def history(spark: SparkSession, folder: str) -> DataFrame:
    """RUN of all runs whose record was written, with previous: the total of the run before of the same root and mode."""
    runs = spark.read.schema(f"{RUN}, run long").option("basePath", f"{folder}/runs").parquet(f"{folder}/runs").drop("run")
    return runs.withColumn("previous", F.lag("total").over(W.partitionBy("root", "mode").orderBy("seq")))


def report_rows(spark: SparkSession, folder: str, seq: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/rows/run={seq}")


def issue_lists(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """A JSON object per document (source): its counts by severity and its issues, worst first.

    Written as text this is the whole report, a line per document: one document's issues bound a row.
    """
    from .audit import severity_rank

    item = F.struct(severity_rank(F.col("severity")).alias("rank"), "rule_id", F.coalesce("line", F.lit(0)).alias("line"), "category", "severity", "confidence", "selector", "snippet", "fix_snippet")
    listed = issues.groupBy("source").agg(F.array_sort(F.collect_list(item)).alias("issues"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    met = documents.select("source").distinct().join(listed, "source", "left")
    shown = F.transform(F.coalesce("issues", F.array().cast(listed.schema["issues"].dataType)), lambda i: i.dropFields("rank"))
    counts = F.struct(*[F.coalesce(s, F.lit(0)).alias(s) for s in SEVERITIES])
    return met.select("source", F.to_json(F.struct("source", counts.alias("severities"), F.size(shown).alias("total"), shown.alias("issues"))).alias("value"))
