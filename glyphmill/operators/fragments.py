"""Audit of source files: which files are audited and as what is decided by path, before contents are read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import audit
from .code_blocks import mask

# Suffixes of source code and parts of names that aren't audited, and suffixes of whole pages.
SKIPPED_SUFFIXES = (".tsx", ".jsx", ".mjs", ".ts", ".js", ".py", ".rb", ".go", ".rs", ".java", ".c", ".cpp", ".h")
SKIPPED_PARTS = ("test", "spec", "__tests__", "node_modules", ".min.")
PAGES = (".html", ".htm", ".xhtml")


def audited(path: Column, skipped: tuple[str, ...] = SKIPPED_SUFFIXES) -> Column:
    """Whether a file of that path is audited at all."""
    low, out = F.lower(path), F.lit(True)
    for suffix in skipped:
        out &= ~low.endswith(suffix)
    for part in SKIPPED_PARTS:
        out &= ~F.contains(low, F.lit(part))
    return out


def kind_of(path: Column) -> Column:
    """page for a document of its own, fragment for anything else that holds markup."""
    return F.when(F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1)).isin(*PAGES), "page").otherwise("fragment")


def masked(fragments: DataFrame) -> DataFrame:
    """fragments (path, text) with comments, scripts and styles as blanks: every other character stays where it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [mask(t, "." + p.rsplit(".", 1)[-1].lower() if "." in p.rsplit("/", 1)[-1] else "") for p, t in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "text"])

    return fragments.select("path", "text").mapInArrow(run, "path string, text string")


def audit_files(files: DataFrame, skipped: tuple[str, ...] = SKIPPED_SUFFIXES) -> DataFrame:
    """Issues of files (path, text; error rows have a null text): see audit.issues(); doc_id and source are the path.

    Pages are read as they are. In fragments comments don't count, rules about whole pages are silent, and lines are those
    of the file. A file without < isn't read at all; with another `skipped` components are audited, too.
    """
    chosen = files.select("path", "text").filter(audited(F.col("path"), skipped)).filter(F.contains("text", F.lit("<"))).withColumn("kind", kind_of(F.col("path")))
    pages = chosen.filter("kind = 'page'").select("path", "text")
    pieces = masked(chosen.filter("kind = 'fragment'"))
    docs = pages.withColumn("kind", F.lit("page")).unionByName(pieces.withColumn("kind", F.lit("fragment")))
    return audit(docs.select(F.col("path").alias("doc_id"), F.col("path").alias("source"), "kind", F.col("text").alias("html")))
