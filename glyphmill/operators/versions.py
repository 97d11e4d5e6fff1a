"""Backup and restore of a file table: versions in a folder, a manifest that says which one of each path counts.

A version is a folder of the texts that changed; a manifest is a table (path, version, first), where first is the version
that the path had before anything here changed it. A manifest is committed by its _SUCCESS mark, and the highest
committed one is the present state, so a run that dies leaves the state before it. Restoring is a new manifest that
points back: no text is copied, and the first copy of a path is never written over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "path string, version long, first long"


class Versions:
    """Versions of texts by path below one folder, on any store that Spark writes to. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str) -> tuple:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def current(self) -> int:
        """The number of the last committed manifest; 0 before the first."""
        fs, p = self._fs(f"{self.folder}/manifest")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [int(n) for n in names if n.isdigit() and fs.exists(self._fs(f"{self.folder}/manifest/{n}/_SUCCESS")[1])]
        return max(done, default=0)

    def manifest(self, number: int | None = None) -> DataFrame:
        n = self.current() if number is None else number
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest/{n}") if n else self.spark.createDataFrame([], _MANIFEST)

    def _texts(self, manifest: DataFrame) -> DataFrame:
        """(path, text) that a manifest points to. Versions are folders, so only those pointed to are read."""
        wanted = [r.version for r in manifest.select("version").distinct().collect()]  # one per run, not per file
        if not wanted:
            return self.spark.createDataFrame([], "path string, text string")
        stored = self.spark.read.schema("path string, text string, version long").option("basePath", f"{self.folder}/data").parquet(*[f"{self.folder}/data/version={v}" for v in wanted])
        return manifest.select("path", "version").join(stored, ["path", "version"]).select("path", "text")

    def files(self, number: int | None = None) -> DataFrame:
        """(path, text) of the present state, or of that after commit `number`."""
        return self._texts(self.manifest(number))

    def commit(self, files: DataFrame) -> int:
        """Puts files (path, text; one row per path) in place of those of the same paths and adds the rest; returns the commit's number.

        Only texts that differ are written. A path that is new here has its own text as first state.
        """
        now, number = self.manifest(), self.current() + 1
        fs, p = self._fs(f"{self.folder}/data/version={number}")
        fs.delete(p, True)  # what a run that died has left
        old = self._texts(now)
        changed = files.select("path", "text").join(old.withColumnRenamed("text", "_old"), "path", "left").join(now.select("path", F.lit(True).alias("_known")), "path", "left")
        changed = changed.filter(F.col("_known").isNull() | ~F.col("text").eqNullSafe(F.col("_old"))).select("path", "text")
        changed.write.parquet(f"{self.folder}/data/version={number}")
        made = self.spark.read.schema("path string, text string").parquet(f"{self.folder}/data/version={number}").select("path", F.lit(number).cast("long").alias("version"))
        merged = now.join(made.withColumnRenamed("version", "_new"), "path", "full").select("path", F.coalesce("_new", "version").alias("version"), F.coalesce("first", "_new").alias("first"))
        self._write(merged, number)
        return number

    def _write(self, manifest: DataFrame, number: int) -> None:
        fs, p = self._fs(f"{self.folder}/manifest/{number}")
        fs.delete(p, True)
        manifest.write.parquet(f"{self.folder}/manifest/{number}")

    def changed(self) -> DataFrame:
        """(path) of files that aren't in their first state: those that a restore would change."""
        return self.manifest().filter("version <> first").select("path")

    def restore(self, paths: DataFrame) -> DataFrame:
        """Points paths (path) back to their first state; (path, outcome): restored, unchanged (it is in it) or missing."""
        now, number = self.manifest(), self.current() + 1
        asked = paths.select("path").distinct()
        outcome = F.when(F.col("version").isNull(), "missing").when(F.col("version") == F.col("first"), "unchanged").otherwise("restored")
        said = asked.join(now, "path", "left").select("path", outcome.alias("outcome"))
        if number > 1:
            back = now.join(asked.withColumn("_asked", F.lit(True)), "path", "left")
            self._write(back.select("path", F.when(F.col("_asked"), F.col("first")).otherwise(F.col("version")).alias("version"), "first"), number)
        return said
