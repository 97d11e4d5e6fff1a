"""Where a plan is cut: reliable checkpoints in the folder that the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; where it is unset, a temporary folder, on a local master only."""
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not made.isDefined():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(base or f"file://{tempfile.mkdtemp(prefix='glyphmill-')}")
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
    return made.get()


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir, which all executors share; where it is unset, in a temporary folder on a local master only.

    For what several plans read and is dear to make again (parsed markup), or what an iteration would pile up.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the folder of checkpoints: packed by column, so it takes a small part of a checkpoint's disk and plans read the columns they ask for."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """A table as it was read, dealt to all cores if its files are too few for them; one of many files stays where it is."""
    tasks = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(tasks) if table.rdd.getNumPartitions() < tasks else table


#: Values of an order that one window ranks at most.
STRETCH = 100_000


def numbered(df: DataFrame, *order: str, name: str = "number", tasks: int = 0) -> DataFrame:
    """df with its rows numbered from 0 in the given order, which decides between any two rows.

    Rows are dealt to tasks by ranges of the order, numbered in each, and moved by how many stand in the ranges before:
    no task sees them all. The driver gets one count per range.
    """
    ranged = df.repartitionByRange(tasks, *order) if tasks else df.repartitionByRange(*order)
    sorted_ = settle(ranged.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_id", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("n"), F.min("_id").alias("first")).orderBy("_part").collect()
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r._part, total - r.first))
        total += r.n
    if not offsets:
        return sorted_.drop("_id").withColumn(name, F.lit(0).cast("long"))
    moved = F.element_at(F.create_map(*[F.lit(x) for pair in offsets for x in pair]), part)
    return sorted_.withColumn(name, (F.col("_id") + moved).cast("long")).drop("_id")


def ranked(df: DataFrame, key: list[str], seq: str = "seq", stretch: int = STRETCH) -> DataFrame:
    """df with rank, from 0 in the order of seq (a long that is unique within a key) among the rows of equal keys; nulls are equal.

    Rows of a key are cut into stretches of seq; each is ranked alone, and the sizes of those before it are added.
    """
    cut = df.withColumn("_stretch", F.floor(F.col(seq) / stretch))
    sizes = cut.groupBy(*key, "_stretch").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(W.partitionBy(*key).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = cut.withColumn("_in", F.row_number().over(W.partitionBy(*key, "_stretch").orderBy(seq)) - 1)
    met = inside.alias("a").join(before.alias("b"), alike("a", "b", [*key, "_stretch"]))
    return met.select("a.*", (F.col("b._before") + F.col("a._in")).alias("rank")).drop("_stretch", "_in")


def alike(a: str, b: str, columns: list[str]) -> Column:
    """Equality of all columns of two aliases, nulls being equal."""
    out = F.lit(True)
    for c in columns:
        out &= F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`"))
    return out
