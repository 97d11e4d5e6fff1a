"""Shared helpers: the folder that all executors see, size-checked joins, word hashes, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few dozen bytes that may be broadcast after they were counted.
BROADCAST_ROWS = 50_000
#: ASCII white space, as a character class.
SPACE = r"[\x20\x09-\x0D]+"


def _own_dir(spark: SparkSession) -> str:
    """A temporary folder for checkpoints, on a local master only: no other machine reads it."""
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.mkdtemp(prefix='glyphmill-')}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset, a local master (tests) takes a temporary folder as checkpoint folder; a cluster fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        base = _own_dir(spark)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/glyphmill-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder that shared_dir() named, on whatever store it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        base = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(base or _own_dir(spark))
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marks df for broadcast only if its counted rows are few; else the planner shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Rows of a sieve at most, each of 64 slots: its size is bounded however many keys it has.
SIEVE_ROWS = 1 << 18


def sieve(df: DataFrame, key: Column, keys: DataFrame, n: int) -> DataFrame:
    """df with maybe: false for rows whose key (long) surely is none of keys (k long, about n); others need a join.

    A Bloom filter with one hash as a relation of words of 64 slots, at most SIEVE_ROWS rows, which is broadcast. It has
    about 32 slots for each key (3 % pass in vain) up to half a million keys, and lets more and more pass beyond.
    """
    rows = min(SIEVE_ROWS, max(1, n // 2))
    slot = lambda k: F.pmod(F.xxhash64(F.lit("sieve"), k), F.lit(rows * 64))
    words = keys.select(slot(F.col("k")).alias("_s")).groupBy(F.shiftright("_s", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, CAST(_s & 63 AS INT)))").alias("_bits"))
    placed = df.withColumn("_s", slot(key)).withColumn("_word", F.shiftright("_s", 6))
    set_ = F.expr("shiftrightunsigned(_bits, CAST(_s & 63 AS INT)) & 1L") == 1
    return placed.join(F.broadcast(words), "_word", "left").withColumn("maybe", F.coalesce(set_, F.lit(False))).drop("_s", "_word", "_bits")


def quoted(column: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def veil(docs: DataFrame, *needed: str) -> DataFrame:
    """All columns under neutral names c0, c1, ..., then the needed ones under their own, so that no name clashes."""
    return docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], *needed)


def unveil(df: DataFrame, docs: DataFrame) -> DataFrame:
    """Back to the columns of docs."""
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


# ---------------------------------------------------------------- 64-bit hashes on NumPy arrays

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """Murmur3's 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * _M1
        x = x ^ (x >> np.uint64(33))
        x = x * _M2
        return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1 << 16)
def seed(*parts: object) -> np.uint64:
    """A constant drawn from the parts; remembered, as inner loops ask for the same ones again and again."""
    h = np.array([0x9E3779B97F4A7C15], np.uint64)
    for b in "\x1f".join(map(str, parts)).encode():
        h = mix(h ^ np.uint64(b + 1))
    return h[0]


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.base, self.n = 0x100000001B3, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 20)
            inverse = pow(self.base, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n, b, np.uint64)])) for b in (self.base, inverse))
        return self.up, self.down


_POWERS = _Powers()
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PIECE = 1 << 20


def _hash_piece(b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word in bytes that begin and end between words. first: where documents begin."""
    word = ~_IS_SPACE[b]
    edge = word.copy()
    edge[1:] &= ~word[:-1]
    inner = first[(first > 0) & (first < len(b))]
    edge[inner] = word[inner]
    start = np.flatnonzero(edge)
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    stop[inner - 1] = word[inner - 1]
    end = np.flatnonzero(stop) + 1
    up, down = _POWERS.upto(len(b) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words [^\\x20\\x09-\\x0D]+ of a string column, and each row's offset into them.

    Works in pieces of about 1 MB that end between words, so memory stays bounded however long a text is.
    """
    column = column.cast(pa.large_string()).fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    hashes, starts, at, end = [], [], int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + _PIECE, end)
        if to < end:
            doc = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[doc] > at:
                to = int(offsets[doc])  # ends with a document
            else:
                span = data[at:to]
                gap = np.flatnonzero(_IS_SPACE[span])
                if len(gap):
                    to = at + int(gap[-1]) + 1
                else:  # one word longer than a piece
                    stop = int(offsets[doc + 1])
                    more = np.flatnonzero(_IS_SPACE[data[to:stop]])
                    to = to + int(more[0]) + 1 if len(more) else stop
        lo, hi = np.searchsorted(offsets, [at, to])
        h, s = _hash_piece(data[at:to], offsets[lo:hi] - at)
        hashes.append(h)
        starts.append(s + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def slices(column: pa.Array, size: int = 2 << 20):
    """(from, to) row ranges of about `size` bytes each; a longer row stands alone."""
    lengths = np.asarray(pc.binary_length(column).fill_null(0), np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, to
        at = to


# ---------------------------------------------------------------- tables in the shared folder


class Shelf:
    """Intermediate tables in a folder of their own in the shared folder, deleted one by one or all at once."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.n = spark, shared_dir(spark), 0

    def put(self, df: DataFrame) -> DataFrame:
        """Writes df and reads it back: the lineage ends here, and a lost executor costs nothing of it."""
        self.n += 1
        df.write.parquet(path := f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, last: int) -> None:
        """Deletes the table before the last ones."""
        drop_dir(self.spark, f"{self.folder}/{self.n - last}")

    def close(self) -> None:
        drop_dir(self.spark, self.folder)


# ---------------------------------------------------------------- connected components


def _stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: then v names the component."""
    more = edges.groupBy("u").count().filter("count > 1").select("u")
    chained = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u").distinct(), "u", "left_semi")
    return more.unionByName(chained).isEmpty()


#: Edges of a node from which on it is a hub.
HUB = 256


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least v of u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = least.filter(F.col("n") > HUB).select("u", "m")
    found = hubs.count()
    if not found:
        return edges.join(least.select("u", "m"), "u")
    rest = edges.join(small(hubs.select("u"), found), "u", "left_anti").join(least.filter(F.col("n") <= HUB).select("u", "m"), "u")
    return rest.unionByName(edges.join(small(hubs, found), "u"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (u, v), by alternating large-star and small-star rounds.

    A node with over HUB edges (the middle of a star) meets its least neighbour by a broadcast of such nodes behind their
    count, so that its edges needn't come into one task.

    The component is its smallest node. Every round is two joins and two aggregations over edges and ends in a written
    table, so neither links nor components reach the driver; rounds grow with the logarithm of a component's width, and
    edges that are stars already need none. No edges: an empty result.
    """
    shelf = Shelf(edges.sparkSession)
    now = shelf.put(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # After the large star a node has its least neighbours only, which are few.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = shelf.put(moved.unionByName(least.withColumnRenamed("m", "v")).filter("u <> v").distinct())
        shelf.drop(1)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = settle(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots))
    shelf.close()
    return out
