"""Operator 10, n-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles. In each of RUNS independent runs a set samples about 1 / 0.8 of its
shingles; every sampled shingle is a path, and sets on one path meet in a bucket. Small buckets are compared by brute
force. A large bucket is split again: each of its sets samples 1 / 0.8 further shingles by a hash of the path so far.
After DEPTH splits what is still large (a passage that is all of a text, a group of thousands of near copies) is
compared in blocks, every block with every other. Two sets at the threshold stay together with probability p through
DEPTH splits, so RUNS follows from the target recall: (1 - p) ** RUNS <= 1 - recall.

Brute force works on 64-byte sketches and only has to find which texts hang together; its result is a spanning forest,
a row per text at most. Each group that hangs together is then compared exactly, set by set, in blocks of bounded size,
and what leaves those blocks is again one row per text: its number of links and its root. So no step emits pairs, and
exact copies (equal shingle sets) are one node with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Shelf, components, mix, seed, settle, sieve, slices, small, word_hashes

SHINGLE, THRESHOLD, RECALL, DEPTH = 5, 0.8, 0.99, 3
#: Sets in a bucket that is compared at once, in a block of what is still large after the last split, and in a block of
#: the exact comparison.
BUCKET, LAST_BLOCK, BLOCK = 200, 1000, 256
#: Pairs that a task holds before it keeps of them only what hangs together.
PAIRS = 1 << 20
#: Sketch: one value of 4 bits in each of 128 bins.
BINS = 128
_BITS = np.uint64((1 << 49) - 1)


def survival(depth: int) -> float:
    """Chance that two sets at the threshold share a path after so many splits, of one run."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return p


def runs_for(recall: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


# ---------------------------------------------------------------- sets, sketches and paths


def shingle_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """49-bit hashes of the distinct shingles of each text, ascending, and each row's offset into them.

    A text of one to four words has one shingle of all its words; a text without words has none.
    """
    words, at = word_hashes(text)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    with np.errstate(over="ignore"):
        total = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            total += mix(words[k : k + len(total)] ^ seed("word", k)) if len(total) else 0
    inside = doc[: len(total)] == doc[len(words) - len(total) :]
    values, owners = mix(total[inside]), doc[: len(total)][inside]
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(SHINGLE - 1):
                has = n[few] > k
                short[has] += mix(words[at[few[has]] + k] ^ seed("short", k))
        values, owners = np.concatenate([values, mix(short)]), np.concatenate([owners, few.astype(np.uint64)])
    values = values & _BITS
    if len(n) <= 1 << 15:
        both = np.unique(owners << np.uint64(49) | values)
        values, owners = both & _BITS, (both >> np.uint64(49)).astype(np.int64)
    else:
        order = np.lexsort((values, owners))
        values, owners = values[order], owners[order].astype(np.int64)
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
        values, owners = values[new], owners[new]
    return values, np.searchsorted(owners, np.arange(len(n) + 1))


def sketches(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows x 8) words of 64 bits: 128 bins of 4 bits, each from the least hash that falls into the bin (none: 0)."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    h = mix(values ^ seed("sketch"))
    place = doc * BINS + (h >> np.uint64(57)).astype(np.int64)
    least = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, place, h)
    nibble = (mix(least) & np.uint64(15)).astype(np.uint8)
    nibble[least == np.iinfo(np.uint64).max] = 0
    return (nibble[0::2] | nibble[1::2] << 4).reshape(n, BINS // 2).view(np.uint64)


def paths(values: np.ndarray, at: np.ndarray, runs: int, depth: int, threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level (row, parent path, path): the shingles that each set samples below each path of the level before."""
    n = np.diff(at)
    limit = np.minimum(2.0**53 / (threshold * np.maximum(n, 1)), 2.0**53).astype(np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    node_doc = np.tile(np.arange(len(n)), runs)
    node_path = np.repeat(np.array([seed("run", r) for r in range(runs)], np.uint64), len(n))
    out = []
    for level in range(depth):
        rows, parents, children = [], [], []
        if level == 0:
            groups = [(doc, values, np.full(len(doc), seed("run", r), np.uint64)) for r in range(runs)]
        else:  # each node reads its set again, some 100,000 shingles at a time
            size, groups, a = np.cumsum(n[node_doc]), [], 0
            while a < len(node_doc):
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + (1 << 20), "right")))
                groups.append((a, b))
                a = b
        for g in groups:
            if level:
                a, b = g
                d, count = node_doc[a:b], n[node_doc[a:b]]
                spot = np.repeat(at[d] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                g = (np.repeat(d, count), values[spot], np.repeat(node_path[a:b], count))
            d, v, p = g
            key = mix(v ^ p ^ seed("level", level))
            hit = np.flatnonzero(key >> np.uint64(11) < limit[d])
            rows.append(d[hit])
            parents.append(p[hit])
            children.append(mix(key[hit] ^ p[hit] ^ seed("child")))
        node_doc, node_path = np.concatenate(rows), np.concatenate(children)
        out.append((node_doc, np.concatenate(parents), node_path))
    return out


def _lists(rows: np.ndarray, n: int, *columns: np.ndarray) -> pa.Array:
    order = np.argsort(rows, kind="stable")
    offsets = np.searchsorted(rows[order], np.arange(n + 1)).astype(np.int32)
    flat = [pa.array(c[order].view(np.int64), pa.int64()) for c in columns]
    inner = flat[0] if len(flat) == 1 else pa.StructArray.from_arrays(flat, ["p", "b"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)


def fingerprints(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """16 bytes that name the shingle set."""
    high, low = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ seed("set", k)))]) for k in (0, 1))
    with np.errstate(over="ignore"):
        n = np.diff(at).astype(np.uint64)
        both = np.stack([mix(high[at[1:]] - high[at[:-1]] + n), mix(low[at[1:]] - low[at[:-1]] ^ n)], 1)
    return pa.array([both[i].tobytes() for i in range(len(both))], pa.binary())


def _table(docs: DataFrame, runs: int, depth: int, threshold: float) -> DataFrame:
    """(doc_id, h, fp, n, sketch, l1, l2, ...) of each row; h: hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2), 1 << 20):
                part = batch.slice(a, b - a)
                values, at = shingle_sets(part.column(2))
                sketch = sketches(values, at)
                levels = paths(values, at, runs, depth, threshold)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), fingerprints(values, at), pa.array(np.diff(at), pa.int64()), pa.array([s.tobytes() for s in sketch], pa.binary()),
                        *[_lists(d, b - a, c) if k == 0 else _lists(d, b - a, p, c) for k, (d, p, c) in enumerate(levels)],
                    ],
                    ["doc_id", "h", "fp", "n", "sketch", *[f"l{k + 1}" for k in range(depth)]],
                )

    narrow = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    more = "".join(f", l{k + 1} array<{'long' if k == 0 else 'struct<p:long,b:long>'}>" for k in range(depth))
    return narrow.mapInArrow(run, f"doc_id {kind}, h long, fp binary, n long, sketch binary{more}")


# ---------------------------------------------------------------- brute force in buckets


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes hangs together with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, size: int) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches sorted by key; a group is bounded, so is a table (size rows and one group)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _bucket_edges(cand: DataFrame, threshold: float) -> DataFrame:
    """(u, v): for each text the least text of its bucket that it hangs together with by sketch."""
    # Bits that differ are half of those that a bin's values differ in; 3.5 deviations of slack, exact sets decide later.
    most = int(4 * BINS / 2 * (1 - threshold + 3.5 * math.sqrt(threshold * (1 - threshold) / BINS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "b", 20_000):
            bucket = table.column("b").to_numpy()
            fp = table.column("fp").combine_chunks()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(bucket), -1)
            left, right, held = [], [], 0
            same = np.arange(len(bucket))
            for d in range(1, len(bucket)):
                same = same[same < len(bucket) - d]
                same = same[bucket[same] == bucket[same + d]]
                if not len(same):
                    break
                off = np.zeros(len(same), np.uint16)
                for w in range(sketch.shape[1]):
                    off += np.bitwise_count(sketch[same, w] ^ sketch[same + d, w])
                near = same[off <= most]
                left.append(near)
                right.append(near + d)
                held += len(near)
                if held > PAIRS:
                    root = _forest(np.concatenate(left), np.concatenate(right), len(bucket))
                    hit = np.flatnonzero(root != np.arange(len(root)))
                    left, right, held = [root[hit]], [hit], len(hit)
            if left:
                root = _forest(np.concatenate(left), np.concatenate(right), len(bucket))
                hit = np.flatnonzero(root != np.arange(len(root)))
                # Rows stand by fingerprint, so a text has the same root in every bucket that holds the same texts.
                pairs = {(x, y): None for x, y in zip(fp.take(pa.array(hit)).to_pylist(), fp.take(pa.array(root[hit])).to_pylist(), strict=True)}
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*pairs, strict=True)], ["u", "v"])

    return cand.select("b", "fp", "sketch").repartition("b").sortWithinPartitions("b", "fp").mapInArrow(run, "u binary, v binary")


def _blocked(df: DataFrame, key: str, size: Column, limit: int, node: str) -> DataFrame:
    """Splits groups over the limit into blocks by a hash of the node and sends each row to every pair of blocks it is in.

    Adds i, the row's block, and side_a, side_b, the pair's; the new key names the pair. A group in one block is one pair.
    """
    blocks = F.greatest(F.ceil(size / limit), F.lit(1)).cast("int")
    own = df.withColumn("_blocks", blocks).withColumn("i", F.pmod(F.xxhash64(F.lit("block"), node), F.col("_blocks")).cast("int"))
    spread = own.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    pair = spread.withColumn("side_a", F.least("i", "_j")).withColumn("side_b", F.greatest("i", "_j"))
    return pair.withColumn(key, F.when(F.col("_blocks") == 1, F.col(key)).otherwise(F.xxhash64(key, "side_a", "side_b"))).drop("_blocks", "_j")


def _nodes_below(table: DataFrame, level: int, above: DataFrame, large: DataFrame, many: int) -> DataFrame:
    """(b, fp) of a level, below large buckets only. A text's list is cut to these before it becomes rows; a sieve drops the lists of other texts unread."""
    inside = above.join(small(large, many), "b", "left_semi").groupBy("fp").agg(F.collect_set("b").alias("ps"))
    keys = inside.select(F.xxhash64("fp").alias("k"))
    maybe = sieve(table.select("fp", f"l{level}"), F.xxhash64("fp"), keys, keys.count()).filter("maybe").dropDuplicates(["fp"])
    below = maybe.join(inside, "fp").select("fp", F.filter(f"l{level}", lambda x: F.array_contains("ps", x["p"])).alias("l"))
    return below.select(F.explode("l").alias("x"), "fp").select("x.b", "fp").distinct()


def _candidates(table: DataFrame, reps: DataFrame, depth: int, threshold: float, shelf: Shelf) -> DataFrame:
    """Edges of the buckets of all runs. A level is written once and ends the descent when none of its buckets is large."""
    cand, rows, large, many = None, None, None, 0
    for level in range(1, depth + 1):
        if level == 1:
            rows = shelf.put(table.select(F.explode("l1").alias("b"), "fp").distinct())
        else:
            rows = shelf.put(_nodes_below(table, level, rows, large, many))
        counts = shelf.put(rows.groupBy("b").agg(F.count("*").alias("size")).filter("size > 1"))
        sizes = counts.filter(F.col("size") > BUCKET)
        many = sizes.count()
        large = sizes.select("b")
        # Rows of large buckets leave before the join, so that none of its keys has more than BUCKET rows.
        few = rows.join(small(large, many), "b", "left_anti").join(counts.filter(F.col("size") <= BUCKET).select("b"), "b", "left_semi")
        cand = few if cand is None else cand.unionByName(few)
        if not many:
            break
        if level == depth:
            split = _blocked(rows.join(small(sizes, many), "b"), "b", F.col("size"), LAST_BLOCK, "fp")
            cand = cand.unionByName(split.select("b", "fp"))
    return _bucket_edges(cand.join(reps.select("fp", "sketch"), "fp"), threshold)


# ---------------------------------------------------------------- exact comparison


def _exact(members: DataFrame, threshold: float) -> DataFrame:
    """(fp, links, text_links, root) of each row of a pair of blocks (key, i, side_a, side_b, fp, copies, tokens)."""

    def compare(rows: list[dict]) -> tuple[list, list, list, list]:
        n = len(rows)
        sets = [np.frombuffer(r["tokens"], np.int64) for r in rows]
        size = np.array([len(s) for s in sets])
        flat, place = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(n), size)
        common = np.zeros((n, n), np.float32)
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        shared = np.flatnonzero(np.bincount(place, minlength=len(flat)) > 1)  # a shingle of one set alone is common to none
        rank = np.full(len(flat), -1)
        rank[shared] = np.arange(len(shared))
        place, owner = rank[place[rank[place] >= 0]], owner[rank[place] >= 0]
        for at in range(0, len(shared), 4096):
            a, b = np.searchsorted(place, [at, at + 4096])
            has = np.zeros((n, min(4096, len(shared) - at)), np.float32)
            has[owner[a:b], place[a:b] - at] = 1
            common += has @ has.T
        # Common and size are whole numbers below 2**24: this comparison is exact.
        linked = common.astype(np.float64) >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        if rows[0]["side_a"] != rows[0]["side_b"]:
            side = np.array([r["i"] for r in rows])
            linked &= side[:, None] != side[None, :]
        copies = np.array([r["copies"] for r in rows], np.int64)
        root = _forest(*np.nonzero(linked), n)
        return [r["fp"] for r in rows], (linked @ copies).tolist(), linked.sum(1).tolist(), [rows[k]["fp"] for k in root]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "key", 2_000):
            keys = table.column("key").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a > 1:
                    out = compare(table.slice(a, b - a).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["fp", "links", "text_links", "root"])

    ordered = members.repartition("key").sortWithinPartitions("key")
    return ordered.select("key", "i", "side_a", "side_b", "fp", "copies", "tokens").mapInArrow(run, "fp binary, links long, text_links long, root binary")


def _tokens(docs: DataFrame) -> DataFrame:
    """(fp, tokens) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), 1 << 20):
                values, at = shingle_sets(batch.column(0).slice(a, b - a))
                signed = values.view(np.int64)
                yield pa.RecordBatch.from_arrays([fingerprints(values, at), pa.array([signed[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["fp", "tokens"])

    return docs.select("text").mapInArrow(run, "fp binary, tokens binary")


def _row(doc_id: str, h: str) -> Column:
    """A number that stands for (doc_id, hash of the text)."""
    return F.xxhash64(F.lit("row"), F.col(doc_id), F.col(h))


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> DataFrame:
    """(doc_id, h, class_id, root, n_links, n_text_links, copies), one row per row of docs (doc_id, text).

    class_id: least doc_id of all texts that hang together by links; root: the class's own key; n_links: other rows at
    Jaccard >= threshold, copies counted one by one; n_text_links: other texts at the threshold; copies: rows of the same
    shingle set; h: hash of the text, which with doc_id names the row. Words are [^\\x20\\x09-\\x0D]+ as they stand. A text
    of one to four words is one shingle; null and empty texts have none and are copies of each other. Null doc_ids are
    rows like others (a class of only such rows has class_id null); repeated rows are copies; an empty table gives an
    empty result; other columns are ignored. Lost executors cost their own tasks: all intermediate results are
    checkpoints or tables in the shared folder.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    shelf = Shelf(spark)
    table = shelf.put(_table(docs, runs_for(recall, depth), depth, threshold))
    reps = table.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("row"), F.first("sketch").alias("sketch"))
    reps = shelf.put(reps)
    # 1. Which texts hang together, by sketch.
    groups = components(_candidates(table.filter("n > 0"), reps, depth, threshold, shelf))
    groups = groups.join(groups.groupBy("component").agg(F.count("*").alias("size")), "component")
    live = shelf.put(groups.join(reps.select("fp", "copies", "row"), F.col("node") == F.col("fp")).select("fp", "component", "size", "copies", _row("row.doc_id", "row.h").alias("k")))
    # 2. Their exact sets, compared in blocks. One row of each text is read again; what passes the sieve in vain has no partner.
    asked = sieve(docs, F.xxhash64(F.lit("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit("")))), live.select("k"), live.count())
    tokens = _tokens(asked.filter("maybe")).dropDuplicates(["fp"])
    members = live.drop("k").join(tokens, "fp").withColumn("key", F.xxhash64("component"))
    found = shelf.put(_exact(_blocked(members, "key", F.col("size"), BLOCK, "fp"), threshold))
    # 3. Links by text, classes by verified links.
    links = found.groupBy("fp").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    classes = components(found.select(F.col("fp").alias("u"), F.col("root").alias("v")))
    by_text = reps.select("fp", "copies", "least").join(links, "fp", "left").join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    heads = by_text.groupBy("root").agg(F.min("least").alias("class_id"))
    by_text = by_text.join(heads, "root").select(
        "fp", "class_id", "root", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("text_links", F.lit(0)).alias("n_text_links"), "copies"
    )
    out = settle(table.select("doc_id", "h", "fp").join(by_text, "fp").select("doc_id", "h", "class_id", "root", "n_links", "n_text_links", "copies"))
    shelf.close()
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each class: the row with the least (doc_id, hash of the text), null ids last.

    A row that occurs twice stays once. Only rows that may have to go are shuffled, with their texts.
    """
    found = jaccard_classes(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    first = found.groupBy("root").agg(F.min(order).alias("o")).select(_row("o.doc_id", "o.h").alias("k"))
    rows = found.groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.first("root").alias("root")).select("doc_id", "h", "n", _row("doc_id", "h").alias("k"))
    doubtful = settle(rows.join(first.withColumn("stays", F.lit(True)), "k", "left").select("doc_id", "h", "k", "n", F.coalesce("stays", F.lit(False)).alias("stays")).filter("n > 1 OR NOT stays"))
    here = docs.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    here = sieve(here, F.xxhash64(F.lit("row"), "doc_id", "_h"), doubtful.select("k"), doubtful.count())
    known = doubtful.select(F.col("doc_id").alias("_id"), F.col("h").alias("_hash"), "n", "stays").hint("shuffle_hash")
    judged = here.filter("maybe").join(known, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left")
    once = judged.filter("n > 1 AND stays").dropDuplicates(["doc_id", "_h"])
    return here.filter("NOT maybe").select(docs.columns).unionByName(judged.filter("n IS NULL").select(docs.columns)).unionByName(once.select(docs.columns))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", "n_links", "n_text_links", "copies")


QUERIES = {"op10_ngram_jaccard_join": op10_ngram_jaccard_join}
SQL: dict[str, str] = {}
