"""Vectors against a reference corpus, exactly, as block products: no side is broadcast or collected.

References are cut into tiles and vectors into blocks of bounded size; each block meets each tile once, one task
multiplies the two matrices and keeps, per vector and label, the best reference; a merge by vector takes the best over
all tiles. The work is that of the full product, in pieces that any number of tasks share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Vectors of a block and references of a tile, about.
BLOCK, TILE = 4096, 4096
# Words that a text needs, and where a score is reported.
LEAST_WORDS, REPORT = 5, 0.60
_BEST = [("label", pa.string()), ("score", pa.float64()), ("ref_id", pa.int64())]


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an embedding column as float64, and their norms."""
    flat = table["embedding"].combine_chunks()
    values = np.asarray(flat.flatten() if isinstance(flat, pa.ListArray) else flat.values, np.float64)
    m = values.reshape(table.num_rows, -1) if table.num_rows else values.reshape(0, 0)
    return m, np.sqrt((m * m).sum(axis=1))


def best_references(vectors: DataFrame, references: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(vec_id, label, score, ref_id): per vector and label the reference with the highest cosine, equal ones by the least ref_id.

    vectors (vec_id, embedding), references (ref_id, embedding, label). Null, empty and zero vectors meet nothing; all
    others have one length. Repeated vec_ids give a row each time they occur in a block of their own.
    """
    usable = lambda df: df.filter(F.size("embedding") > 0).filter(F.exists("embedding", lambda x: x != 0))
    left, right = usable(vectors.select("vec_id", "embedding")), usable(references.select("ref_id", "embedding", "label"))
    blocks, tiles = (max(1, -(-df.count() // n)) for df, n in ((left, block), (right, tile)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    mine = left.withColumn("_b", dealt("vec_id", blocks)).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    theirs = right.withColumn("_t", dealt("ref_id", tiles)).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = left.schema["vec_id"].dataType.simpleString()

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, rows = a["vec_id"], []
        if a.num_rows and b.num_rows:
            (x, nx), (y, ny) = _matrix(a), _matrix(b)
            labels, refs = np.array(b["label"].to_pylist(), object), np.asarray(b["ref_id"], np.int64)
            order = np.argsort(refs, kind="stable")
            labels, refs, y, ny = labels[order], refs[order], y[order], ny[order]
            for label in sorted(set(labels.tolist()), key=str):
                own = np.flatnonzero(labels == label)
                for at in range(0, len(x), 512):
                    cosine = (x[at : at + 512] @ y[own].T) / (nx[at : at + 512, None] * ny[own][None, :])
                    top = cosine.argmax(axis=1)
                    rows.append((np.arange(at, at + len(top)), [label] * len(top), cosine[np.arange(len(top)), top], refs[own][top]))
        if not rows:
            return pa.table({"vec_id": ids.slice(0, 0), **{n: pa.array([], t) for n, t in _BEST}})
        where = np.concatenate([r[0] for r in rows])
        return pa.table({
            "vec_id": ids.take(pa.array(where)), "label": pa.array([v for r in rows for v in r[1]], pa.string()),
            "score": pa.array(np.concatenate([r[2] for r in rows])), "ref_id": pa.array(np.concatenate([r[3] for r in rows])),
        })

    met = mine.groupBy("_b", "_t").cogroup(theirs.withColumnsRenamed({"_b": "_rb", "_t": "_rt"}).groupBy("_rb", "_rt")).applyInArrow(product, f"vec_id {kind}, label string, score double, ref_id long")
    best = met.groupBy("vec_id", "label").agg(F.max(F.struct("score", (-F.col("ref_id")).alias("_r"))).alias("b"))
    return best.select("vec_id", "label", F.col("b.score").alias("score"), (-F.col("b._r")).alias("ref_id"))


def scores(vectors: DataFrame, references: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(vec_id, ai_similarity, human_similarity, score, similar_to): score (best model - best human + 1) / 2, within 0 and 1."""
    best = best_references(vectors, references, block, tile)
    of = lambda label, c: F.max(F.when(F.col("label") == label, F.col(c)))
    wide = best.groupBy("vec_id").agg(of("model", "score").alias("_a"), of("human", "score").alias("_h"), of("model", "ref_id").alias("similar_to"))
    met = vectors.select("vec_id").distinct().join(wide, "vec_id", "left")
    a, h = F.coalesce("_a", F.lit(0.0)), F.coalesce("_h", F.lit(0.0))
    return met.select("vec_id", a.alias("ai_similarity"), h.alias("human_similarity"), T.clamp((a - h + 1.0) / 2.0).alias("score"), "similar_to")


def findings(blocks: DataFrame, references: DataFrame, threshold: float = REPORT) -> DataFrame:
    """scores() of blocks (vec_id, text, embedding) that have LEAST_WORDS words or more, from the threshold on."""
    long_enough = blocks.filter(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), "")) >= LEAST_WORDS)
    return scores(long_enough, references).filter(F.col("score") >= threshold)
