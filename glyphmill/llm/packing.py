"""Operator 9, best-fit packing by the sum-of-squares rule.

Every document becomes token ids and an end id; documents over one sequence are cut into full sequences and a rest. A
piece goes where the sum over gaps g of (open sequences with gap g) squared becomes smallest, which keeps all gap sizes
in supply, so that later pieces find a gap that they close. Pieces are dealt to groups of bounded token count by a
hash, and each group packs alone: the work spreads over any number of executors, and what a group leaves open at its
end is a fixed number of sequences out of tens of thousands.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settle, slices

CAPACITY = 4096
#: Tokens that one group packs, about; its pieces are a few hundred thousand narrow rows.
GROUP_TOKENS = 64_000_000
#: Words whose ids a worker remembers, newest and those before them.
CACHE_WORDS = 120_000
#: Where this tokenizer and str.split() disagree about white space, the whole text goes through the tokenizer.
_ODD = re.compile("[\x1c-\x1f᠎]|<\\|(?:start|end)oftext\\|>")
_STATE: dict = {}


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


#: Up to here letters are single code points whose composition and lower case are the same everywhere (but for U+0130).
_LATIN = 0x250
_SIMPLE = re.compile(f"[!-~\u00a1-\u012f\u0131-{chr(_LATIN - 1)}]*")
_BYTES = _byte_letters()


def _parts() -> re.Pattern:
    """The vocabulary's own pattern on lower-case words of such letters."""
    found = {x for c in range(33, _LATIN) for x in (chr(c), *chr(c).lower())}
    of = lambda kind: "".join(re.escape(c) for c in sorted(found) if unicodedata.category(c)[0] == kind)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{of('L')}]+|[{of('N')}]|[^{of('L')}{of('N')}]+")


class Ids:
    """Token ids as little-endian bytes. No token of this vocabulary spans white space, so ids are remembered by word.

    A new word of Latin letters goes to the merges directly, past the steps that keep offsets; any other word, and a text
    with odd white space or a special token, goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.parts = _parts()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        if not _SIMPLE.fullmatch(word):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        else:
            parts = self.parts.findall(word.lower())
            ids = [t.id for p in parts for t in self.merge(p if p.isascii() else "".join([_BYTES[b] for b in p.encode()]))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def of(self, text: str) -> bytes:
        if _ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.split()
        known = self.known
        if new := set(words).difference(known):
            if len(known) > CACHE_WORDS:  # a word that is met again moves on, others go with the words before them
                self.older, self.known = known, {}
                known, new = self.known, set(words)
            older = self.older
            for w in new:
                known[w] = older.get(w) or self.word(w)
        return b"".join(map(known.__getitem__, words))


def ids_of(path: str) -> Ids:
    """The worker's own tokenizer, loaded once."""
    if path not in _STATE:
        _STATE[path] = Ids(path)
    return _STATE[path]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; null text counts as empty and gives its end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = ids_of(tokenizer), struct.pack("<I", end_id)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                out: list[tuple] = []
                for doc_id, text in zip(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist(), strict=True):
                    data = ids.of(text or "") + end
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: Iterable[int], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of each length in turn, and the number of sequences.

    A place in a sequence with gap g, leaving g - l, changes the sum of squares by 2 * (n[g - l] - n[g]) + 2; an exact fit
    by 1 - 2 * n[g]; a new sequence by 2 * n[capacity - l] + 1. Ties go to the smallest gap, and to an open sequence
    before a new one, which never opens one in vain.
    """
    n = np.zeros(capacity + 1, np.int64)
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    where, offset = [], []
    for length in lengths:
        if length == capacity:
            where.append(len(fill))
            offset.append(0)
            fill.append(capacity)
            continue
        have = n[length:capacity]
        change = 2 * (n[: capacity - length] - have) + 2
        change[0] = 1 - 2 * have[0]
        change[have == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        if change[best] <= 2 * n[capacity - length] + 1:
            gap = length + best
            bin_ = opened[gap].pop()
            n[gap] -= 1
        else:
            gap, bin_ = capacity, len(fill)
            fill.append(0)
        where.append(bin_)
        offset.append(fill[bin_])
        fill[bin_] += length
        if gap > length:
            opened[gap - length].append(bin_)
            n[gap - length] += 1
    return np.array(where, np.int64), np.array(offset, np.int64), len(fill)


def pack(cut: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to (doc_id, piece, start, length, ids_crc32).

    Pieces are taken longest first within a group. The number of groups follows the token count, so a group stays the
    same size however large the corpus is. Equal rows are pieces of their own. Empty input: empty result.
    """
    tokens = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(tokens / group_tokens))
    dealt = cut.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
        where, offset, _ = sum_of_squares(group["length"].tolist(), capacity)
        group["sequence_id"] = where * groups + group["_g"].to_numpy()
        group["offset"] = offset
        return group.drop(columns="_g")

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return dealt.groupBy("_g").applyInPandas(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Tokenizes and packs whole documents (doc_id, text); one row per piece.

    Null text is empty: one end id. Null doc_id is kept, repeated rows are packed as often as they occur, other columns
    are ignored, and an empty table gives an empty result. The narrow pieces are checkpointed, so texts are tokenized once.
    """
    return pack(settle(pieces(docs, tokenizer, end_id, capacity)), capacity, group_tokens)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
SQL: dict[str, str] = {}
