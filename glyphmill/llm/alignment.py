"""Operator 13, cross-tokenizer alignment by a dictionary of groups.

Two tokenizers cut one text; where tokens of both end at the same byte, the text falls into groups of A ids and B ids. A
group says all about its inner links (A-B tokens whose byte ranges overlap), and the same few groups make up most of any
corpus. So groups are interned: a task writes each document as ids of groups with their frequencies, and each distinct
group once per segment (a run of some thousand documents) with the number of documents that hold it. Links are expanded
once per distinct group of the corpus and multiplied by those numbers; what a group is worth comes back by its key into
each segment's dictionary, and from there, by the group's id, to the documents of that segment alone. No row is made for
a link of a document, a frequent group is one row per segment, and segments bound what a task holds.

A document that holds a pair in several different groups would count more than once; tasks write these surpluses down,
summed by pair, and the count takes them off. Counts are therefore exact.

Long texts are tokenized in stretches that end before a blank, where neither tokenizer ever joins (checked against B's
vocabulary when it is loaded); groups, their keys and their counts are made with NumPy for some thousand texts at once.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import _BYTES
from .shared import Shelf, mix, settle, slices

#: A segment ends after so many documents, group references or different groups (about), and at the end of its task.
SEGMENT_DOCS, SEGMENT_ENTRIES, SEGMENT_GROUPS = 8192, 2_000_000, 150_000
#: Characters that a tokenizer is given at once, about; more only where a text has no blank to cut at.
STRETCH = 100_000
#: A blank before which a text may be cut: what stands before it is no white space (nor U+180E, which old tables call so).
_CUT = re.compile("(?<=[^\\s\u180e]) ")
#: What stands for a blank in B's pieces; a text that holds one never reads back as itself.
_MARK = "\u2581"
#: Fixed value: the pattern by which this kind of byte-level vocabulary splits texts.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes all libraries agree on; other texts go through the vocabulary's own library, which is slower.
_PLAIN = re.compile("[\t\n\r -~\u00a1-\u024f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u2010-\u2027\u2030-\u205e\u20ac\u2122\u2713\u4e00-\u9fa5]*")
_STATE: dict = {}


class Groups:
    """Token ids of texts under byte-level BPE (A) and sentencepiece with byte fallback (B), and the groups known so far.

    Special tokens' strings inside texts are plain text.
    """

    def __init__(self, byte_bpe: str, piece_bpe: str) -> None:
        import json

        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_bpe)
        byte_of = {letter: b for b, letter in enumerate(_BYTES)}
        self.a_bytes = [bytes(byte_of[c] for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in part], np.int64) for part in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id(_MARK)
        self.joins = any(_MARK in p.lstrip(_MARK) for p in names)  # then texts are never cut
        with open(byte_bpe, encoding="utf-8") as file:
            model = json.load(file)["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        # Where ids follow the order of merges, ranks say the same as merges, and a faster library may apply them.
        self.fast = None
        if [model["vocab"].get(x + y) for x, y in pairs] == list(range(256, 256 + len(pairs))):
            self.fast = Encoding("a", pat_str=_SPLIT, mergeable_ranks={x: i for i, x in enumerate(self.a_bytes) if i not in special}, special_tokens={})
        self.forget()

    def forget(self) -> None:
        #: hash of a group's ids -> number; by number: key, codes of its different pairs.
        self.ids: dict[int, int] = {}
        self.keys: list[str] = []
        self.pairs: list[list[int]] = []

    def cut(self, text: str, stretch: int = STRETCH) -> list[str]:
        """blank + text in stretches, each beginning with a blank."""
        out, whole, at = [], " " + text, 0
        while not self.joins and len(whole) - at > stretch and (found := _CUT.search(whole, at + stretch)):
            out.append(whole[at : found.start()])
            at = found.start()
        return [*out, whole[at:]]

    def encode(self, text: str | None, stretch: int = STRETCH) -> tuple[list[int], list[int]] | None:
        """A's and B's ids; None if the text is empty or the bytes of its tokens aren't blank + text."""
        if not text or _MARK in text:
            return None
        a: list[int] = []
        b: list[int] = []
        for part in self.cut(text, stretch):
            if self.fast and _PLAIN.fullmatch(part):
                a += self.fast.encode_ordinary(part)
            else:
                own = self.a.encode(part, add_special_tokens=False).ids
                if b"".join(map(self.a_bytes.__getitem__, own)) != part.encode():
                    return None
                a += own
            b += self.b.encode(part[1:]) if part != " " else [self.blank]
        return (a, b) if b"".join(map(self.b_bytes.__getitem__, b)) == f" {text}".encode() else None

    def number(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the groups in order, where in a each ends) of ids of the same bytes. A group goes by a 64-bit hash of its ids."""
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        at = np.zeros(int(ends_a[-1]) + 1, np.int32)
        at[ends_a] = np.arange(1, len(a) + 1)
        met = at[ends_b]
        stop_b = np.flatnonzero(met) + 1
        stop_a = met[stop_b - 1].astype(np.int64)
        start_a, start_b = (np.concatenate([[0], x[:-1]]) for x in (stop_a, stop_b))

        def hashed(ids: np.ndarray, start: np.ndarray, stop: np.ndarray, side: int) -> np.ndarray:
            inside = np.arange(len(ids)) - np.repeat(start, stop - start)
            return np.add.reduceat(mix((ids.astype(np.uint64) << np.uint64(1) | np.uint64(side)) ^ (inside.astype(np.uint64) << np.uint64(24))), start)

        with np.errstate(over="ignore"):
            code = mix(hashed(a, start_a, stop_a, 0) + mix(hashed(b, start_b, stop_b, 1)))
        kinds, first, back = np.unique(code, return_index=True, return_inverse=True)
        own = np.empty(len(kinds), np.int32)
        for k, (h, i) in enumerate(zip(kinds.tolist(), first.tolist(), strict=True)):
            n = self.ids.get(h)
            if n is None:
                n = self.ids[h] = len(self.keys)
                key = f"{','.join(map(str, a[start_a[i] : stop_a[i]].tolist()))}|{','.join(map(str, b[start_b[i] : stop_b[i]].tolist()))}"
                self.keys.append(key)
                self.pairs.append(list({x << 32 | y for x, y in self.links(key)}))
            own[k] = n
        return own[back], stop_a

    def links(self, key: str) -> Iterator[tuple[int, int]]:
        """Pairs of ids whose tokens overlap, in order, as often as they do."""
        a, b = ([int(x) for x in part.split(",")] for part in key.split("|"))
        i = j = 0
        end_a, end_b = len(self.a_bytes[a[0]]), len(self.b_bytes[b[0]])
        while True:
            yield a[i], b[j]
            if end_a == end_b:  # only a group's end
                return
            if end_a < end_b:
                i += 1
                end_a += len(self.a_bytes[a[i]])
            else:
                j += 1
                end_b += len(self.b_bytes[b[j]])


def groups_of(byte_bpe: str, piece_bpe: str) -> Groups:
    """The worker's own tokenizers, loaded once."""
    if (byte_bpe, piece_bpe) not in _STATE:
        _STATE[byte_bpe, piece_bpe] = Groups(byte_bpe, piece_bpe)
    return _STATE[byte_bpe, piece_bpe]


#: A row of the cut corpus is a document (kind 0), a group of a segment (1) or a segment's surplus of a pair (2).
_CUT_FIELDS = [
    ("kind", pa.int32()), ("segment", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()),
    ("ids", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("id", pa.int32()), ("key", pa.string()), ("docs", pa.int64()), ("a", pa.int32()), ("b", pa.int32()),
]
_CUT_DDL = "kind int, segment long, n_a long, n_b long, n_groups long, groups_sha256 string, ids array<int>, times array<int>, id int, key string, docs long, a int, b int"


class _Segment:
    """Documents of one segment as ids of groups, how many of them hold each group, and surpluses of pairs."""

    def __init__(self, number: int, doc_id_type: pa.DataType) -> None:
        self.number, self.fields = number, [("doc_id", doc_id_type), *_CUT_FIELDS]
        self.rows: list[tuple] = []
        self.docs: Counter = Counter()
        self.surplus: Counter = Counter()
        self.entries = 0

    def add(self, doc_ids: list, texts: list[str | None], groups: Groups) -> None:
        found = [groups.encode(t) for t in texts]
        made = [x for x in found if x]
        if made:
            a, b = (np.fromiter(chain.from_iterable([x[side] for x in made]), np.int32) for side in (0, 1))
            numbers, stops = groups.number(a, b)
            doc_of = np.searchsorted(np.cumsum([len(x[0]) for x in made]), stops)
            kinds, times = np.unique(doc_of.astype(np.int64) << 32 | numbers, return_counts=True)
            spans = np.searchsorted(doc_of, np.arange(len(made) + 1))
            cuts = np.searchsorted(kinds >> 32, np.arange(len(made) + 1))
            kinds, times, numbers = (kinds & 0xFFFFFFFF).astype(np.int32), times.astype(np.int32), numbers.tolist()
        k = 0
        for doc_id, ids in zip(doc_ids, found, strict=True):
            if not ids:
                self.rows.append((doc_id, 0, 0, 0, "", [], []))
                continue
            keys, own, often = map(groups.keys.__getitem__, numbers[spans[k] : spans[k + 1]]), kinds[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]]
            self.rows.append((doc_id, len(ids[0]), len(ids[1]), int(spans[k + 1] - spans[k]), hashlib.sha256(";".join(keys).encode()).hexdigest(), own, often))
            self.entries += len(own)
            own = own.tolist()
            self.docs.update(own)
            pairs = list(chain.from_iterable(map(groups.pairs.__getitem__, own)))
            if len(set(pairs)) < len(pairs):
                self.surplus.update({p: n - 1 for p, n in Counter(pairs).items() if n > 1})
            k += 1

    def full(self, groups: Groups, docs: int) -> bool:
        return len(self.rows) >= docs or self.entries >= SEGMENT_ENTRIES or len(groups.keys) >= SEGMENT_GROUPS

    def _batch(self, n: int, kind: int, **columns: object) -> pa.RecordBatch:
        given = {"kind": [kind] * n, "segment": [self.number] * n} | columns
        return pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in self.fields], [k for k, _ in self.fields])

    def batches(self, groups: Groups) -> Iterator[pa.RecordBatch]:
        if self.rows:
            doc_id, n_a, n_b, n_groups, digest, ids, times = zip(*self.rows, strict=True)
            yield self._batch(len(self.rows), 0, doc_id=doc_id, n_a=n_a, n_b=n_b, n_groups=n_groups, groups_sha256=digest, ids=ids, times=times)
        if self.docs:
            yield self._batch(len(self.docs), 1, id=list(self.docs), key=[groups.keys[i] for i in self.docs], docs=list(self.docs.values()))
        if self.surplus:
            yield self._batch(len(self.surplus), 2, a=[p >> 32 for p in self.surplus], b=[p & 0xFFFFFFFF for p in self.surplus], docs=list(self.surplus.values()))


def cut_corpus(docs: DataFrame, byte_bpe: str, piece_bpe: str, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """Documents as ids of groups, the groups of each segment, and surpluses, in one table by kind (see _CUT_FIELDS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, number, segment = groups_of(byte_bpe, piece_bpe), TaskContext.get().partitionId() << 32, None
        groups.forget()
        for batch in batches:
            segment = segment or _Segment(number, batch.schema.field(0).type)
            for lo, hi in slices(batch.column(1)):
                for at in range(lo, hi, segment_docs):
                    to = min(hi, at + segment_docs)
                    segment.add(*(batch.column(c)[at:to].to_pylist() for c in (0, 1)), groups)
                    if segment.full(groups, segment_docs):
                        yield from segment.batches(groups)
                        number += 1
                        segment = _Segment(number, batch.schema.field(0).type)
                        if len(groups.keys) >= SEGMENT_GROUPS:
                            groups.forget()
        if segment:
            yield from segment.batches(groups)

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, {_CUT_DDL}")


def group_links(groups: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """(key, docs, a, b, times) of distinct groups (key, docs): each pair of a group once, with how often it is linked there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = groups_of(byte_bpe, piece_bpe)
        for batch in batches:
            out: list[tuple] = []
            for key, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(key, docs, a, b, n) for (a, b), n in Counter(own.links(key)).items()]
            names, types = ["key", "docs", "a", "b", "times"], (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return groups.select("key", "docs").mapInArrow(run, "key string, docs long, a int, b int, times int")


def pair_counts(links: DataFrame, surplus: DataFrame) -> DataFrame:
    """(a, b, count): how many documents hold the ids linked."""
    held = links.select("a", "b", "docs").unionByName(surplus.select("a", "b", (-F.col("docs")).alias("docs")))
    return held.groupBy("a", "b").agg(F.sum("docs").alias("count"))


def group_values(links: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, n_links, n_best, count_sum) of each group, from the corpus-wide counts of its pairs.

    The highest count of each A id is broadcast: there are never more of them than A has ids.
    """
    best = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("most")))
    valued = links.join(counts.join(best, "a"), ["a", "b"])
    times, count = F.col("times").cast("long"), F.col("count")
    return valued.groupBy("key").agg(
        F.sum(times).alias("n_links"), F.sum(F.when(count == F.col("most"), times).otherwise(F.lit(0))).alias("n_best"), F.sum(times * count).alias("count_sum")
    )


_SUMS = ["n_links", "n_best", "count_sum"]


def _document_sums(docs: pa.Table, groups: pa.Table) -> pa.Table:
    """Documents of one segment with the sums of their groups' values."""
    docs = docs.combine_chunks()
    at = groups["id"].to_numpy()
    ids, times = (docs[c].combine_chunks() if docs.num_rows else docs[c] for c in ("ids", "times"))
    out = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups")}
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(ids), np.int64))]) if docs.num_rows else np.zeros(1, np.int64)
    flat, often = (np.asarray(pc.list_flatten(c), np.int64) if docs.num_rows else np.zeros(0, np.int64) for c in (ids, times))
    for c in _SUMS:
        worth = np.zeros(int(at.max()) + 1 if len(at) else 1, np.int64)
        worth[at] = groups[c].to_numpy()
        total = np.concatenate([[0], np.cumsum(worth[flat] * often)])
        out[c] = pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64())
    return pa.table(out | {"groups_sha256": docs["groups_sha256"]})


def align(docs: DataFrame, byte_bpe: str, piece_bpe: str, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of docs (doc_id, text).

    n_best: links whose pair has the highest count of its A id, ties included; count_sum: counts summed over links;
    groups_sha256: of the groups `a1,a2|b1;...` in order. Texts that are null or empty, or whose tokens' bytes aren't
    blank + text, have no tokens: zeros and ''. Null doc_id is kept; repeated rows count as documents of their own; other
    columns are ignored; long texts are tokenized in stretches; an empty table gives an empty result. A text is read and tokenized once.
    """
    shelf = Shelf(docs.sparkSession)
    cut = shelf.put(cut_corpus(docs, byte_bpe, piece_bpe, segment_docs))
    groups = cut.filter("kind = 1").select("segment", "id", "key", "docs")
    links = shelf.put(group_links(groups.groupBy("key").agg(F.sum("docs").alias("docs")), byte_bpe, piece_bpe))
    counts = shelf.put(pair_counts(links, cut.filter("kind = 2")))
    valued = groups.select("segment", "id", "key").join(group_values(links, counts), "key").select(F.col("segment").alias("of_segment"), "id", *_SUMS)
    rows = cut.filter("kind = 0").select("segment", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "ids", "times")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = settle(rows.groupBy("segment").cogroup(valued.groupBy("of_segment")).applyInArrow(_document_sums, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"))
    shelf.close()
    return out


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("long"))
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment}
SQL: dict[str, str] = {}
