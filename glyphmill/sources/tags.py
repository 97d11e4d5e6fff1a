"""Tags of a source text as they stand there: one row per tag with its offsets, for edits that must not touch anything else.

Unlike `dom`, nothing is parsed into a tree and nothing is normalised: a tag is what starts with `<name` and runs to the
first `>` outside quotes, wherever it stands. The scan is linear: a tag without a `<` inside is read as it stands, where
others end is taken from the text's quotes and angle brackets, read once from the back.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "n int, start int, stop int, line int, name string, closing boolean, nested boolean, indent string, attrs array<struct<k:string,v:string>>"
#: An attribute and its value, for Python and Java alike.
ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
_OPEN = re.compile(r"<\s*(/?)\s*([a-zA-Z][a-zA-Z0-9-]*)(?=[\s/>])")
_ATTRIBUTE = re.compile(ATTRIBUTE)
_MARK = re.compile("[\"'>]")
#: The rest of a tag with no `<` in it: a look that ends at the next `<`, so all looks together read a text once.
_REST = re.compile(r"""(?:[^"'<>]++|"[^"<]*+"|'[^'<]*+')*+>""")
_ROWS = 20_000


def tag_ends(text: str) -> tuple[list[int], list[int]]:
    """Where quotes and `>` stand, and for each of them where a tag ends that has it as its next mark outside quotes (-1: nowhere)."""
    marks = [m.start() for m in _MARK.finditer(text)]
    ends = [-1] * (len(marks) + 1)
    after = {'"': len(marks), "'": len(marks)}  # the mark behind the next quote of that kind
    for i in range(len(marks) - 1, -1, -1):
        c = text[marks[i]]
        if c == ">":
            ends[i] = marks[i] + 1
        else:
            ends[i] = ends[after[c]]
            after[c] = i + 1
    return marks, ends


def scan(text: str, names: frozenset[str] | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA for one text, of all names or of some; a tag that never ends is none."""
    marks = ends = None  # made only for a text in which some tag isn't plain
    line, line_start, at, n = 1, 0, 0, 0
    within: dict[str, int] = {}
    for m in _OPEN.finditer(text):
        start, name = m.start(), m[2].lower()
        if rest := _REST.match(text, m.end()):
            stop = rest.end()
        else:
            if ends is None:
                marks, ends = tag_ends(text)
            stop = ends[bisect_left(marks, m.end())]
        if stop < 0:
            continue
        if names is not None and name not in names:
            n += 1
            continue
        breaks = text.count("\n", at, start)
        if breaks:
            line, line_start = line + breaks, text.rindex("\n", at, start) + 1
        at = start
        body = text[m.end() : stop - 1]
        last = {k.lower(): v[1:-1] if v[:1] in "\"'" else v for k, v in _ATTRIBUTE.findall(body)}
        before = text[line_start:start] if start - line_start < 1000 else ""
        yield n, start, stop, line, name, m[1] == "/", start < within.get(name, 0), before[: len(before) - len(before.lstrip())], [{"k": k, "v": v} for k, v in last.items()]
        n += 1
        within[name] = max(stop, within.get(name, 0))


_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))]
_NAMES = ["n", "start", "stop", "line", "name", "closing", "nested", "indent", "attrs"]


def source_tags(texts: DataFrame, key: str = "path", text: str = "text", names: str | None = None) -> DataFrame:
    """key and the columns of SCHEMA for each tag of texts; null texts have none.

    names: a column with the names, in lower case, of those tags of its text that are wanted; without it all are.

    n counts the tags of a text, start and stop are code points (stop behind the `>`), line counts from 1. nested: the tag
    stands inside the quotes of one of the same name. indent: what white space the tag's line begins with. attrs: the last
    of equal attributes, quotes taken off.
    """

    def made(own: list, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(own, kind), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]], [key, *_NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, own, rows = batch.schema.field(0).type, [], []
            for i in range(batch.num_rows):
                path, source = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                wanted = frozenset(batch.column(2)[i].as_py() or ()) if names else None
                for row in scan(source, wanted) if source else ():
                    own.append(path)
                    rows.append(row)
                    if len(rows) == _ROWS:
                        yield made(own, rows, kind)
                        own, rows = [], []
            if rows:
                yield made(own, rows, kind)

    narrow = texts.select(key, F.col(text).alias("_text"), *([F.col(names).alias("_names")] if names else []))
    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[key].dataType.simpleString()}, {SCHEMA}")
