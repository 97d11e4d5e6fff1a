"""Markup as rows: one per element, text node, comment and doctype.

Reading markup is the one step that columns can't express; it runs in Arrow batches, document by document, and all rules
are plans over its rows. The tree is the plain one: void elements end themselves, an end tag ends the nearest open
element of its name and is ignored without one, nothing is closed by implication, the last of equal attributes counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose whole text is a column; for others it would repeat each page once per level.
TEXTUAL = frozenset(
    "h1 h2 h3 h4 h5 h6 p li a button span figcaption blockquote td th label title summary select textarea input em strong b i u mark small cite q style script caption option legend".split()
)
HIDDEN_TEXT = frozenset("script style template".split())
SNIPPET = 160

#: Ancestors that a row names: those that anything asks for. A row doesn't list all that stands above it.
WATCHED = frozenset("head body nav form label script style noscript template svg path iframe meta link".split())
#: Elements of copy; one whose text is that of the nearest one above it repeats it.
COPY = frozenset("h1 h2 h3 h4 h5 h6 p li a button span figcaption blockquote td th label".split())
#: Steps of a selector at most (what is above goes by a hash), and elements around a text that it is added to, from inside.
SELECTOR_STEPS, TEXT_LEVELS = 40, 64
#: Characters within which the end of an opening tag with open braces is looked for.
LONGEST_TAG = 10_000

SCHEMA = (
    "pos int, parent int, parent_last int, depth int, last int, tag string, attrs array<struct<k:string,v:string>>, own string, text string, "
    "ancestors array<string>, lang_above boolean, repeats boolean, selector string, line int, snippet string"
)


def squeeze(s: str) -> str:
    return " ".join(s.split())


class _Row:
    """One row while its document is read. What it shares with its parent is the parent's object."""

    __slots__ = ("pos", "up", "depth", "last", "tag", "attrs", "own", "parts", "text", "step", "path", "above", "lang_above", "lang", "kids", "copy", "textual", "line", "snippet", "inner")


class _Tree(HTMLParser):
    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[_Row] = []
        top = _Row()
        top.pos, top.up, top.depth, top.tag, top.kids, top.path, top.above, top.lang, top.lang_above, top.copy, top.textual, top.step = -1, None, 0, "", None, 0, (), False, False, None, False, ""
        self.open: list[_Row] = [top]
        self.opened: Counter = Counter()
        self.textual: list[_Row] = []  # open elements that collect text
        self.hidden: list[_Row] = []  # open elements whose text isn't shown
        self.source, self.lines = source, [0, *(m.end() for m in re.finditer("\n", source))]
        self.feed(source)
        self.close()
        for row in self.open[1:]:
            row.last = len(self.rows) - 1

    def _add(self, tag: str, attrs: list, text: str = "") -> _Row:
        up, row = self.open[-1], _Row()
        row.pos = row.last = len(self.rows)
        row.up, row.depth, row.tag, row.attrs, row.text, row.own, row.parts, row.kids, row.snippet, row.lang = up, len(self.open) - 1, tag, attrs, text, None, None, None, "", False
        row.line = self.getpos()[0]
        row.above = up.above if up.tag not in WATCHED or up.tag in up.above else (*up.above, up.tag)
        row.lang_above = up.lang_above or up.lang
        row.copy = up if up.tag in COPY else up.copy
        if tag[0] == "#":
            row.step, row.path, row.textual = "", up.path, False
        else:
            if up.kids is None:
                up.kids = {}
            n = up.kids[tag] = up.kids.get(tag, 0) + 1
            row.step = f"{tag}:nth-of-type({n})"
            row.path = (up.path * 0x100000001B3 + zlib.crc32(row.step.encode())) & 0xFFFFFFFFFFFFFFFF
            row.textual = tag in TEXTUAL or any(k == "id" for k, _ in attrs)
            row.lang = any(k == "lang" for k, _ in attrs)
        self.rows.append(row)
        return row

    def handle_starttag(self, tag: str, attrs: list) -> None:
        row = self._add(tag, list({k: v or "" for k, v in attrs}.items()))
        opening = self._opening()
        if tag == "title":
            line, column = self.getpos()
            row.inner = self.lines[line - 1] + column + len(self.get_starttag_text() or "")
        row.snippet = opening if len(opening) <= SNIPPET else opening[: SNIPPET - 1] + "…"
        if tag not in VOID:
            self.open.append(row)
            self.opened[tag] += 1
            if row.textual:
                self.textual.append(row)
            if tag in HIDDEN_TEXT:
                self.hidden.append(row)

    def _opening(self) -> str:
        """The opening tag as the source has it; a > inside braces (an attribute that is an expression) doesn't end it."""
        text = self.get_starttag_text() or ""
        if text.count("{") <= text.count("}"):
            return text
        line, column = self.getpos()
        at = self.lines[line - 1] + column
        quote, depth = "", 0
        for i in range(at, min(at + LONGEST_TAG, len(self.source))):
            c = self.source[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c == "{":
                depth += 1
            elif c == "}":
                depth = max(0, depth - 1)
            elif c == ">" and not depth:
                return self.source[at : i + 1]
        return text

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.opened[tag]:
            return
        while True:
            row = self.open.pop()
            row.last = len(self.rows) - 1
            self.opened[row.tag] -= 1
            for stack in (self.textual, self.hidden):
                if stack and stack[-1] is row:
                    stack.pop()
            if row.tag == tag:
                return

    @staticmethod
    def _own(up: _Row, data: str) -> None:
        if up.pos >= 0:
            if up.own is None:
                up.own = []
            up.own.append(data)

    def handle_data(self, data: str) -> None:
        self._add("#text", [], data)
        up = self.open[-1]
        self._own(up, data)
        bare = data.strip()
        if not bare:
            return
        if self.hidden:  # text of the innermost hidden element alone, and only directly in it
            takers = [self.hidden[-1]] if self.hidden[-1] is up and up.textual else []
        else:
            takers = self.textual[-TEXT_LEVELS:]
        for row in takers:
            if row.parts is None:
                row.parts = []
            row.parts.append(bare)

    def handle_comment(self, data: str) -> None:
        self._add("#comment", [], data)
        self._own(self.open[-1], data)

    def handle_decl(self, decl: str) -> None:
        self._add("#doctype", [], decl)

    def unknown_decl(self, data: str) -> None:
        self._add("#comment", [], data)


def selector(row: _Row) -> str:
    """The path of an element, of a text that of its parent. Of a very deep one the last steps, behind a hash of those above."""
    steps, at = [], row if row.step else row.up
    while at.pos >= 0 and len(steps) < SELECTOR_STEPS:
        steps.append(at.step)
        at = at.up
    if at.pos >= 0:
        steps.append(f"…{at.path:016x}")
    return " > ".join(reversed(steps))


def parse(source: str | None) -> list[_Row]:
    """Rows of one document, in order; null gives none. Time and memory are linear in the document, however deep it is."""
    if not source:
        return []
    tree = _Tree(source)
    for row in tree.rows:
        if row.tag[0] != "#":
            row.text = squeeze(" ".join(row.parts or ())) if row.tag not in HIDDEN_TEXT else "".join(row.own or ())
        row.own = squeeze(" ".join(row.own or ()))
        row.parts = None
    return tree.rows


_TYPES = [
    ("pos", pa.int32()), ("parent", pa.int32()), ("parent_last", pa.int32()), ("depth", pa.int32()), ("last", pa.int32()), ("tag", pa.string()),
    ("attrs", pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))), ("own", pa.string()), ("text", pa.string()), ("ancestors", pa.list_(pa.string())),
    ("lang_above", pa.bool_()), ("repeats", pa.bool_()), ("selector", pa.string()), ("line", pa.int32()), ("snippet", pa.string()),
]


def _columns(rows: list[_Row], end: int) -> list[pa.Array]:
    data = {
        "pos": [r.pos for r in rows], "parent": [r.up.pos for r in rows], "parent_last": [r.up.last if r.up.pos >= 0 else end for r in rows], "depth": [r.depth for r in rows],
        "last": [r.last for r in rows], "tag": [r.tag for r in rows], "attrs": [[{"k": k, "v": v} for k, v in r.attrs] for r in rows], "own": [r.own for r in rows], "text": [r.text for r in rows],
        "ancestors": [r.above for r in rows], "lang_above": [r.lang_above for r in rows], "repeats": [r.copy is not None and r.tag in COPY and r.text == r.copy.text for r in rows],
        "selector": [selector(r) for r in rows], "line": [r.line for r in rows], "snippet": [r.snippet for r in rows],
    }
    return [pa.array(data[n], t) for n, t in _TYPES]


def nodes(docs: DataFrame, key: str, html: str, *keep: str) -> DataFrame:
    """Rows of all documents: key, keep, the columns of SCHEMA, attr (map), classes and rel (arrays, split at blanks).

    tag is #text, #comment or #doctype for what is no element. pos counts in document order, and an element's
    descendants are the rows with pos up to its `last`. text: of some elements (TEXTUAL) all their text, squeezed; a text
    counts for the TEXT_LEVELS innermost ones. ancestors: which of WATCHED are above. lang_above: something above has a
    lang. repeats: an element of COPY with the text of the nearest one above it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = parse(batch.column(batch.num_columns - 1)[i].as_py())
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    same = [pa.array([batch.column(c)[i].as_py()] * len(part), batch.schema.field(c).type) for c in range(batch.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays([*same, *_columns(part, len(rows))], [*batch.schema.names[:-1], *[n for n, _ in _TYPES]])

    narrow = docs.select(key, *keep, F.col(html).alias("_html"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    found = narrow.mapInArrow(run, f"{fields}, {SCHEMA}")
    attr = F.map_from_entries("attrs")
    split = lambda name: F.array_remove(F.split(F.coalesce(F.try_element_at(attr, F.lit(name)), F.lit("")), r"\s+", -1), "")
    return found.withColumns({"attr": attr, "classes": split("class"), "rel": F.transform(split("rel"), lambda r: F.lower(r))})


def elements(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.startswith("tag", F.lit("#")))


def texts(rows: DataFrame) -> DataFrame:
    return rows.filter("tag = '#text'")
