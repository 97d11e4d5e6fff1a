"""Operator 7, HTML extraction by layout-aware rendering.

A scanner that reads each character once feeds a tree builder that closes what HTML closes by implication; a walk over
the tree leaves out what is not visible and emits text blocks with their spacing, list marks and numbers, and tables
with cells aligned by column. All visible text comes out: what repeats on every page (navigation, footers) is as visible
as the rest. Nothing depends on the depth of the markup: look-ups in the open elements go by position, and the walk keeps
its own stack.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import quoted, slices

_NAMES = lambda s: frozenset(s.split())
VOID = _NAMES("area base br col embed hr img input link meta param source track wbr")
RAW = _NAMES("script style textarea title xmp iframe noembed noframes noscript")
HIDDEN = _NAMES(
    "head script style title template noscript iframe noembed noframes object canvas audio video datalist meta link base meter progress rp desc metadata defs symbol"
)
BLOCK = _NAMES(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table caption thead tbody tfoot tr ul"
)
#: Blocks with a blank line around them.
SPACED = _NAMES("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl menu dir pre table figure fieldset hr")
CLOSES_P = BLOCK - _NAMES("body html tr thead tbody tfoot caption legend dd dt li") | _NAMES("li dd dt")
_ROWS = _NAMES("thead tbody tfoot tr td th caption colgroup")
#: A start tag ends these open elements, unless one of the second set stands in between.
IMPLIED = {
    "li": (_NAMES("li"), _NAMES("ul ol menu dir")),
    "dt": (_NAMES("dt dd"), _NAMES("dl")),
    "dd": (_NAMES("dt dd"), _NAMES("dl")),
    "option": (_NAMES("option"), _NAMES("select datalist")),
    "optgroup": (_NAMES("option optgroup"), _NAMES("select")),
    "tr": (_NAMES("tr td th caption colgroup"), _NAMES("table")),
    "td": (_NAMES("td th"), _NAMES("table tr")),
    "th": (_NAMES("td th"), _NAMES("table tr")),
    "thead": (_ROWS, _NAMES("table")),
    "tbody": (_ROWS, _NAMES("table")),
    "tfoot": (_ROWS, _NAMES("table")),
    "body": (_NAMES("head"), _NAMES("")),
}
#: An end tag looks for its element no further up than these; those of tables only up to the table.
SCOPE = _NAMES("table td th caption template html")
_TABLE_ENDS = _NAMES("table tr td th thead tbody tfoot caption body html")
#: Inputs without text of their own.
_MUTE = _NAMES("hidden checkbox radio password file image range color")
#: Indents grow up to so many columns; tables inside so many others stand cell by cell, a line each.
MOST_INDENT, ALIGNED_DEPTH = 120, 40

_TAG_NAME = re.compile(r"[^\s/>]+")
_SKIP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_UNQUOTED = re.compile(r"[^\s>]+")
_BLANK = re.compile(r"[ \t\n\r\f]+")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)
_ZEROS, _HUGE = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])"), re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")


def _unescape(s: str) -> str:
    """Character references become characters; a number beyond all code points becomes U+FFFD, however long."""
    if "&" not in s:
        return s
    return html.unescape(_HUGE.sub("�", _ZEROS.sub(r"&#\1", s)) if "&#" in s else s)


@dataclass(slots=True)
class Node:
    """children: nodes and strings."""

    tag: str
    attrs: dict[str, str]
    children: list = field(default_factory=list)


class _Open:
    """The open elements, and where those of each name stand among them."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.at: dict[str, list[int]] = defaultdict(list)

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.at[self.stack.pop().tag].pop()

    def last(self, tags: frozenset[str] | tuple[str, ...]) -> int:
        """The place of the innermost open element of these names; 0: none."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=0)

    def start(self, tag: str) -> None:
        """What a start tag ends by implication."""
        if tag in CLOSES_P and (p := self.last(("p",))) > max(self.last(SCOPE), self.last(("button",))):
            self.cut(p)
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            inside = self.last(stops) + 1
            if found := [places[k] for t in ends if (places := self.at.get(t)) and (k := bisect_left(places, inside)) < len(places)]:
                self.cut(min(found))

    def end(self, tag: str) -> None:
        """Ends the nearest open element of that name, and what is open inside it; an end tag without one is passed over."""
        here = self.last((tag,))
        if here and here >= self.last(("table",) if tag in _TABLE_ENDS else SCOPE):
            self.cut(here)


def _attributes(source: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes from at on, whether the tag ends with a slash, and where it ends; -1 if the source ends before."""
    out: dict[str, str] = {}
    n = len(source)
    while True:
        gap = _SKIP.match(source, at)
        at = gap.end()
        if at >= n:
            return out, False, -1
        if source[at] == ">":
            return out, gap[0].endswith("/"), at + 1
        name = _ATTRIBUTE.match(source, at)
        at, value = name.end(), ""
        if equals := _EQUALS.match(source, at):
            at = equals.end()
            if at < n and source[at] in "\"'":
                close = source.find(source[at], at + 1)
                if close < 0:
                    return out, False, -1
                value, at = source[at + 1 : close], close + 1
            elif bare := _UNQUOTED.match(source, at):
                value, at = bare[0], bare.end()
        out.setdefault(name[0].lower(), _unescape(value))


def parse(source: str) -> Node:
    """The tree of a page or fragment; nothing is an error. What is inside a tag that never ends isn't text."""
    root = Node("#root", {})
    open_ = _Open(root)
    n, at = len(source), 0

    def text(a: int, b: int) -> None:
        if b > a:
            open_.stack[-1].children.append(_unescape(source[a:b]))

    def behind(mark: str, from_: int) -> int:
        found = source.find(mark, from_)
        return n if found < 0 else found + len(mark)

    begun = 0  # of the text that is not yet in the tree
    while (at := source.find("<", at)) >= 0:
        kind = source[at + 1 : at + 2]
        closing = kind == "/"
        letter = source[at + 2 : at + 3] if closing else kind
        if not (letter.isascii() and letter.isalpha()):
            if not closing and kind not in ("!", "?") or not letter:
                at += 1
                continue
            text(begun, at)
            if source.startswith("<!--", at):
                at = at + 5 if source.startswith("<!-->", at) else behind("-->", at + 4)
            elif source.startswith("<![CDATA[", at):
                end = behind("]]>", at + 9)
                if end > at + 9:
                    open_.stack[-1].children.append(source[at + 9 : end - 3 if source.endswith("]]>", at + 9, end) else end])
                at = end
            else:
                at = behind(">", at + 2)
            begun = at
            continue
        text(begun, at)
        name = _TAG_NAME.match(source, at + 1 + closing)
        tag = name[0].lower()
        attrs, slash, at = _attributes(source, name.end())
        if at < 0:
            return root
        begun = at
        if closing:
            open_.end(tag)
            continue
        open_.start(tag)
        node = Node(tag, attrs)
        open_.stack[-1].children.append(node)
        if tag in VOID or slash and tag not in BLOCK and tag not in RAW:
            continue
        if tag not in RAW:
            open_.push(node)
            continue
        close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
        stop = close.start() if close else n
        body = source[at:stop]
        node.children.append(_unescape(body) if tag in ("title", "textarea") else body)
        at = begun = behind(">", stop) if close else n
    text(begun, n)
    return root


def displayed(node: Node) -> bool:
    """Whether the element has a place on the page: not of a hidden kind, nor `display: none` by attribute or style."""
    if node.tag in HIDDEN:
        return False
    a = node.attrs
    return not a or not ("hidden" in a or "style" in a and _DISPLAY.search(a["style"]) or node.tag == "dialog" and "open" not in a)


def _seen(node: Node, seen: bool) -> bool:
    """Whether the element's own text is visible; unless it says so itself, as its parent's."""
    if "style" in node.attrs and (found := _VISIBILITY.findall(node.attrs["style"])):
        return found[-1].lower() == "visible"
    return seen


class _Writer:
    """Lines of text; white space collapses across inline elements; blank lines never double."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.indent = 0
        self.mark = ""
        self.blank = False

    def inline(self, s: str) -> None:
        s = _BLANK.sub(" ", s)
        if s and (s != " " or self.parts) and not (s[0] == " " and self.parts and self.parts[-1].endswith(" ") and not (s := s[1:])):
            self.parts.append(s)

    def line(self, s: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.append(f"{' ' * self.indent}{self.mark}{s}".rstrip())
        self.indent = min(MOST_INDENT, self.indent + len(self.mark))
        self.mark = ""

    def end_line(self, keep_empty: bool = False) -> None:
        s = "".join(self.parts).strip(" ")
        self.parts.clear()
        if s or keep_empty and self.lines:
            self.line(s)

    def space(self) -> None:
        self.end_line()
        self.blank = True


#: A step of the walk hands over the steps that come first.
_Steps = Generator["_Steps", None, None]


def _walk(steps: _Steps) -> None:
    todo = [steps]
    while todo:
        inner = next(todo[-1], None)
        if inner is None:
            todo.pop()
        else:
            todo.append(inner)


def render(source: str | None) -> str:
    """All visible text of a page, laid out. Null: empty."""
    out = _Writer()
    _walk(_children(parse(source or ""), out, True, 0))
    out.end_line()
    return "\n".join(out.lines)


def _int(s: str, least: int, most: int, other: int) -> int:
    return max(least, min(most, int(s))) if re.fullmatch(r"\s*-?[0-9]{1,9}\s*", s) else other


def _children(node: Node, out: _Writer, seen: bool, tables: int) -> _Steps:
    """Writes what is inside node. seen: whether its own text is visible; tables: in how many tables it stands."""
    number = _int(node.attrs.get("start", "1"), -(10**9), 10**9, 1) if node.tag == "ol" else 1
    summary = None
    if node.tag == "details" and "open" not in node.attrs:  # closed: its first summary alone
        summary = next((c for c in node.children if isinstance(c, Node) and c.tag == "summary"), node)
    for child in node.children:
        if summary is not None and child is not summary:
            continue
        if isinstance(child, str):
            if seen:
                out.inline(child)
            continue
        if not displayed(child):
            continue
        tag, shows = child.tag, _seen(child, seen)
        if tag == "br":
            out.end_line(keep_empty=bool(out.parts))
        elif tag == "img":
            if shows and (alt := child.attrs.get("alt", "").strip()):
                out.inline(f" {alt} ")
        elif tag == "input":
            if shows and child.attrs.get("type", "").lower() not in _MUTE and (value := child.attrs.get("value") or child.attrs.get("placeholder", "")):
                out.inline(f" {value} ")
        elif tag == "select":
            if shows:
                out.inline(" " + " ".join(_options(child)) + " ")
        elif tag == "hr":
            out.space()
        elif tag in ("pre", "textarea", "xmp"):
            _pre(child, out, shows)
        elif tag == "table":
            yield _table(child, out, shows, tables)
        elif tag == "li":
            out.end_line()
            if node.tag == "ol" and (own := child.attrs.get("value")):
                number = _int(own, -(10**9), 10**9, number)
            before, out.mark = out.indent, f"{number}. " if node.tag == "ol" else "- "
            number += 1
            yield _children(child, out, shows, tables)
            out.end_line()
            out.indent, out.mark = before, ""
        elif tag in ("dd", "blockquote"):
            out.space() if tag == "blockquote" else out.end_line()
            before, out.indent = out.indent, min(MOST_INDENT, out.indent + 4)
            yield _children(child, out, shows, tables)
            out.space() if tag == "blockquote" else out.end_line()
            out.indent = before
        elif tag in BLOCK:
            nested = tag in ("ul", "ol", "menu", "dir") and node.tag == "li"
            out.space() if tag in SPACED and not nested else out.end_line()
            yield _children(child, out, shows, tables)
            out.space() if tag in SPACED and not nested else out.end_line()
        else:
            yield _children(child, out, shows, tables)


def _plain(node: Node, seen: bool = True) -> str:
    """Visible text inside node as it stands in the source."""
    parts: list[str] = []
    todo: list[tuple[Node | str, bool]] = [(node, seen)]
    while todo:
        x, shows = todo.pop()
        if isinstance(x, str):
            parts.append(x if shows else "")
        elif x is node or displayed(x):
            parts.append("\n" if x.tag == "br" else "")
            todo.extend((c, shows if isinstance(c, str) else _seen(c, shows)) for c in reversed(x.children))
    return "".join(parts)


def _options(select: Node) -> list[str]:
    """The labels that a list of choices shows: all of a list box, the selected or else the first of a drop-down."""
    found, todo = [], [*reversed(select.children)]
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and displayed(x):
            if x.tag == "option":
                found.append(x)
            else:
                todo.extend(reversed(x.children))
    if not ("multiple" in select.attrs or _int(select.attrs.get("size", "1"), 1, 1000, 1) > 1):
        found = [x for x in found if "selected" in x.attrs][-1:] or found[:1]
    return [x.attrs.get("label") or _BLANK.sub(" ", _plain(x)).strip() for x in found]


def _pre(node: Node, out: _Writer, seen: bool) -> None:
    out.space()
    text = _plain(node, seen).replace("\r\n", "\n").strip("\n")
    if text:
        for s in text.split("\n"):
            out.line(s)
    out.blank = True


def _table(node: Node, out: _Writer, seen: bool, tables: int) -> _Steps:
    """Cells of a column start at one place, two blanks behind the widest.

    A column span takes its columns' places, a row span its column in the rows below. Headers stand first, footers last.
    """
    out.space()
    sections: dict[str, list[list[list[tuple[Node, bool]]]]] = {"thead": [], "tbody": [], "tfoot": []}
    loose: list = []
    captions: list[tuple[Node, bool]] = []

    def row(tr: Node, shows: bool) -> list[tuple[Node, bool]]:
        cells = []
        for c in tr.children:
            if isinstance(c, Node) and c.tag in ("td", "th"):
                if displayed(c):
                    cells.append((c, _seen(c, shows)))
            elif isinstance(c, Node) and displayed(c) or isinstance(c, str) and shows and not c.isspace():
                loose.append(c)
        return cells

    bodies: list[tuple[Node, bool]] = []
    direct: list[list[tuple[Node, bool]]] = []
    for c in node.children:
        if isinstance(c, str):
            if seen and not c.isspace():
                loose.append(c)
        elif displayed(c):
            shows = _seen(c, seen)
            if c.tag == "tr":
                if not direct:
                    sections["tbody"].append(direct)
                direct.append(row(c, shows))
            elif c.tag in sections:
                bodies.append((c, shows))
                group: list[list[tuple[Node, bool]]] = []
                for d in c.children:
                    if isinstance(d, Node) and d.tag == "tr":
                        if displayed(d):
                            group.append(row(d, _seen(d, shows)))
                    elif isinstance(d, Node) and displayed(d) or isinstance(d, str) and shows and not d.isspace():
                        loose.append(d)
                sections[c.tag].append(group)
                direct = []
            elif c.tag == "caption":
                captions.append((c, shows))
            else:
                loose.append(c)
    for c, shows in captions:
        yield _children(c, out, shows, tables)
        out.end_line()
    if loose:  # text inside a table but outside its cells stands before it
        yield _children(Node("div", {}, loose), out, seen, tables)
        out.end_line()
    groups = [g for part in sections.values() for g in part]
    if tables >= ALIGNED_DEPTH or sum(len(r) for g in groups for r in g) == 1:
        for c, shows in (cell for g in groups for r in g for cell in r):
            yield _children(c, out, shows, tables + 1)
            out.end_line()
        out.blank = True
        return
    rows: list[list[tuple[int, list[str], int]]] = []
    for g in groups:
        busy: dict[int, int] = {}  # rows that a column stays taken from above
        for k, cells in enumerate(g):
            placed, at, below = [], 0, {}
            for c, shows in cells:
                while busy.get(at, 0) > 0:
                    at += 1
                inner = _Writer()
                yield _children(c, inner, shows, tables + 1)
                inner.end_line()
                across = _int(c.attrs.get("colspan", "1"), 1, 1000, 1)
                down = _int(c.attrs.get("rowspan", "1"), 0, 65534, 1) or len(g) - k
                if down > 1:
                    below |= dict.fromkeys(range(at, at + across), min(down, len(g) - k))
                placed.append((at, inner.lines, across))
                at += across
            busy = {c: n - 1 for c, n in (busy | below).items() if n > 1}
            rows.append(placed)
    widths: dict[int, int] = {}
    for cells in rows:
        for at, lines, across in cells:
            if across == 1:
                widths[at] = max(widths.get(at, 0), max(map(len, lines), default=0))
    used = sorted(widths)
    starts = [0]
    for c in used:
        starts.append(starts[-1] + widths[c] + 2)
    for cells in rows:
        for k in range(max((len(lines) for _, lines, _ in cells), default=0)):
            s, parts = 0, []
            for at, lines, _ in cells:
                text = lines[k] if k < len(lines) else ""
                if text:
                    place = max(starts[bisect_left(used, at)], s + 1 if s else 0)
                    parts.append(" " * (place - s) + text)
                    s = place + len(text)
            out.line("".join(parts))
    out.blank = True


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of pages, then text, all visible text of html, and n_chars and n_lines of it.

    Null or empty html: empty text, 0, 0. Broken markup never fails, and time grows with the page's length, whatever is in
    it. Repeated rows, null keys and an empty table pass through; other columns are ignored unless named in keep.
    """
    own = [f"_k{i}" for i in range(len(keep))]
    narrow = pages.select(*[quoted(c).alias(o) for c, o in zip(keep, own, strict=True)], F.col("html").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(len(own))):
                part = batch.slice(a, b - a)
                text = [render(h) for h in part.column(len(own)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array((t.count("\n") + 1 if t else 0 for t in text), pa.int64())], [*own, "text", "n_chars", "n_lines"])

    fields = [f.simpleString().replace(":", " ", 1) for f in narrow.schema.fields[:-1]]
    return narrow.mapInArrow(run, ", ".join([*fields, "text string", "n_chars long", "n_lines long"])).withColumnsRenamed(dict(zip(own, keep, strict=True)))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id"])


QUERIES = {"op7_html_extraction": op7_html_extraction}
SQL: dict[str, str] = {}
