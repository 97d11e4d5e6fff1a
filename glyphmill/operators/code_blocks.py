"""Copy and comments out of source files, with exact offsets.

Offsets are what columns can't give, so files are read in Arrow batches. Small scanners walk over a file and yield spans:
delimited regions (comments, docstrings, scripts), string literals with the code that leads up to them, and the text
between tags. What counts as copy is decided by names that lead to a literal and by the shape of its words.
"""

from __future__ import annotations

from bisect import bisect_left
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import BACKEND, is_locale_file

# Names.
ATTRIBUTES = "placeholder alt title aria-label aria-placeholder aria-description aria-roledescription label tooltip helperText helper-text errorText error-text subtitle caption summary".split()
PROPERTIES = "textContent innerText innerHTML placeholder title alt".split()
KEYS = "title subtitle heading subheading description label placeholder message text body caption tooltip hint error errorMessage successMessage confirmText cancelText cta ctaLabel buttonText emptyState helpText".split()
CALLS = "t i18n.t intl.formatMessage translate gettext __ $tc trans".split()
HTML_TAGS = frozenset(
    "a abbr address area article aside audio b base bdi bdo blockquote body br button canvas caption cite code col colgroup data datalist dd del details dfn "
    "dialog div dl dt em embed fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li "
    "link main map mark menu meta meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select "
    "slot small source span strong style sub summary sup table tbody td template textarea tfoot th thead time title tr track u ul var video wbr".split()
)
CODE_WORDS, FIRST_CODE_WORDS = {"import", "export", "return"}, ("const", "let", "var")
DIRECTIVES = ("eslint", "prettier", "ts-", "noqa", "type:", "pragma", "pylint", "flake8", "spdx-", "copyright", "http://", "https://")
TASKS = {"todo", "fixme", "hack", "xxx"}
DATE_LETTERS, DATE_MARKS = "YMDHhms", "-/:., "
SHORTEST, SHORTEST_COMMENT, LONGEST_GAP = 8, 40, 2000
#: Longer than any name or indent that matters.
LONGEST_NAME = 200

_LOW = {kind: frozenset(n.lower() for n in names) for kind, names in (("attribute", ATTRIBUTES), ("property", PROPERTIES), ("key", KEYS), ("call", CALLS))}
_WORD = set(string.ascii_letters + string.digits + "_")
_SLUG = set(string.ascii_lowercase + string.digits)
#: Opening and closing marks of regions; a region that never closes isn't one.
_UNREAD = {"<script": "</script>", "<style": "</style>", "<!--": "-->", "/*": "*/", "//": "\n", "#": "\n"}
_NOTES = {'"""': '"""', "'''": "'''", "<!--": "-->", "/*": "*/", "//": "\n", "#": "\n"}


# ---------------------------------------------------------------- shapes of words


def _only(text: str, allowed: set[str] | str) -> bool:
    return bool(text) and all(c in allowed for c in text)


def _name_like(text: str) -> bool:
    """Letters of any script, digits, _ and -."""
    return bool(text) and all(c.isalnum() or c in "_-" for c in text)


def is_key(text: str) -> bool:
    """An identifier with dots."""
    first, *rest = text.split(".")
    return bool(rest) and _name_like(first) and first[0] in string.ascii_letters + "_" and all(map(_name_like, rest))


def _address(text: str) -> bool:
    scheme, mark, _ = text.partition("://")
    return text.startswith("www.") or bool(mark and scheme) and scheme[0] in string.ascii_letters and all(c.isalnum() or c in "_+.-" for c in scheme)


def _slug(text: str) -> bool:
    parts = text.replace("_", ".").replace("-", ".").split(".")
    return len(parts) > 1 and text[0] in string.ascii_lowercase and all(_only(p, _SLUG) for p in parts)


def _file_path(text: str) -> bool:
    """No blank, a slash: absolute, relative, a media type or folders."""
    if "/" not in text or not all(c.isalnum() or c in "_./-" for c in text):
        kind, _, sub = text.partition("/")
        return _only(kind, string.ascii_lowercase) and _only(sub, _SLUG | set(".+-"))
    return text.startswith(("/", "./", "../")) or not text.endswith("/")


def _selector(text: str) -> bool:
    steps = re.split("[ >+~]", text)
    return steps[0][:1] in (".", "#") and _name_like(steps[0][1:]) and all(s.lstrip(".#") == "" and len(s) < 2 or _name_like(s[1:] if s[0] in ".#" else s) for s in steps[1:])


def _date_format(text: str) -> bool:
    left, found, at = "", False, 0
    while at < len(text):
        if text[at] == "%" and text[at + 1 : at + 2] in set(string.ascii_letters):
            found, at = True, at + 2
        else:
            left, at = left + text[at], at + 1
    return all(c in DATE_LETTERS + DATE_MARKS for c in left) and (found or any(c in DATE_LETTERS for c in left))


def is_technical(text: str) -> bool:
    """Shaped for machines: template, address, media type, identifier, path, selector, date format."""
    if "${" in text:
        return True
    return bool(text) and (_address(text) or _slug(text) or _file_path(text) or _selector(text) or len(text) < 64 and _date_format(text))


def is_code(text: str) -> bool:
    """An arrow, a call of `function`, words of modules and results, a last semicolon, a declaration at the front."""
    low = text.lower()
    words = re.findall(r"\w+", low)
    declared = bool(words) and words[0] in FIRST_CODE_WORDS and low.lstrip().startswith(words[0])
    return "=>" in low or low.rstrip().endswith(";") or declared or not CODE_WORDS.isdisjoint(words) or any(p.lstrip().startswith("(") for p in low.split("function")[1:])


def _without_references(text: str) -> str:
    """Character references like &nbsp; gone."""
    first, *rest = text.split("&")
    out = [first]
    for part in rest:
        name, mark, after = part.partition(";")
        out.append(after if mark and 0 < len(name) < 9 and _only(name, _WORD) else "&" + part)
    return "".join(out)


def is_content(text: str) -> bool:
    """Long enough, with a letter, neither code nor constant nor comment nor technical."""
    if len(text) < SHORTEST or not any(map(str.isalpha, text)) or text.startswith(("//", "/*", "#")):
        return False
    constant = _only(text, string.ascii_uppercase + string.digits + "_")
    return not (constant or is_code(_without_references(text)) or is_technical(text))


def is_note(text: str) -> bool:
    """A comment in words: long enough, no directive of a tool, no licence mark, no task, no bare address."""
    head = text.lstrip().lower()
    first = re.match(r"\w*", head)[0]
    directive = head.startswith(DIRECTIVES) or first in TASKS or head[:1] == "@" and head[1:2].isidentifier()
    return len(text) >= SHORTEST_COMMENT and not directive and any(map(str.isalpha, text))


def shows_text(tag: str) -> bool:
    """Whether text inside such a tag is rendered: HTML's elements, custom elements and components, not type parameters."""
    if tag == tag.lower():
        return tag in HTML_TAGS or "-" in tag
    parameter = len(tag) == 1 or len(tag) == 2 and tag[1].isdigit() or tag[0] == "T" and tag[1].isupper()
    return tag[0].isupper() and not parameter


# ---------------------------------------------------------------- scanners


def regions(raw: str, marks: dict[str, str], hashes: bool) -> Iterator[tuple[int, int, int, int]]:
    """(start, inner start, inner end, end) of what stands between opening and closing marks, from left to right.

    // opens nothing behind a colon or a word; # only where hashes are comments, and not as #{ or $#.
    """
    openers = [m for m in marks if m != "#" or hashes]
    look = re.compile("|".join(map(re.escape, sorted(openers, key=len, reverse=True))), re.I)
    low = raw.lower() if len(raw.lower()) == len(raw) else raw
    never: set[str] = set()
    at = 0
    while found := look.search(raw, at):
        start, inner = found.span()
        opener, before, behind = found[0].lower(), raw[start - 1 : start], raw[inner : inner + 1]
        at = inner
        if opener == "//" and (before == ":" or before == "_" or before.isalnum()) or opener == "#" and (before == "$" or behind == "{"):
            continue
        if opener in ("<script", "<style"):
            if behind.isalnum() or behind == "_":
                continue
        close = marks[opener]
        if close in never:
            continue
        stop = low.find(close, inner)
        if stop < 0 and close != "\n":
            never.add(close)
            continue
        stop = len(raw) if stop < 0 else stop
        at = stop if close == "\n" else stop + len(close)
        yield start, inner, stop, at


def mask(raw: str, suffix: str) -> str:
    """Comments, scripts and styles as blanks; lengths and line ends stay."""
    out, at = [], 0
    for start, _, _, end in regions(raw, _UNREAD, suffix in (".py", ".rb", ".php")):
        out += [raw[at:start], "\n".join(" " * len(line) for line in raw[start:end].split("\n"))]
        at = end
    return "".join([*out, raw[at:]])


def _closing(source: str, quote: int) -> int:
    """Where the literal that opens at quote closes; -1 if it doesn't. A backslash takes the next character with it."""
    mark, at = source[quote], quote + 1
    while (at := source.find(mark, at)) >= 0:
        back = at
        while source[back - 1] == "\\" and back - 1 > quote:
            back -= 1
        if (at - back) % 2 == 0:
            return at
        at += 1
    return -1


def _back(source: str, at: int, of, most: int = LONGEST_NAME) -> int:
    """The first place of the run that ends before at and whose characters are all `of`; no further back than `most`."""
    least = max(0, at - most)
    while at > least and of(source[at - 1]):
        at -= 1
    return at


def _leads(source: str, quote: int) -> tuple[str, str, int]:
    """(mark, name, place of the name) of what leads to a literal: `name =`, `name(`, `name:`; or a bare word before it."""
    part = lambda c: c.isalnum() or c in "_$.-"
    at = _back(source, quote, str.isspace)
    mark = source[at - 1 : at]
    if mark not in ("=", "(", ":"):
        begin = _back(source, at, part)
        return ("word" if at < quote else ""), source[begin:at], begin
    at = _back(source, at - 1, str.isspace)
    if mark in "=:" and source[at - 1 : at] == "]":
        begin = source.rfind("[", max(0, at - 100), at)
        return mark, source[_back(source, begin, part) : at] if begin > 0 else "", begin
    if mark == ":" and at and source[at - 1] in "\"'":
        at -= 1
    begin = _back(source, at, part)
    return mark, source[begin:at], begin


def _tails(name: str) -> Iterator[tuple[int, str]]:
    """The name and its endings that begin at a word's begin, with their places."""
    for k in range(max(0, len(name) - 32), len(name)):
        c = name[k]
        if k == 0 or not (name[k - 1].isalnum() or name[k - 1] == "_") or not (c.isalnum() or c == "_"):
            yield k, name[k:].lower()


def _carries_copy(source: str, quote: int, close: int, suffix: str) -> bool:
    """Whether what stands around a literal says that people read it."""
    mark, name, begin = _leads(source, quote)
    before = source[begin - 1 : begin]
    tails = list(_tails(name))
    if mark == "=":
        if any(t in _LOW["attribute"] and not (k == 0 and before == ":") or t in _LOW["property"] and k and name[k - 1] == "." for k, t in tails):
            return True
        if suffix == ".py" and source[quote] != "`" and name[:1].isupper() and _only(name, string.ascii_uppercase + string.digits + "_"):
            indent = _back(source, begin, " \t".__contains__)
            if indent == 0 or source[indent - 1] == "\n":
                return True
        if suffix in (".rb", ".erb") and name.lower().startswith("flash[:"):
            return True
    if mark == "(" and (any(t in _LOW["call"] for _, t in tails) or suffix == ".py" and name == "_"):
        return True
    if mark == ":" and any(t in _LOW["key"] for _, t in tails):
        return True
    if mark in "=:" and mark and suffix == ".py" and any(t == "detail" for _, t in tails):
        return True
    if suffix == ".php" and mark == "word" and tails and tails[-1][1] == "echo":
        return True
    around = {".php": ("{{", "}}"), ".rb": ("<%=", "%>"), ".erb": ("<%=", "%>")}.get(suffix)
    if not around or source[quote] == "`":
        return False
    at = _back(source, quote, str.isspace)
    ahead = close + 1
    while ahead < len(source) and source[ahead].isspace():
        ahead += 1
    return source.endswith(around[0], 0, at) and source.startswith(around[1], ahead)


def literals(source: str, suffix: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the literals that carry copy, without their quotes."""
    at, open_ = 0, set()
    quotes = re.compile("[\"'`]")
    while found := quotes.search(source, at):
        quote = found.start()
        at = quote + 1
        if found[0] in open_ or not _may_lead(source, quote):
            continue
        close = _closing(source, quote)
        if close < 0:
            open_.add(found[0])
        elif _carries_copy(source, quote, close, suffix):
            yield quote + 1, close
            at = close + 1


def _may_lead(source: str, quote: int) -> bool:
    at = _back(source, quote, str.isspace)
    return at > 0 and (source[at - 1] in "=(:{" or at < quote and source[max(0, at - 4) : at].lower() == "echo")


def _braces(source: str) -> dict[int, int]:
    """Where each opening brace closes."""
    pairs, stack = {}, []
    for m in re.finditer("[{}]", source):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
    return pairs


def _tag_end(source: str, at: int, braces: dict[int, int]) -> int:
    """Behind the > of the tag whose inside is at; quoted values and expressions are stepped over; -1: not a tag."""
    stops = re.compile("[<>\"'{]")
    while found := stops.search(source, at):
        here, mark = found.start(), found[0]
        if mark == ">":
            return here + 1
        if mark == "<":
            return -1
        end = braces.get(here, -1) if mark == "{" else source.find(mark, here + 1)
        if end < 0:
            return -1
        at = end + 1
    return -1


def gaps(source: str) -> Iterator[tuple[int, int]]:
    """(start, end) of text between a rendering tag and the next one, cut at {expressions}."""
    braces = _braces(source)
    name = re.compile(r"</?([A-Za-z][\w.:-]*)")
    at = 0
    while found := name.search(source, at):
        at = found.end()
        before = source[found.start() - 1 : found.start()]
        if before and (before.isalnum() or before in "_)]") or not shows_text(found[1]):
            continue
        begin = _tag_end(source, at, braces)
        if begin < 0:
            continue
        at = begin
        stop = re.compile("[<>]").search(source, begin, begin + LONGEST_GAP + 1)
        if not stop or stop[0] == ">" or stop.start() == begin:
            continue
        piece, end = begin, stop.start()
        while (brace := source.find("{", piece, end)) >= 0 and brace in braces and braces[brace] < end:
            yield piece, brace
            piece = braces[brace] + 1
        yield piece, end


def json_values(raw: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the strings that stand as values of keys."""
    skip = re.compile(r"\s*")
    at, key_ended = 0, False
    while (quote := raw.find('"', at)) >= 0:
        close = _closing(raw, quote)
        if close < 0:
            return
        if key_ended and raw[at:quote].strip() == "":
            yield quote + 1, close
            key_ended, at = False, close + 1
            continue
        at = skip.match(raw, close + 1).end()
        key_ended = raw.startswith(":", at)
        at += key_ended


def yaml_values(raw: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what stands behind `key:` on its line; a plain value holds no #."""
    at = 0
    for line in raw.split("\n"):
        key, mark, value = line.partition(":")
        text = value.strip(" \t\r")
        quoted = len(text) > 1 and text[0] == text[-1] and text[0] in "\"'"
        if mark and value[:1] in (" ", "\t") and text and all(c.isalnum() or c in "_.-" for c in key.strip(" \t")) and key.strip() and (quoted or "#" not in text):
            start = at + len(key) + 1 + value.index(text)
            yield start + quoted, start + len(text) - quoted
        at += len(line) + 1


def _undecorated(comment: str) -> str:
    """Marks in front of a comment's lines gone."""
    lines = []
    for line in comment.split("\n"):
        bare = line.lstrip(" \t")
        words = bare.lstrip("*#/")
        lines.append(line if words == bare else words[1:] if words[:1] in (" ", "\t") else words)
    return "\n".join(lines).strip()


def notes(raw: str) -> Iterator[tuple[int, int]]:
    """(start, end) inside comments and docstrings; # counts at a line's begin only, and not as #!."""
    for start, inner, stop, _ in regions(raw, _NOTES, True):
        if raw[start] == "#" and (raw[raw.rfind("\n", 0, start) + 1 : start].strip(" \t") or raw.startswith("!", inner)):
            continue
        while raw.startswith("/*", start) and inner < stop and raw[inner] == "*":
            inner += 1
        yield inner, stop


# ---------------------------------------------------------------- blocks


def extract(raw: str, path: str, scope: str, locale: bool) -> list[tuple[int, int, str, str]]:
    """(start, end, text, kind) of a file, by start; each span once. scope: content, technical or both."""
    name = path.rsplit("/", 1)[-1]
    suffix = "." + name.rsplit(".", 1)[1].lower() if "." in name else ""
    found: dict[tuple[int, int], str] = {}

    def take(spans: Iterator[tuple[int, int]], kind: str, wanted, source: str = raw) -> None:
        for a, b in spans:
            text = source[a:b]
            start = a + len(text) - len(text.lstrip())
            text = text.strip()
            if text and raw.startswith(text, start) and wanted(text):
                found.setdefault((start, start + len(text)), kind)

    if locale:
        if scope != "technical":
            values = yaml_values(raw) if suffix in (".yml", ".yaml") else json_values(raw)
            take(values, "injected", lambda t: any(map(str.isalpha, t)) and not (is_key(t) or is_code(t) or is_technical(t)))
    else:
        if scope in ("technical", "both"):
            take(notes(raw), "technical", lambda t: is_note(_undecorated(t)))
        if scope in ("content", "both"):
            read = mask(raw, suffix)
            if suffix not in BACKEND:
                take(gaps(read), "markup", lambda t: not {"{", "}"} & set(t) and is_content(t), read)
            take(literals(read, suffix), "injected", lambda t: is_content(t) and not is_key(t), read)
    return [(a, b, raw[a:b], kind) for (a, b), kind in sorted(found.items())]


def code_blocks(files: DataFrame, scope: str = "content") -> DataFrame:
    """(block_id, path, start, end, line, text, kind, language_hint) of files (path, text); null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text, locale in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows = extract(text or "", path, scope, locale)
                if rows:
                    start, end, body, kind = map(list, zip(*rows, strict=True))
                    breaks = [m.start() for m in re.finditer("\n", text)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array([bisect_left(breaks, s) + 1 for s in start], pa.int32()), pa.array(body), pa.array(kind)], ["path", "start", "end", "line", "text", "kind"])

    found = files.select("path", "text", is_locale_file(F.col("path")).alias("_l")).mapInArrow(run, "path string, start int, end int, line int, text string, kind string")
    return found.select(F.substring(F.sha2(F.concat_ws("|", "path", F.col("start").cast("string"), "text"), 256), 1, 16).alias("block_id"), "*", T.guess_language(F.col("text")).alias("language_hint"))
