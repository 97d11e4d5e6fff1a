"""Style sheets as text: blocks by balanced braces, of any nesting, in one pass."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: up to this width in px a block is for small screens.
SMALL_SCREEN = 900
_MARK = re.compile(r"@media|[{}]")
_WIDTH = re.compile(r"max-width\s*:\s*(\d+)px")


def without_small_blocks(css: str) -> str:
    """css without the @media blocks whose first max-width is SMALL_SCREEN or less; a block ends with its own brace.

    Blocks inside other at-rules are found too; one inside another @media block goes or stays with that. A block that never
    closes reaches to the end; without a brace behind it, what follows @media goes.
    """
    out, at, start, depth = [], 0, -1, 0
    for m in _MARK.finditer(css):
        mark = m[0]
        if mark == "@media":
            if start < 0:
                out.append(css[at : m.start()])
                start, depth = m.start(), 0
        elif start >= 0:
            depth += 1 if mark == "{" else -1
            if depth <= 0:
                out.append(_kept(css[start : m.end()]) if mark == "}" and depth == 0 else css[start : m.end()])
                at, start = m.end(), -1
    if start >= 0:
        out.append(_kept(css[start:]) if depth else "")
        at = len(css)
    return "".join([*out, css[at:]])


def _kept(block: str) -> str:
    first = _WIDTH.search(block)
    return "" if first and int(first[1]) <= SMALL_SCREEN else block


@F.pandas_udf(StringType())
def small_blocks_dropped(css: pd.Series) -> pd.Series:
    return css.map(without_small_blocks, na_action="ignore")
