"""Markdown pages, and text broken into lines of a width.

Inline marks are read by one grammar of tokens (`text.inline_markup` has it as a column expression). A page is a run of
lines, each of one class; neighbours of a class make a block, and each class has its own way to be written.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"`(?P<code>[^`]+)`|!\[(?P<alt>[^\]]*)\]\((?P<src>[^)]*)\)|\[(?P<label>[^\]]*)\]\((?P<href>[^)]*)\)|\*\*(?P<strong>.+?)\*\*|(?<!\*)\*(?!\*)(?P<em>.+?)(?<!\*)\*(?!\*)|(?<!_)_(?!_)(?P<under>.+?)(?<!_)_(?!_)",
    re.DOTALL,
)
#: Classes of lines; the first that fits counts.
_LINE = re.compile(r"(?P<fence>```.*)|(?P<heading>#{1,6} .*)|(?P<rule>\s*(?:-{3,}|\*{3,}|_{3,})\s*)|(?P<quote>>.*)|(?P<bullet>[-*] .*)|(?P<number>\d+\. .*)|(?P<table>\|.*)|(?P<blank>\s*)|(?P<text>.*)", re.DOTALL)


def inline(text: str) -> str:
    def write(m: re.Match) -> str:
        if m["code"]:
            return f"<code>{m['code']}</code>"
        if m["src"] is not None:
            return f'<img src="{m["src"]}" alt="{m["alt"]}">'
        if m["href"] is not None:
            return f'<a href="{m["href"]}">{inline(m["label"])}</a>'
        return _tag("strong" if m["strong"] else "em", inline(m["strong"] or m["em"] or m["under"]))

    return _TOKEN.sub(write, text)


def _classed(lines: list[str]) -> Iterator[tuple[str, str]]:
    """Each line with its class; lines between fences are code, whatever they hold."""
    fenced = False
    for line in lines:
        kind = _LINE.fullmatch(line).lastgroup
        if kind == "fence":
            fenced = not fenced
            yield ("open" if fenced else "close"), line
        else:
            yield ("code" if fenced else kind), line


def _tag(name: str, inner: str) -> str:
    return f"<{name}>{inner}</{name}>"


def _table(lines: list[str]) -> str:
    rows = [[inline(c.strip()) for c in x.strip().strip("|").split("|")] for x in lines]
    body = [r for x, r in zip(lines[1:], rows[1:], strict=True) if len(r) == len(rows[0]) and re.search(r"[^\s|:-]", x)]
    written = ["".join(_tag(cell, c) for c in r) for cell, r in [("th", rows[0]), *(("td", r) for r in body)]]
    return _tag("table", "".join(_tag("tr", r) for r in written))


def _items(name: str) -> Callable[[list[str]], str]:
    return lambda lines: _tag(name, "".join(_tag("li", inline(x.partition(" ")[2])) for x in lines))


def _headings(lines: list[str]) -> str:
    return "\n".join(_tag(f"h{len(x) - len(x.lstrip('#'))}", inline(x.lstrip("#").strip(" "))) for x in lines)


_BLOCKS: dict[str, Callable[[list[str]], str]] = {
    "heading": _headings,
    "rule": lambda lines: "\n".join("<hr>" for _ in lines),
    "quote": lambda lines: _tag("blockquote", to_html("\n".join(x[1:].removeprefix(" ") for x in lines))),
    "bullet": _items("ul"),
    "number": _items("ol"),
    "table": _table,
    "text": lambda lines: _tag("p", inline(" ".join(x.strip() for x in lines))),
}


def to_html(page: str) -> str:
    """The page's blocks, one below the other."""
    out, language, fenced = [], "", False
    for kind, run in groupby(_classed(page.split("\n")), key=lambda x: x[0]):
        lines = [x for _, x in run]
        if kind == "open":
            language, fenced = lines[0][3:].strip(), True
            out.append(f'<pre class="language-{language}"><code>' if language else "<pre><code>")
        elif kind == "code":
            out[-1] += html.escape("\n".join(lines), quote=False)
        elif kind == "close":
            out[-1] += "\n</code></pre>"
            fenced = False
        elif kind != "blank":
            out.append(_BLOCKS[kind](lines))
    return "\n".join(out) + ("\n</code></pre>" if fenced else "")


def markdown_html(column):
    @F.pandas_udf("string")
    def f(pages: pd.Series) -> pd.Series:
        return pages.map(to_html, na_action="ignore")

    return f(column)


def wrapped(text: Column | str, width: int) -> Column:
    """Lines of at most `width` characters, as an array: broken at the last space that fits, or hard where there is none.

    Paragraphs keep their breaks, blank ones too. A paragraph is cut by one regular expression: its rest, or as much as
    a space ends, or `width` characters.
    """
    text = F.col(text) if isinstance(text, str) else text
    if width <= 0:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    piece = F.lit(rf"(?s)(.{{0,{width}}}\z|.{{1,{width}}}(?= )|.{{{width}}}) *")

    def broken(paragraph: Column) -> Column:
        raw, lines = F.regexp_extract_all(paragraph, piece, F.lit(0)), F.regexp_extract_all(paragraph, piece, F.lit(1))
        # the end of a paragraph is found once more as an empty rest; it is a line only after spaces that a break took
        kept = (F.size(raw) == 1) | (F.length(F.element_at(raw, -2)) > width)
        return F.when(kept, lines).otherwise(F.slice(lines, F.lit(1), F.size(lines) - 1))

    return F.flatten(F.transform(F.split(text, "\n", -1), broken))
