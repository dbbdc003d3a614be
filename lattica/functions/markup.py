"""Elements of HTML by a tokenizer with a stack of open elements: one pass over a page, whatever is nested, left open or cut off."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.operators.names import fresh

# Fixed values of the HTML standard: elements without an end tag, elements whose content is no markup, and end tags that may be left out:
# an element is closed by the start of one of the listed elements, as long as no element of its bounds stands between.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
CLOSED_BY = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "p": ("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul", "button td th table object"),
    "option": ("option optgroup", "select datalist"),
    "td": ("td th tr tbody tfoot", "table"),
    "th": ("td th tr tbody tfoot", "table"),
    "tr": ("tr tbody tfoot", "table"),
    "thead": ("tbody tfoot", "table"),
    "tbody": ("tbody tfoot", "table"),
}
_CLOSES: dict[str, list[tuple[str, frozenset]]] = {}
for _open, (_starts, _bounds) in CLOSED_BY.items():
    for _start in _starts.split():
        _CLOSES.setdefault(_start, []).append((_open, frozenset(_bounds.split())))
#: Pages whose elements are held at once.
ROWS = 100
_NAME = re.compile(r"[^\s/>]+")
_QUOTES = re.compile("[\"'>]")


def _tag_end(html: str, at: int) -> int:
    """The place of the > that ends the tag, quoted ones passed over; -1 if there is none."""
    while (m := _QUOTES.search(html, at)) is not None:
        if m[0] == ">":
            return m.start()
        at = html.find(m[0], m.end()) + 1
        if not at:
            return -1
    return -1


def tokens(html: str) -> Iterator[tuple[str, str]]:
    """(kind, value): text, start and end, the latter with names in lower case; `alone` for an element without content. A tag that is cut off ends the page."""
    at, n = 0, len(html)
    while at < n:
        begin = html.find("<", at)
        if begin < 0:
            yield "text", html[at:]
            return
        if begin > at:
            yield "text", html[at:begin]
        after = html[begin + 1 : begin + 2]
        if html.startswith("<!--", begin):
            at = html.find("-->", begin + 4) + 3
            if at == 2:
                return
        elif after in ("!", "?"):
            at = html.find(">", begin) + 1
            if not at:
                return
        elif after.isalpha() or (after == "/" and html[begin + 2 : begin + 3].isalpha()):
            end = _tag_end(html, begin + 1)
            if end < 0:
                return
            name = _NAME.match(html, begin + (2 if after == "/" else 1))[0].lower()
            at = end + 1
            if after == "/":
                yield "end", name
            elif name in VOID:
                yield "alone", name
            else:
                yield "start", name
                if name in RAW:
                    close = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(html, at)
                    to = close.start() if close else n
                    if to > at:
                        yield "raw", html[at:to]
                    at = to
        elif not after and begin + 1 == n:
            return
        else:
            yield "text", "<"
            at = begin + 1


def elements(html: str, tag: str) -> list[tuple[int, str]]:
    """(depth, text) of all elements of a tag in the order of their starts; depth counts the open ones of the same tag about it. Scripts and styles are no text, texts are trimmed."""
    stack: list[tuple[str, int]] = []  # name, number among the wanted ones or -1
    texts: list[str] = []
    found: list[list[int]] = []  # depth, first and last text
    depth = 0
    open_now: Counter[str] = Counter()

    def close(k: int) -> None:
        nonlocal depth
        for name, i in stack[k:]:
            open_now[name] -= 1
            if i >= 0:
                found[i][2] = len(texts)
                depth -= 1
        del stack[k:]

    for kind, value in tokens(html):
        if kind == "text" or (kind == "raw" and stack[-1][0] not in ("script", "style")):
            texts.append(value)
        elif kind == "end":
            if open_now[value]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == value))
        elif kind in ("start", "alone"):
            for name, bounds in _CLOSES.get(value, ()):
                for k in range(len(stack) - 1, -1, -1) if open_now[name] else ():
                    if stack[k][0] == name:
                        close(k)
                        break
                    if stack[k][0] in bounds:
                        break
            if value == tag:
                found.append([depth, len(texts), len(texts)])
            if kind == "start":
                stack.append((value, len(found) - 1 if value == tag else -1))
                open_now[value] += 1
                depth += value == tag
    close(0)
    return [(d, "".join(texts[a:b]).strip()) for d, a, b in found]


def cells(pages: DataFrame, tag: str, html: str = "html", name: str = "cells") -> DataFrame:
    """pages with an array of (depth, text) of a tag's elements; null pages have none."""
    tag, x = tag.lower(), fresh(pages)
    others = [c for c in pages.columns if c != name]
    kinds = pa.list_(pa.struct([("depth", pa.int32()), ("text", pa.string())]))
    schema = ", ".join([*[f"`{c}` {t}" for c, t in pages.dtypes if c != name], f"`{name}` array<struct<depth:int,text:string>>"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            made = [[{"depth": d, "text": t} for d, t in elements(h, tag)] if h is not None else [] for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, kinds)], names=[*others, name])

    return pages.select(*[f"`{c}`" for c in others], pages[html].cast("string").alias(x)).mapInArrow(each, schema)
