"""Flattening stored HTML into the few elements a page is read from.

Python only turns markup into a short list of elements per page: those that match a named selector,
with their extent in document order, some attributes and their text. Choosing among them, parsing
and validating happens on that list with Spark column expressions (``operators.extract``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.text import WHITESPACE

# Elements that never have content.
VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
}
# Start tags that end an open element of the listed kinds, within the given limits.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
}
# Start tags that end an open paragraph.
ENDS_PARAGRAPH = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p",
    "pre", "section", "table", "ul",
}

KEPT_ATTRIBUTES = ("class", "content", "datetime", "src", "data-src")
# Characters kept of an element's markup and of the text of the whole body.
MARKUP_WIDTH = 300
BODY_WIDTH = 500

ELEMENT = pa.struct(
    [
        ("seq", pa.int32()),
        ("last", pa.int32()),
        ("roles", pa.list_(pa.string())),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("text", pa.string()),
        ("markup", pa.string()),
    ]
)
ELEMENT_DDL = (
    "array<struct<seq:int,last:int,roles:array<string>,attrs:map<string,string>,text:string,markup:string>>"
)

_SPACE_RUN = re.compile(f"[{WHITESPACE}]+")


_STEP = re.compile(r"^([a-z0-9]*)((?:\.[\w-]+)*)(?:\[([\w-]+)=([^\]]+)\])?$", re.IGNORECASE)


class Step(NamedTuple):
    """One part of a selector: tag, classes and an attribute value, each optional."""

    tag: str
    classes: frozenset
    attribute: str
    value: str

    def fits(self, tag: str, classes: frozenset) -> bool:
        return (not self.tag or self.tag == tag) and self.classes <= classes


def compile_roles(roles: dict[str, str]) -> dict[str, list[tuple[str, list[Step]]]]:
    """Selectors by the tag or class their last step asks for: {key: [(role, steps)]}."""
    by_key: dict[str, list[tuple[str, list[Step]]]] = {}
    for role, selectors in roles.items():
        for selector in selectors.split(","):
            steps = []
            for text in selector.split():
                tag, classes, attribute, value = _STEP.match(text).groups()
                wanted = frozenset(c for c in classes.split(".") if c)
                steps.append(Step(tag, wanted, attribute or "", value or ""))
            last = steps[-1]
            key = "." + min(last.classes) if last.classes else last.tag or "*"
            by_key.setdefault(key, []).append((role, steps))
    return by_key


class _Open:
    """An element whose end has not been seen yet."""

    __slots__ = ("tag", "classes", "row", "text_from", "markup_from")

    def __init__(self, tag, classes, row, text_from, markup_from):
        self.tag, self.classes, self.row = tag, classes, row
        self.text_from, self.markup_from = text_from, markup_from


_NO_CLASSES: frozenset = frozenset()


class _Flattener(HTMLParser):
    def __init__(self, by_key: dict, markup_roles: frozenset) -> None:
        super().__init__(convert_charrefs=True)
        self.by_key, self.markup_roles = by_key, markup_roles
        self.rows: list[dict] = []
        self.stack: list[_Open] = []
        self.text: list[str] = []
        self.length = 0
        self.count = 0

    def flatten(self, html: str) -> list[dict]:
        self.source = html
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))] if self.markup_roles else []
        self.feed(html)
        self.close()
        self._close_down_to(0, len(html))
        whole = "".join(self.text)
        for row in self.rows:
            start, end = row.pop("span")
            row["text"] = whole[start:end]
        return self.rows

    def _at(self) -> int:
        if not self.lines:
            return 0
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _close_down_to(self, depth: int, at: int) -> None:
        while len(self.stack) > depth:
            element = self.stack.pop()
            if element.row is not None:
                element.row["last"] = self.count - 1
                element.row["span"] = (element.text_from, self.length)
                if element.markup_from is not None:
                    markup = _SPACE_RUN.sub(" ", self.source[element.markup_from : at]).strip(" ")
                    element.row["markup"] = markup[:MARKUP_WIDTH]

    def _end_implied(self, tag: str, at: int) -> None:
        closes, limits = IMPLIED_END.get(tag, (set(), set()))
        if tag in ENDS_PARAGRAPH:
            closes, limits = closes | {"p"}, limits | {"button", "td", "th", "table"}
        if not closes:
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth].tag in limits:
                break
            if self.stack[depth].tag in closes:
                self._close_down_to(depth, at)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = self._at()
        if tag in IMPLIED_END or tag in ENDS_PARAGRAPH:
            self._end_implied(tag, at)
        values: dict[str, str] = {}
        for name, value in attrs:
            values.setdefault(name, value or "")
        listed = values.get("class")
        classes = frozenset(_SPACE_RUN.sub(" ", listed).split(" ")) - {""} if listed else _NO_CLASSES
        roles = self._roles(tag, classes, values)
        row = None
        if roles:
            row = {
                "seq": self.count,
                "last": self.count,
                "roles": roles,
                "attrs": [(k, values[k]) for k in KEPT_ATTRIBUTES if k in values],
                "markup": None,
                "span": (self.length, self.length),
            }
            self.rows.append(row)
        self.count += 1
        if tag in VOID_TAGS:
            return
        shown = roles and not self.markup_roles.isdisjoint(roles)
        markup_from = at + len(self.get_starttag_text()) if shown else None
        self.stack.append(_Open(tag, classes, row, self.length, markup_from))

    def _roles(self, tag: str, classes: frozenset, attrs: dict[str, str]) -> list[str]:
        roles: list[str] = []
        for key in (tag, "*", *("." + c for c in classes)):
            for role, steps in self.by_key.get(key, ()):
                leaf = steps[-1]
                if (
                    role not in roles
                    and leaf.fits(tag, classes)
                    and (not leaf.attribute or attrs.get(leaf.attribute) == leaf.value)
                    and self._below(steps)
                ):
                    roles.append(role)
        return roles

    def _below(self, steps: list[Step]) -> bool:
        """The open elements contain the leading steps in order; the nearest match is enough."""
        at = len(self.stack)
        for step in reversed(steps[:-1]):
            at -= 1
            while at >= 0 and not step.fits(self.stack[at].tag, self.stack[at].classes):
                at -= 1
            if at < 0:
                return False
        return True

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        # the closing slash has no meaning on elements that can have content
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth].tag == tag:
                self._close_down_to(depth, self._at())
                return

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        self.length += len(data)


def page_elements(
    html: str | None, by_key: dict, markup_roles: frozenset = frozenset()
) -> list[dict]:
    """The elements of one page that have a role, in document order."""
    return _Flattener(by_key, markup_roles).flatten(html) if html else []


def flatten_pages(
    pages: DataFrame, roles: dict[str, str], markup_roles: tuple[str, ...] = (), html: str = "html"
) -> DataFrame:
    """Replaces the ``html`` column by ``elements``; every other column passes through.

    ``roles`` names selectors of tags, classes and descendants; ``markup_roles`` those whose inner
    markup is kept too. A narrow Arrow pass: pages stay in their partitions, and Spark bounds the bytes
    of a batch (``spark.sql.execution.arrow.maxBytesPerBatch``).
    """
    passed = [c for c in pages.columns if c != html]
    shown = frozenset(markup_roles)

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key = compile_roles(roles)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(html))
            found = [page_elements(t.as_py(), by_key, shown) for t in texts]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in passed]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found, type=pa.list_(ELEMENT))], [*passed, "elements"]
            )

    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in passed)
    return pages.select(*passed, html).mapInArrow(flatten, f"{fields}, elements {ELEMENT_DDL}")


def having(elements: Column, role: str) -> Column:
    """Elements with a role, in document order."""
    return F.filter(elements, lambda e: F.array_contains(e["roles"], role))


def inside(elements: Column, outer: Column) -> Column:
    """Elements that lie below ``outer``."""
    return F.filter(elements, lambda e: (e["seq"] > outer["seq"]) & (e["seq"] <= outer["last"]))


def first(elements: Column) -> Column:
    return F.get(elements, F.lit(0))
