"""Small Arrow helpers for what needs an element tree or a recursive walk.

Each takes one payload to the few cards it holds; every field rule, de-duplication and
filter after that is a Spark expression.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))


class Element:
    __slots__ = ("attrs", "content", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.content: list[Element | str] = []

    def descendants(self) -> Iterator[Element | str]:
        pending = list(reversed(self.content))
        while pending:
            node = pending.pop()
            yield node
            if isinstance(node, Element):
                pending.extend(reversed(node.content))

    def elements(self, tag: str) -> Iterator[Element]:
        return (n for n in self.descendants() if isinstance(n, Element) and n.tag == tag)

    def strings(self) -> list[str]:
        return [s for n in self.descendants() if isinstance(n, str) and (s := n.strip())]

    def above(self, tag: str) -> Element | None:
        node = self.parent
        while node is not None and node.tag != tag:
            node = node.parent
        return node


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Element(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.content.append(node)
        if tag not in VOID:
            self.here = node

    def handle_endtag(self, tag: str) -> None:
        node = self.here if self.here.tag == tag else self.here.above(tag)
        if node is not None and node.parent is not None:
            self.here = node.parent

    def handle_data(self, data: str) -> None:
        content = self.here.content
        if self.here.tag in HIDDEN:
            return
        if content and isinstance(content[-1], str):
            content[-1] += data
        else:
            content.append(data)

    def handle_comment(self, data: str) -> None:
        self.here.content.append(Element("", {}, self.here))  # parts the text around it


def tree(page: str) -> Element:
    builder = _Tree()
    builder.feed(page)
    builder.close()
    return builder.root


_LINK = [T.StructField("href", T.StringType()), T.StructField("title", T.StringType())]
_LINES = T.StructField("lines", T.ArrayType(T.StringType()))


def _cards(fields: list[T.StructField], extract: Callable[[Element], list[tuple]]):
    @F.pandas_udf(T.ArrayType(T.StructType(fields)))
    def cards(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: extract(tree(p)) if p else [])

    return cards


def _anchors(root: Element) -> list[tuple]:
    return [
        (a.attrs["href"], "".join(a.strings())) for a in root.elements("a") if "href" in a.attrs
    ]


def _headings(root: Element) -> list[tuple]:
    """Link, text and surrounding strings of every linked second-level heading."""
    found = []
    for heading in root.elements("h2"):
        link = next(heading.elements("a"), None) or heading.above("a")
        if link is not None:
            box = heading.above("div") or heading.parent or heading
            found.append((link.attrs.get("href", ""), "".join(heading.strings()), box.strings()))
    return found


def _alerts(root: Element) -> list[tuple]:
    """Job links of an alert mail with the strings of the card around each."""
    found = []
    for link in root.elements("a"):
        if "/jobs/view/" in link.attrs.get("href", ""):
            box = link
            for _ in range(4):
                if box.parent is None or (box is not link and box.tag == "td"):
                    break
                box = box.parent
            title = "".join(n for n in link.descendants() if isinstance(n, str))
            found.append((link.attrs["href"], title, box.strings()))
    return found


anchors = _cards(_LINK, _anchors)
heading_cards = _cards([*_LINK, _LINES], _headings)
alert_cards = _cards([*_LINK, _LINES], _alerts)


# An object is a posting if it has a key of each set.
_POSTING_KEYS = (
    frozenset(("name", "title")),
    frozenset(("slug", "url", "link")),
    frozenset(("organization", "company_name", "office")),
)


def _postings_in(document) -> list[dict]:
    """Objects that look like a posting, in document order, at any depth."""
    found, pending = [], [document]
    while pending:
        value = pending.pop()
        if isinstance(value, dict):
            if all(not keys.isdisjoint(value) for keys in _POSTING_KEYS):
                found.append(value)
            value = list(value.values())
        if isinstance(value, list):
            pending += value[::-1]
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def hydration_hits(blobs: pd.Series) -> pd.Series:
    def one(blob: str | None) -> list[str]:
        try:
            return [json.dumps(hit, ensure_ascii=False) for hit in _postings_in(json.loads(blob or "null"))]
        except (ValueError, RecursionError):
            return []

    return blobs.map(one)
