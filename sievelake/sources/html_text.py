"""HTML in Python's own parser: plain text, and a small tree for reading cards."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from operator import attrgetter
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import pandas_udf

T = TypeVar("T")

_SKIP = {"script", "style", "noscript"}
#: Elements whose text is no markup, or not for every parser.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    """An element: name, attributes, children (nodes and strings).

    Elements are numbered in document order; those below one have the numbers after its own up to end. A tree's index has the elements of each name and
    class, so a card's fields are found without walking over the page again for each.
    """

    __slots__ = ("attrs", "children", "end", "index", "name", "number")

    def __init__(self, name: str, attrs: dict[str, str], number: int, index: dict):
        self.name, self.attrs, self.children = name, attrs, []
        self.number, self.end, self.index = number, number + 1, index

    def _found(self, name: str | None, cls: str | None) -> list["Node"]:
        found = self.index.get((name, cls), ())
        if name is None and not found:
            found = sorted((n for (tag, c), nodes in self.index.items() if tag is not None and c == cls for n in nodes), key=_number)
            self.index[name, cls] = found
        return found

    def find_all(self, name: str | None = None, cls: str | None = None) -> list["Node"]:
        """All below this one with that name and class, in document order."""
        nodes = self._found(name, cls)
        return list(nodes[bisect_right(nodes, self.number, key=_number) : bisect_left(nodes, self.end, key=_number)])

    def find(self, name: str | None = None, cls: str | None = None) -> "Node | None":
        nodes = self._found(name, cls)
        at = bisect_right(nodes, self.number, key=_number) if nodes else 0
        return nodes[at] if at < len(nodes) and nodes[at].number < self.end else None

    def text(self, joiner: str = "") -> str:
        if not joiner and len(self.children) == 1 and isinstance(self.children[0], str) and self.name not in _SKIP:
            return self.children[0]
        parts, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                parts.append(node.strip() if joiner else node)
            elif node.name not in _SKIP:
                todo += reversed(node.children)
        return joiner.join(p for p in parts if p)


_number = attrgetter("number")
_NONE: tuple = ({}, ())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.index: dict = defaultdict(list)
        self.root = Node("", {}, 0, self.index)
        self.open, self.count = [self.root], 1

    def _add(self, tag, attrs) -> Node:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.count, self.index)
        self.count += 1
        self.open[-1].children.append(node)
        self.index[tag, None].append(node)
        if names := node.attrs.get("class"):
            for cls in set(names.split()):
                self.index[tag, cls].append(node)
        return node

    def handle_starttag(self, tag, attrs):
        node = self._add(tag, attrs)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                self._close(k)
                break

    def _close(self, k: int) -> None:
        for node in self.open[k:]:
            node.end = self.count
        del self.open[k:]

    def handle_data(self, data):
        self.open[-1].children.append(data)


# Markup that any parser reads alike, as (whole, end tag, start tag, attributes, slash), with attributes in double quotes and plain comments.
_ATTRIBUTES = re.compile(r'[ \t\n]+([a-zA-Z][-\w:.]*)(?:="([^"]*)")?', re.ASCII)
_PLAIN = re.compile(
    r'([^<]+|</([a-zA-Z][a-zA-Z0-9]*)>|<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][-\w:.]*(?:="[^"]*")?)*)[ \t\n]*(/?)>|<!--[^-<>]*-->)', re.ASCII
)


@lru_cache(1024)
def _attributes(text: str) -> tuple[dict[str, str], set[str]]:
    """The attributes of a tag and the classes among them; most tags of a site are alike. Nobody changes a node's attributes."""
    attrs = {k.lower(): unescape(v) if "&" in v else v for k, v in _ATTRIBUTES.findall(text)}
    return attrs, set(attrs.get("class", "").split())


def _plain(page: str) -> Node | None:
    """The tree of a page of plain markup alone, without the parser's many steps for each tag; None where a page has anything else."""
    pieces = _PLAIN.findall(page)
    if sum([len(p[0]) for p in pieces]) != len(page):
        return None
    index: dict = defaultdict(list)
    root = Node("", {}, 0, index)
    open_, children, count = [root], root.children, 1
    for whole, end, tag, attributes, slash in pieces:
        if tag:
            tag = tag.lower()
            if tag in _RAW:
                return None
            attrs, classes = _attributes(attributes) if attributes else _NONE
            node = Node(tag, attrs, count, index)
            count += 1
            children.append(node)
            index[tag, None].append(node)
            for cls in classes:
                index[tag, cls].append(node)
            if not slash and tag not in _VOID:
                open_.append(node)
                children = node.children
        elif end:
            end = end.lower()
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].name == end:
                    for node in open_[k:]:
                        node.end = count
                    del open_[k:]
                    children = open_[-1].children
                    break
        elif whole[0] != "<":
            children.append(unescape(whole) if "&" in whole else whole)
    for node in open_:
        node.end = count
    return root


def parse(page: str | None) -> Node:
    root = _plain(page or "")
    if root is not None:
        return root
    tree = _Tree()
    tree.feed(page)
    tree.close()
    tree._close(0)
    return tree.root


def read(page: str | None, how: Callable[[Node], T]) -> T:
    """how(tree of page). The tree goes right after: its index is a circle that would lie about until the collector comes."""
    root = parse(page)
    out = how(root)
    root.index.clear()
    return out


def clean(value: str | None, limit: int | None = None) -> str:
    out = " ".join((value or "").split())
    return out[:limit] if limit else out


def to_text(page: str | None, limit: int = 20_000) -> str:
    """The text without markup, scripts and styles, its pieces parted by spaces; a text without < is only cleaned."""
    if not page:
        return ""
    return clean(page if "<" not in page else read(page, lambda root: root.text(" ")), limit)


#: Pages handed to Python at once: a worker holds so many and their texts, whatever the size of the table.
BATCH_PAGES = 256


def small_batches(spark: SparkSession) -> None:
    """Keep batches at BATCH_PAGES in this session; smaller ones stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_PAGES:
        spark.conf.set(key, str(BATCH_PAGES))


def html_to_text(page: Column, limit: int = 20_000) -> Column:
    small_batches(SparkSession.active())

    @pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: to_text(p, limit))

    return run(page)
