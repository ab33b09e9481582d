"""Main text of web pages as the maximum-scoring subsequence of their tags and words.

A page is a row of tokens. A word's weight is the sum of learned weights of where it stands: the tags around it, the words in their class, id and role, the depth,
the innermost block. A tag costs what its name has learned to cost. One linear scan finds the contiguous region of the greatest sum. Within that
region, an element whose words sum up to less than nothing, those of elements left out inside it not counted, is left out (adverts, forms and the like in an article).

All weights come from labelled pages: those of labelled_pages() or others. Nothing but them says which names mark what is no main text.
Elements that hold the page's first article or main element, or nearly all of its words where it has none, say nothing about the
words in them: a page may be wrapped in a form or in something named "sidebar".
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievelake.llm.shared import small_batches

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?:script|style|noscript|template|textarea|title)\b.*?(?:</(?:script|style|noscript|template|textarea|title)\s*>|\Z)"""
    r"""|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^'">]|"[^"]*"|'[^']*')*)>|[^<]+|<""",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Elements that end where another of their kind begins.
_CLOSED_BY_SELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
_ARTICLE = ("article", "main")
#: An element with more than this share of the words of a page without article or main says nothing about them.
_WIDE = 0.8
#: What a word may cost at most, so that a long advert doesn't part an article: it is left out anyway.
_FLOOR = -0.3


@dataclass
class Element:
    name: str
    names: list[str]
    parent: int
    words: int = 0
    outer: bool = False


@dataclass
class Page:
    """elements; tokens: (kind, element, text) in page order, kind being text, open, close or void; text only for text and for void tags' names."""

    elements: list[Element] = field(default_factory=list)
    tokens: list[tuple[str, int, str]] = field(default_factory=list)


def parse(source: str) -> Page:
    """Elements without their end tag end with the element around them; end tags without a beginning are ignored."""
    page = Page()
    elements, tokens = page.elements, page.tokens
    stack: list[int] = []
    open_names: Counter = Counter()

    def close() -> None:
        k = stack.pop()
        open_names[elements[k].name] -= 1
        if elements[k].parent >= 0:
            elements[elements[k].parent].words += elements[k].words
        tokens.append(("close", k, ""))

    total = 0
    for m in _TOKEN.finditer(source):
        whole, name = m[0], m[2]
        if name is None:
            if whole[0] != "<" or whole == "<":
                n = len(whole.split())
                total += n
                if stack:
                    elements[stack[-1]].words += n
                tokens.append(("text", stack[-1] if stack else -1, whole))
            continue
        name = name.lower()
        if m[1]:
            if open_names[name] > 0:
                while elements[stack[-1]].name != name:
                    close()
                close()
            continue
        if name in _VOID or m[3].endswith("/"):
            tokens.append(("void", stack[-1] if stack else -1, name))
            continue
        if stack and elements[stack[-1]].name == name and name in _CLOSED_BY_SELF:
            close()
        names = sorted({w for found in _NAMES.findall(m[3]) for w in _NAME.findall("".join(found).lower())}) if m[3] else []
        elements.append(Element(name, names, stack[-1] if stack else -1))
        stack.append(len(elements) - 1)
        open_names[name] += 1
        tokens.append(("open", stack[-1], ""))
    while stack:
        close()
    first = next((k for k, e in enumerate(elements) if e.name in _ARTICLE), None)
    if first is not None:
        while first >= 0:
            elements[first].outer = True
            first = elements[first].parent
    else:
        for e in elements:
            e.outer = e.name in ("html", "body") or e.words > _WIDE * total
    return page


def contexts(page: Page):
    """(number of the token, features as a sorted tuple, number of words) for each text with words, and the score's parts in page order."""
    stack: list[int] = []
    open_now: Counter = Counter()
    depth = 0
    known: tuple | None = None
    for k, (kind, e, text) in enumerate(page.tokens):
        if kind in ("open", "close"):
            element = page.elements[e]
            step = 1 if kind == "open" else -1
            stack.append(e) if kind == "open" else stack.pop()
            if not element.outer:
                for f in ("tag:" + element.name, *["name:" + w for w in element.names]):
                    open_now[f] += step
                depth += step * (element.name not in _INLINE)
            elif element.name in _ARTICLE:
                open_now["first article"] += step
            known = None
        elif kind == "text" and (n := len(text.split())):
            if known is None:
                block = next((page.elements[x].name for x in reversed(stack) if page.elements[x].name not in _INLINE), "none")
                now = [f for f, c in open_now.items() if c > 0]
                plain = not any(f.startswith("name:") for f in now)
                where = ["unnamed"] * plain + ["unnamed in article"] * (plain and "first article" in now)
                known = tuple(sorted([*now, *where, "in:" + block, f"depth:{min(depth, 5)}"]))
            yield k, known, n


def learn(pages: list[tuple[str, set[str]]], steps: int = 400) -> dict[str, float]:
    """Weights from (page, words of its main text): those of a word's features by logistic regression, those of tags by counting.

    A tag between the first and the last word of the main text counts as lying in it.
    """
    seen: dict[tuple, list[float]] = {}
    inside, outside = Counter(), Counter()
    for source, mine in pages:
        page = parse(source)
        hits = []
        for k, features, n in contexts(page):
            ours = len(mine.intersection(page.tokens[k][2].split()))
            got = seen.setdefault(features, [0.0, 0.0])
            got[0] += ours
            got[1] += n - ours
            hits += [k] if ours else []
        lo, hi = (hits[0], hits[-1]) if hits else (1, 0)
        for k, (kind, e, text) in enumerate(page.tokens):
            if kind != "text":
                (inside if lo <= k <= hi else outside)[text if kind == "void" else page.elements[e].name] += 1
    names = sorted({f for x in seen for f in x})
    at = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(seen), len(names) + 1))
    x[:, -1] = 1
    for row, features in enumerate(seen):
        x[row, [at[f] for f in features]] = 1
    # Rare surroundings count too: the weight of a context is the logarithm of its words.
    counts = np.array(list(seen.values()))
    y = counts[:, 0] / counts.sum(1)
    size = np.log1p(counts.sum(1))
    theta, mean, square = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-x @ theta))
        g = x.T @ (size * (p - y)) / size.sum() + 1e-4 * theta
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        theta -= 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
    weights = {f: float(w) for f, w in zip([*names, "bias"], theta)}
    for tag in inside.keys() | outside.keys():
        weights["cost:" + tag] = min(-0.02, max(-0.5, math.log((inside[tag] + 1) / (outside[tag] + 1))))
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """(begin, end) of the contiguous run with the greatest positive sum, the first of equal ones; (0, 0) if there is none."""
    best, best_at, total, begin = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, k
        total += s
        if total > best:
            best, best_at = total, (begin, k + 1)
    return best_at


def main_text(source: str | None, weights: dict[str, float]) -> str:
    """The main text of a page; empty if it has none."""
    page = parse(source or "")
    elements, tokens = page.elements, page.tokens
    scores = [0.0 if kind == "text" else weights.get("cost:" + (text if kind == "void" else elements[e].name), -0.1) for kind, e, text in tokens]
    worth = [0.0] * len(elements)
    cache: dict[tuple, float] = {}
    for k, features, n in contexts(page):
        w = cache.get(features)
        if w is None:
            w = cache[features] = max(-6.0, min(6.0, weights["bias"] + sum(weights.get(f, 0.0) for f in features)))
        scores[k] = n * max(_FLOOR, w)
        if (e := tokens[k][1]) >= 0:
            worth[e] += n * w
    left_out = [False] * len(elements)
    for e in range(len(elements) - 1, -1, -1):  # an element comes after the one around it
        x = elements[e]
        left_out[e] = worth[e] < 0 and not x.outer and x.name not in _INLINE
        if x.parent >= 0 and not left_out[e]:
            worth[x.parent] += worth[e]
    for e, x in enumerate(elements):
        left_out[e] |= x.parent >= 0 and left_out[x.parent]
    lo, hi = best_region(scores)
    blocks, block = [], []
    for kind, e, text in tokens[lo:hi]:
        if kind == "text":
            if e < 0 or not left_out[e]:
                block.append(html.unescape(text))
        elif (text if kind == "void" else elements[e].name) not in _INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    return " ".join(x for b in blocks if (x := " ".join(b.split())))


#: Names that the labelled pages give to what is no main text, and to parts of main text.
_BOXES = [
    "ad", "ads", "advert", "advertisement", "banner", "promo", "promotion", "sponsor", "sponsored", "cookie", "cookies", "consent", "notice", "alert", "disclaimer", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
    "toolbar", "pagination", "pager", "share", "sharing", "social", "login", "signup", "search", "copyright", "sidebar", "widget", "masthead", "breadcrumb", "breadcrumbs", "menu", "navbar", "navigation", "nav", "skip", "footer", "contentinfo", "complementary", "dialog",
]
_TALK = ["comments", "comment", "replies", "reply", "respond", "disqus"]
_LISTS = ["related", "recommended", "recommendations", "more"]
_PARTS = ["intro", "lead", "text", "body", "section", "chapter", "part", "results", "discussion", "work", "story", "post", "entry", "content", "price", "page", "wrapper", "container", "row"]


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, set[str]]]:
    """(page, words of its main text): invented pages of many layouts, a fixed set for a seed."""
    rng = random.Random(seed)
    serial = iter(range(10**9))
    maybe = lambda p: rng.random() < p

    def words(k: int, mine: set[str] | None = None) -> str:
        some = [f"w{next(serial)}" for _ in range(k)]
        if mine is not None:
            mine.update(some)
        return " ".join(some)

    def named(tag: str, names: list[str], inner: str) -> str:
        some = rng.sample(names, 1) + rng.sample(_PARTS, maybe(0.3))
        rng.shuffle(some)
        return f'<{tag} {rng.choice(["class", "id", "class"])}="{rng.choice([" ", "-", "_"]).join(some)}">{inner}</{tag}>'

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{x}">{words(rng.randint(1, 6))}</a></li>' for x in range(k)) + "</ul>"

    def prose(k: int) -> str:
        return "".join(f"<p>{words(rng.randint(3, 40))}</p>" for _ in range(k))

    def box() -> str:
        """What is no main text, wherever it stands."""
        inner = rng.choice([words(rng.randint(1, 30)), prose(rng.randint(1, 3)), links(rng.randint(1, 5)), f"<span>{words(4)}</span> <a href='/x'>{words(2)}</a>", f"<h3>{words(2)}</h3><p>{words(9)}</p>"])
        kind = rng.randrange(8)
        if kind < 4:
            return named(rng.choice(["div", "div", "section", "aside"]), _BOXES, inner)
        if kind == 4:
            return named(rng.choice(["div", "section", "ul"]), _LISTS, f"<h3>{words(2)}</h3>" + links(rng.randint(2, 6)))
        if kind == 5:
            return f"<form><label>{words(3)}</label><input><select><option>{words(1)}<option>{words(1)}</select><button>{words(1)}</button></form>"
        return f"<aside>{inner}</aside>" if kind == 6 else f"<button>{words(2)}</button>"

    def talk() -> str:
        each = [rng.choice([f"<p>{words(rng.randint(3, 40))}</p>", f"<article><p>{words(12)}</p></article>", f"<li><p>{words(9)}</p></li>", f"<div><span>{words(2)}</span><p>{words(20)}</p></div>"]) for _ in range(rng.randint(1, 6))]
        return named(rng.choice(["div", "section", "ol"]), _TALK, f"<h3>{words(2)}</h3>" * maybe(0.5) + "".join(each))

    def block(mine: set[str]) -> str:
        say = lambda k: words(k, mine)
        kind = rng.randrange(14)
        if kind < 5:
            return f"<p>{say(rng.randint(1, 70))}</p>"
        if kind == 5:
            return f'<p>{say(6)} <a href="/x">{say(2)}</a> {say(6)}</p>'
        if kind == 6:
            return f'<p><a href="/x">{say(rng.randint(3, 20))}</a></p>'
        if kind == 7:
            return f"<h2>{say(4)}</h2><p>{say(30)}</p>"
        if kind == 8:
            return rng.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{say(7)}</li>" if maybe(0.7) else f"<li><a href='/y'>{say(4)}</a></li>" for _ in range(3)))
        if kind == 9:
            return f"<p><b>{say(9)}</b><br>{say(8)}</p>"
        if kind == 10:
            return named(rng.choice(["section", "div"]), rng.choice([_PARTS, _PARTS, _LISTS]), f"<h2>{say(2)}</h2><p>{say(25)}</p><p>{say(25)}</p>")
        if kind == 11:
            return f"<blockquote><p>{say(12)}</p></blockquote><figure><figcaption>{say(5)}</figcaption></figure>"
        if kind == 12:
            return f"<table><tr><th>{say(1)}<td>{say(4)}<tr><th>{say(1)}<td>{say(3)}</table>"
        return f"<pre>{say(8)}</pre><h3>{say(3)}</h3><div>{say(20)}</div>"

    pages = []
    for _ in range(n):
        mine: set[str] = set()
        before, after = [], []
        if maybe(0.7):
            before.append(rng.choice([f"<nav>{links(6)}</nav>", f"<nav>{words(4)}</nav>", f"<nav><a href='/'>{words(1)}</a> {words(2)}</nav>", named("div", ["menu", "navbar", "nav", "navigation"], links(5)), f"<div>{links(5)}</div>"]))
        if maybe(0.5):
            before.append(f"<header><div>{words(2)}</div>{rng.choice([links(4), '<p>' + words(6) + '</p>', '<span>' + words(3) + '</span>'])}</header>")
        before += [box() for _ in range(rng.randint(0, 3))]
        after += [box() for _ in range(rng.randint(0, 3))]
        if maybe(0.5):
            after.append(talk())
        if maybe(0.7):
            after.append(rng.choice([f"<footer>{words(9)}</footer>", f"<footer><p>{words(12)}</p>{links(3)}</footer>", named("div", ["footer", "copyright"], words(8))]))
        rng.shuffle(before)
        title = f"<h1>{words(rng.randint(2, 9), mine)}</h1>"
        body = [rng.choice([title, title, f"<header>{title}</header>", ""])]
        for _ in range(rng.randint(2, 12)):
            body.append(block(mine))
            if maybe(0.12):
                body.append(box())
        tag = rng.choice(["article", "article", "main", "div class='content'", "div", "section class='post'"])
        made = "".join(before) + f"<{tag}>{''.join(body)}</{tag.split()[0]}>" + "".join(after)
        if maybe(0.3):
            made = named(rng.choice(["div", "form", "section", "div"]), _BOXES + _TALK + _PARTS, made)
        pages.append((f"<html><head><meta charset='utf-8'></head><body>{made}</body></html>", mine))
    return pages


_learned: list[dict[str, float]] = []


def default_weights() -> dict[str, float]:
    """Those of labelled_pages(), learned once for each process that asks."""
    if not _learned:
        _learned.append(learn(labelled_pages()))
    return _learned[0]


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text string, n_chars long) for every row; null or empty html gives an empty text. Other columns are ignored.

    Time is linear in the length of a page, however deep its elements lie. Repeated rows give repeated rows, an empty table gives none.
    """
    small_batches(pages.sparkSession)
    weights = weights or default_weights()  # some hundred numbers, learned on the driver and sent with the function
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [main_text(h, weights) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
