"""Boundary-aware term matching with one compiled pattern per vocabulary.

A term matches where no letter, digit, + or # touches it, nor a dot with a letter or digit beyond it; so "c" isn't found in "c++" and
"sql" isn't in "x.sql". Terms are compiled into a prefix trie whose optional tails are greedy: the longest term wins, with
backtracking to a shorter one where the right edge fails, and the regex engine tries one branch per letter instead of every term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The edges of a term, which decide what counts as a match.
LEFT = r"(?<![A-Za-z0-9+#])(?<![A-Za-z0-9]\.)"
RIGHT = r"(?![A-Za-z0-9+#])(?!\.[A-Za-z0-9])"


def _escape(ch: str) -> str:
    return ch if ch.isalnum() or ch == " " else "\\" + ch


def _trie(terms: Iterable[str]) -> str:
    root: dict = {}
    for term in terms:
        node = root
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node: dict) -> str:
        branches = [_escape(ch) + render(child) for ch, child in sorted(node.items()) if ch]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        if "" in node:
            return f"(?:{body})?"
        return body

    return render(root)


def compile_terms(terms: Iterable[str]) -> str:
    """The pattern of a vocabulary, for Spark as for Python; a vocabulary without terms matches nothing."""
    unique = sorted({t.lower() for t in terms if t})
    if not unique:
        return r"(?!)"
    return f"(?i){LEFT}(?:{_trie(unique)}){RIGHT}"


def has_term(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(pattern)


def all_terms(text: Column, pattern: str) -> Column:
    """Every match from left to right, lower-cased."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.transform(found, lambda m: F.lower(m))


def first_term(text: Column, pattern: str) -> Column:
    """The first match, lower-cased, or null."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 0)), F.lit(""))


def lookup(mapping: dict[str, str]) -> Column:
    """A literal map column."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body mentions it. An expression that a lambda mentions is computed anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, match>>: every match with its offset (from 0, in code points)."""

    def located(found: Column, parts: Column) -> Column:
        # One walk over the parts between matches carries the offset of the end so far.
        number = F.transform(found, lambda m, i: i)
        begin = lambda acc, i: acc["end"] + F.length(F.get(parts, i))
        step = lambda acc, i: F.struct((begin(acc, i) + F.length(F.get(found, i))).alias("end"), F.array_append(acc["starts"], begin(acc, i)).alias("starts"))
        none = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(number, none, step, lambda acc: acc["starts"])
        return F.zip_with(starts, found, lambda at, m: F.struct(at.alias("start"), m.alias("match")))

    nothing = F.array().cast("array<struct<start:int,match:string>>")
    some = lambda found: F.when(F.size(found) == 0, nothing).otherwise(let(F.split(text, pattern, -1), lambda parts: located(found, parts)))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)
