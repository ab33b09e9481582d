"""The search query: optional predicates, all of which must hold, a sort, a page and the total."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_PAGE, MAX_PAGE = 25, 200

SORT_COLUMNS = {
    "posted_at": "posted_at",
    "first_seen_at": "first_seen_at",
    "last_seen_at": "last_seen_at",
    "title": "title",
    "company": "company",
    "experience": "experience_min",
}

LIST_COLUMNS = [
    "id", "source", "title", "company", "location", "experience_text", "experience_min", "experience_max", "salary_text", "salary_min", "salary_max",
    "skills", "category", "categories", "seniority", "work_mode", "apply_link", "posted_at", "first_seen_at", "last_seen_at", "is_active",
]
DETAIL_COLUMNS = [*LIST_COLUMNS, "description", "external_id", "expired_at", "expiry_reason", "last_checked_at"]


@dataclass(frozen=True)
class Filters:
    """Every field is optional; an empty one does not filter."""

    q: str | None = None
    source: list[str] = field(default_factory=list)
    category: list[str] = field(default_factory=list)
    seniority: list[str] = field(default_factory=list)
    work_mode: list[str] = field(default_factory=list)
    skill: list[str] = field(default_factory=list)
    location: str | None = None
    company: str | None = None
    min_experience: int | None = None
    max_experience: int | None = None
    include_unknown_experience: bool = True
    posted_within_days: int | None = None
    active_only: bool = True

    def __post_init__(self) -> None:
        for name in ("min_experience", "max_experience"):
            n = getattr(self, name)
            if n is not None and not 0 <= n <= 30:
                raise ValueError(f"{name} must be 0 to 30")
        if self.posted_within_days is not None and not 0 <= self.posted_within_days <= 365:
            raise ValueError("posted_within_days must be 0 to 365")


def predicates(f: Filters, as_of: Column) -> list[Column]:
    """One column per filter in use. Texts are literal, so % and _ mean themselves; unknown experience and dates pass unless asked otherwise."""
    out: list[Column] = []
    if f.active_only:
        out.append(F.col("is_active"))
    if f.q:
        q = f.q.strip().lower()
        out.append(F.col("search_blob").contains(q) | F.lower("description").contains(q))
    for name, low in (("source", True), ("category", False), ("seniority", True), ("work_mode", True)):
        if values := getattr(f, name):
            out.append(F.col(name).isin(*[x.lower() if low else x for x in values]))
    names = F.transform("skills", lambda s: F.lower(F.trim(s)))
    out += [F.array_contains(names, token.strip().lower()) for token in f.skill if token.strip()]
    for name in ("location", "company"):
        if text := getattr(f, name):
            out.append(F.lower(name).contains(text.lower()))

    def bound(c: str, good: Column) -> Column:
        return good | F.col(c).isNull() if f.include_unknown_experience else good

    if f.min_experience is not None:
        out.append(bound("experience_max", F.col("experience_max") >= f.min_experience))
    if f.max_experience is not None:
        out.append(bound("experience_min", F.col("experience_min") <= f.max_experience))
    if f.posted_within_days:
        cutoff = as_of - F.expr(f"INTERVAL '{f.posted_within_days}' DAY")
        out.append((F.col("posted_at") >= cutoff) | F.col("posted_at").isNull())
    return out


def needles(f: Filters) -> list[str]:
    """Texts that every match has inside a word of its search_blob or description: the parts between blanks of what contains() looks for.

    Location, company and skills are part of the blob, so their texts are too.
    """
    texts = [(f.q or "").strip().lower(), (f.location or "").lower(), (f.company or "").lower(), *(x.strip().lower() for x in f.skill)]
    return sorted({part for t in texts for part in t.split(" ") if part})


def matching(postings: DataFrame, f: Filters, as_of: Column) -> DataFrame:
    found = predicates(f, as_of)
    return postings.where(reduce(lambda a, b: a & b, found)) if found else postings


def ordering(sort: str = "posted_at", order: str = "desc") -> list[Column]:
    """Nulls come last going down and first going up; the greater id comes first where the sort ties."""
    if sort not in SORT_COLUMNS or order not in ("asc", "desc"):
        raise ValueError(f"cannot sort by {sort} {order}")
    c = F.col(SORT_COLUMNS[sort])
    return [c.desc_nulls_last() if order == "desc" else c.asc_nulls_first(), F.col("id").desc()]


def search(postings: DataFrame, f: Filters, as_of: Column, page: int = 1, size: int = DEFAULT_PAGE, sort: str = "posted_at", order: str = "desc") -> DataFrame:
    """The rows of one page, in order. The plan is a top-k by the page's end, not a sort of the table."""
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    size = min(size, MAX_PAGE)
    columns = [c for c in LIST_COLUMNS if c in postings.columns]
    rows = matching(postings, f, as_of).select(*columns, *([] if SORT_COLUMNS[sort] in columns else [SORT_COLUMNS[sort]]))
    return rows.orderBy(*ordering(sort, order)).limit(page * size).offset((page - 1) * size).select(*columns)


def total(postings: DataFrame, f: Filters, as_of: Column) -> DataFrame:
    return matching(postings, f, as_of).agg(F.count("*").alias("total"))


def page_meta(postings: DataFrame, f: Filters, as_of: Column, page: int = 1, size: int = DEFAULT_PAGE) -> DataFrame:
    """One row: page, page_size, total, total_pages, has_next, has_prev."""
    size = min(size, MAX_PAGE)
    pages = F.ceil(F.col("total") / size)
    return total(postings, f, as_of).select(
        F.lit(page).alias("page"), F.lit(size).alias("page_size"), "total", pages.cast("bigint").alias("total_pages"), (F.lit(page) < pages).alias("has_next"), F.lit(page > 1).alias("has_prev")
    )


def by_id(table: DataFrame, key: int) -> DataFrame:
    return table.where(F.col("id") == key)


def detail(postings: DataFrame, key: int) -> DataFrame:
    return by_id(postings, key).select(*[c for c in DETAIL_COLUMNS if c in postings.columns])


def added_since(postings: DataFrame, as_of: Column, days: int = 1) -> DataFrame:
    """How many rows were first seen in the last days, inactive ones included."""
    return postings.where(F.col("first_seen_at") >= as_of - F.expr(f"INTERVAL '{days}' DAY")).agg(F.count("*").alias("n"))


def n_pages(total_rows: int, size: int) -> int:
    return math.ceil(total_rows / size)
