"""Text cleaning, links, slugs, fingerprints and the search blob, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(value: Column, limit: int | None = None) -> Column:
    """Null becomes empty, runs of any Unicode white space one space, ends are trimmed, then the first limit code points."""
    out = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "))
    return F.substring(out, 1, limit) if limit else out


def strip_tracking(url: Column) -> Column:
    return F.substring_index(F.coalesce(url, F.lit("")), "?", 1)


def absolute_url(href: Column, base: str) -> Column:
    h = F.trim(F.coalesce(href, F.lit("")))
    root = base.rstrip("/")
    return (
        F.when(F.coalesce(href, F.lit("")) == "", "")
        .when(h.startswith("http://") | h.startswith("https://"), h)
        .when(h.startswith("//"), F.concat(F.lit("https:"), h))
        .when(h.startswith("/"), F.concat(F.lit(root), h))
        .otherwise(F.concat(F.lit(root + "/"), h))
    )


def split_csv(value: Column) -> Column:
    """Parts between commas, bars and slashes, cleaned; blanks dropped."""
    parts = F.split(F.coalesce(value, F.lit("")), r"[,|/]")
    return F.filter(F.transform(parts, lambda p: clean_text(p)), lambda p: p != "")


def id_from_link(link: Column, least: int = 1) -> Column:
    """The digits after the last dash (the whole link if there is none), if that is all digits and long enough; else null."""
    tail = F.substring_index(F.regexp_replace(F.coalesce(link, F.lit("")), "/+$", ""), "-", -1)
    return F.when(tail.rlike(f"^[0-9]{{{least},}}$"), tail)


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def seo_key(query: Column, city: str = "") -> Column:
    key = F.concat(slug(query), F.lit("-jobs"))
    return F.concat(key, F.lit("-in-"), slug(F.lit(city))) if city else key


def search_url(base: str, query: Column, page: Column, city: str = "") -> Column:
    url = F.concat(F.lit(base.rstrip("/") + "/"), seo_key(query, city))
    return F.when(page <= 1, url).otherwise(F.concat(url, F.lit("-"), page.cast("string")))


def _norm(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", " "))


def fingerprint(title: Column, company: Column, location: Column) -> Column:
    """SHA-1 of the normalised title, company and first word of the location."""
    first = F.substring_index(_norm(location), " ", 1)
    return F.sha1(F.concat_ws("|", _norm(title), _norm(company), first))


def skills_fence(skills: Column) -> Column:
    """|a|b| of the trimmed lower-case skills, blanks dropped; empty for none."""
    names = F.filter(F.transform(F.coalesce(skills, F.array().cast("array<string>")), lambda s: F.lower(F.trim(s))), lambda s: s != "")
    return F.when(F.size(names) == 0, "").otherwise(F.concat(F.lit("|"), F.array_join(names, "|"), F.lit("|")))


def search_blob(title: Column, company: Column, location: Column, category: Column, skills: Column) -> Column:
    parts = [title, company, location, category, skills_fence(skills)]
    return F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def title_case(value: Column) -> Column:
    """Python's str.title(): a capital at the start of each run of letters."""
    runs = F.regexp_extract_all(value, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def python_slice(value: Column, n: int) -> Column:
    return F.substring(F.coalesce(value, F.lit("")), 1, n)
