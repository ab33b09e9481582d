"""Landed results of the two job boards as raw postings: search cards and detail pages in HTML, search results in JSON.

Nothing is fetched: files land elsewhere. Each function takes a DataFrame of documents and returns one of raw postings.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import parse, text
from sievelake.sources.html_text import Node, clean, html_to_text, read as read_html, small_batches

LINKEDIN, NAUKRI = "https://www.linkedin.com", "https://www.naukri.com"

RAW = "source string, external_id string, title string, company string, location string, experience_text string, salary_text string, apply_link string, description string, posted_at timestamp_ntz, declared_skills array<string>"

_CARD = "page_id string, nth int, urn string, title string, company string, location string, experience_text string, salary_text string, href string, description string, date_iso string, date_text string, tags array<string>"


def _text(node) -> str:
    return clean(node.text()) if node is not None else ""


def _first(*found):
    return next((x for x in found if x is not None), None)


def _linkedin_cards(root: Node) -> list[dict]:
    out = []
    for card in [n for n in root.find_all("div", "base-card")] or root.find_all("li"):
        title = card.find("h3", "base-search-card__title")
        link = card.find("a", "base-card__full-link") or next((a for a in card.find_all("a") if "/jobs/view/" in a.attrs.get("href", "")), None)
        if title is None or link is None:
            continue
        when = card.find("time")
        out.append(
            {
                "urn": card.attrs.get("data-entity-urn", ""),
                "title": _text(title),
                "company": _text(card.find("h4", "base-search-card__subtitle")),
                "location": _text(card.find("span", "job-search-card__location")),
                "href": link.attrs.get("href", ""),
                "date_iso": when.attrs.get("datetime") if when is not None else None,
                "date_text": _text(when),
            }
        )
    return out


def _naukri_cards(root: Node) -> list[dict]:
    inner = lambda card, outer: next((s for w in card.find_all("span", outer) for s in w.find_all("span")), None)
    out = []
    for card in root.find_all("div", "srp-jobtuple-wrapper") or root.find_all("article", "jobTuple"):
        title = card.find("a", "title")
        if title is None:
            continue
        tags = [clean(li.text()) for ul in card.find_all("ul", "tags-gt") for li in ul.find_all("li")]
        out.append(
            {
                "title": _text(title),
                "company": _text(_first(card.find("a", "comp-name"), card.find("span", "comp-name"))),
                "location": _text(_first(card.find("span", "locWdth"), inner(card, "loc-wrap"))),
                "experience_text": _text(_first(card.find("span", "expwdth"), inner(card, "exp-wrap"))),
                "salary_text": _text(_first(inner(card, "sal-wrap"), card.find("span", "sal"))),
                "href": title.attrs.get("href", ""),
                "description": _text(card.find("span", "job-desc")),
                "date_text": _text(card.find("span", "job-post-day")),
                "tags": [t for t in tags if t],
            }
        )
    return out


def _cards(pages: DataFrame, read) -> DataFrame:
    names = [c.split()[0] for c in _CARD.split(", ")]

    kinds = [pa.string() if n not in ("nth", "tags") else pa.int32() if n == "nth" else pa.list_(pa.string()) for n in names]
    blank = {n: "" for n in names} | {"tags": None, "date_iso": None}

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in names]
            for page_id, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, card in enumerate(read_html(page, read)):
                    for column, value in zip(out, ({**blank, **card, "page_id": page_id, "nth": k}).values()):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("string"), "html").mapInArrow(run, _CARD)


def linkedin_cards(pages: DataFrame, as_of: Column) -> DataFrame:
    """pages (page_id, html) -> raw postings with page_id and nth. A card needs a title and a link to a posting."""
    df = _cards(pages, _linkedin_cards)
    link = text.strip_tracking(text.absolute_url(F.col("href"), LINKEDIN))
    df = df.withColumn("apply_link", link).where(F.col("apply_link").contains("/jobs/view/"))
    from_urn = F.when(F.col("urn") != "", F.substring_index("urn", ":", -1))
    posted = F.coalesce(parse.iso_date(F.col("date_iso")), parse.relative_date(F.col("date_text"), as_of))
    return df.select(
        "page_id", "nth", F.lit("linkedin").alias("source"), F.coalesce(from_urn, text.id_from_link(F.col("apply_link"))).alias("external_id"), "title", "company", "location",
        F.lit("").alias("experience_text"), F.lit("").alias("salary_text"), "apply_link", F.lit("").alias("description"), posted.alias("posted_at"), F.array().cast("array<string>").alias("declared_skills"),
    )


def naukri_cards(pages: DataFrame, as_of: Column) -> DataFrame:
    """pages (page_id, html) -> raw postings with page_id and nth. A card needs a title that links."""
    df = _cards(pages, _naukri_cards)
    df = df.withColumn("apply_link", text.strip_tracking(text.absolute_url(F.col("href"), NAUKRI))).where("apply_link <> ''")
    return df.select(
        "page_id", "nth", F.lit("naukri").alias("source"), text.id_from_link(F.col("apply_link"), 8).alias("external_id"), "title", "company", "location", "experience_text", "salary_text",
        "apply_link", "description", parse.relative_date(F.col("date_text"), as_of).alias("posted_at"), F.coalesce("tags", F.array().cast("array<string>")).alias("declared_skills"),
    )


def linkedin_details(pages: DataFrame) -> DataFrame:
    """pages (external_id, html) of postings -> external_id, description, level, intern: what the search cards lack."""

    def detail(root: Node) -> tuple:
        body = _first(root.find("div", "show-more-less-html__markup"), root.find("div", "description__text"), root.find("section", "description"))
        level, intern = None, False
        for item in root.find_all("li", "description__job-criteria-item"):
            label = _text(item.find("h3", "description__job-criteria-subheader")).lower()
            value = _text(item.find("span", "description__job-criteria-text"))
            if value and "seniority" in label:
                level, intern = value, False
            elif value and "employment" in label and "intern" in value.lower():
                intern = True
        return clean(body.text(" "), 20_000) if body is not None else None, level, intern

    def run(batches):
        for b in batches:
            rows = [read_html(page, detail) for page in b.column(1).to_pylist()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["external_id", "description", "level", "intern"])

    small_batches(pages.sparkSession)
    return pages.select(F.col("external_id").cast("string"), "html").mapInArrow(run, "external_id string, description string, level string, intern boolean")


def attach_details(cards: DataFrame, details: DataFrame) -> DataFrame:
    """cards with the description and experience of their detail pages where there are any."""
    d = details.select("external_id", F.col("description").alias("_d"), F.col("level").alias("_l"), F.col("intern").alias("_i"))
    j = cards.join(d, "external_id", "left")
    level = F.coalesce("_l", "experience_text")
    level = F.when(F.coalesce("_i", F.lit(False)), F.trim(F.concat(level, F.lit(" Internship")))).otherwise(level)
    return j.withColumns({"description": F.coalesce("_d", "description"), "experience_text": level}).select(*cards.columns)


BOARD_JSON = """jobDetails array<struct<jobId string, title string, companyName string, jdURL string, staticUrl string,
  placeholders array<struct<type string, label string>>, createdDate string, footerPlaceholderLabel string, jobDescription string, tagsAndSkills string>>"""


def naukri_json(results: DataFrame, as_of: Column, json_col: str = "body") -> DataFrame:
    """results with a column of search results in JSON -> raw postings. An item needs title, company and link; the last placeholder of a type counts.

    Where descriptions hold markup, they are turned to text in Python; all else is built-in.
    """
    item = results.select(F.explode(F.from_json(json_col, F.lit(BOARD_JSON))["jobDetails"]).alias("i"))
    kind = lambda name: F.coalesce(F.try_element_at("places", F.lit(name)), F.lit(""))
    pairs = F.transform("i.placeholders", lambda p: F.struct(F.lower(F.coalesce(p["type"], F.lit(""))), text.clean_text(p["label"])))
    # Python's dict keeps the last of equal keys; so does this map, whatever the session's policy.
    keys = F.array_distinct(F.transform(pairs, lambda p: p["col1"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["col1"] == k), -1)["col2"]
    df = item.withColumn("places", F.map_from_arrays(keys, F.transform(keys, last)))
    link = text.strip_tracking(text.absolute_url(F.coalesce(F.nullif("i.jdURL", F.lit("")), "i.staticUrl"), NAUKRI))
    posted = F.coalesce(parse.epoch(F.col("i.createdDate")), parse.relative_date(F.col("i.footerPlaceholderLabel"), as_of))
    markup = F.coalesce("i.jobDescription", F.lit(""))
    df = df.select(
        F.lit("naukri").alias("source"), F.nullif("i.jobId", F.lit("")).alias("external_id"), text.clean_text(F.col("i.title")).alias("title"), text.clean_text(F.col("i.companyName")).alias("company"),
        kind("location").alias("location"), kind("experience").alias("experience_text"), kind("salary").alias("salary_text"), link.alias("apply_link"), html_to_text(markup).alias("description"),
        posted.alias("posted_at"), text.split_csv(F.col("i.tagsAndSkills")).alias("declared_skills"),
    )
    return df.where("title <> '' and company <> '' and apply_link <> ''")


SOURCES = {"linkedin": linkedin_cards, "naukri": naukri_cards}


def resolve_sources(requested: list[str] | None) -> list[str]:
    """The known ones among the requested, lower-cased; all if none is asked for; an error if none is known."""
    if not requested:
        return list(SOURCES)
    known = [s for s in (r.strip().lower() for r in requested) if s in SOURCES]
    if not known:
        raise ValueError(f"no known source in {requested}; known: {sorted(SOURCES)}")
    return known


def union_all(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL of the results of sources and queries."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def before_first_empty(pages: DataFrame, cards: DataFrame) -> DataFrame:
    """cards of each query's pages up to the first page without cards. pages: query, page, page_id; cards: page_id, ..."""
    n = cards.groupBy("page_id").agg(F.count("*").alias("_n"))
    counted = pages.select("query", "page", F.col("page_id").cast("string")).join(n, "page_id", "left")
    empty = counted.where("_n is null").groupBy("query").agg(F.min("page").alias("_stop"))
    good = counted.join(empty, "query", "left").where("_stop is null or page < _stop").select("page_id", "query", "page")
    return cards.join(good, "page_id")
