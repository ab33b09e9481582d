"""Boards whose result pages have landed as files, read page by page as a fetcher would.

A folder holds query=<text>/page=<number>/ with one file each. All queries go on side by side, one page number at a time; a query ends
before its first page without cards, and the files of later pages are not opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.operators.common import scratch_folder
from sievelake.sources import boards

REPORT = "source string, query string, page int, status string, cards long"


@dataclass(frozen=True)
class BoardSource:
    """A board: its name, what reads cards from pages (page_id, html), and how many pages a query has at most."""

    name: str
    read: Callable[[DataFrame, Column], DataFrame]
    pages: int

    def plan(self, queries: list[str]) -> int:
        """Units of work: pages that may be read."""
        return len(queries) * max(1, self.pages)

    def fetch(
        self, spark: SparkSession, root: str, queries: list[str], as_of: Column, cancelled: Callable[[], bool] = lambda: False, report: Callable[[int, str], None] = lambda done, message: None
    ) -> tuple[DataFrame, DataFrame]:
        """(raw postings with query and page, report): cards of each query's pages before the first one without any.

        The report has a row for each page that was opened: ok, empty, or malformed for one that is no UTF-8 text or breaks the reader, which ends
        the query as an empty page does; the pages before it stay, and so do all other queries. A query without files has no row, and a file of no bytes is like none. cancelled is
        asked before each page number; what was read by then is returned. Queries that are asked for twice are read once.
        """
        landed = listed(spark, root).where(F.col("query").isin(queries) & (F.col("page") <= self.pages))
        files = {(r.query, r.page): r.path for r in landed.collect()}  # the queries' pages, as many as plan() says
        at = scratch_folder(spark, f"pages-{self.name}")
        open_, opened, statuses = sorted(set(queries)), [], []
        for page in range(1, self.pages + 1):
            paths = {files[q, page]: q for q in open_ if (q, page) in files}
            if not paths or cancelled():
                break
            folder = f"{at}/{page}-{uuid.uuid4().hex}"
            counts = self._read_page(spark, list(paths), page, as_of, folder)
            opened.append(folder)
            open_ = []
            for q, good, n in counts:
                status = "malformed" if not good else "ok" if n else "empty"
                statuses.append((self.name, q, page, status, n))
                open_ += [q] if status == "ok" else []
                report(1, f"{self.name} '{q}' page {page}: {status}")
        none = self.read(spark.createDataFrame([], "page_id string, html string"), as_of)
        none = none.withColumns({"query": F.lit(None).cast("string"), "page": F.lit(None).cast("int")})
        raw = spark.read.schema(none.schema).parquet(*opened) if opened else none
        return raw, spark.createDataFrame(statuses, REPORT)

    def _read_page(self, spark: SparkSession, paths: list[str], page: int, as_of: Column, folder: str) -> list[tuple[str, bool, int]]:
        """Read one page of each open query and write its cards; (query, whether it is text, cards) by query."""
        files = spark.read.format("binaryFile").load(paths).select(_query_of(F.col("path")).alias("query"), F.col("content").alias("bytes"))
        texts = files.select("query", F.expr("is_valid_utf8(cast(bytes as string))").alias("good"), F.col("bytes").cast("string").alias("html"))
        pages = texts.select(F.col("query").alias("page_id"), F.when(F.col("good"), F.col("html")).otherwise("").alias("html"))
        cards = self.read(pages, as_of).withColumns({"query": F.col("page_id"), "page": F.lit(page)})
        cards.write.parquet(folder)
        n = spark.read.schema(cards.schema).parquet(folder).groupBy("query").agg(F.count("*").alias("n"))
        found = texts.groupBy("query").agg(F.bool_and("good").alias("good")).join(n, "query", "left")
        return sorted((r.query, r.good, r.n or 0) for r in found.collect())


def _query_of(path: Column) -> Column:
    return F.url_decode(F.regexp_replace(F.regexp_extract(path, "/query=([^/]*)/", 1), "[+]", "%2B"))


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(query, page, path) of the landed pages; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!._]*").load(root).select("path")
    page = F.regexp_extract("path", "/page=(\\d+)/", 1)
    return files.select(_query_of(F.col("path")).alias("query"), page.cast("int").alias("page"), "path").where(page != "").groupBy("query", "page").agg(F.min("path").alias("path"))


#: How many pages of a search the boards are asked for.
SOURCES = {"linkedin": BoardSource("linkedin", boards.linkedin_cards, 4), "naukri": BoardSource("naukri", boards.naukri_cards, 3)}


def fetch_all(spark: SparkSession, roots: dict[str, str], queries: list[str], as_of: Column, sources: dict[str, BoardSource] = SOURCES, cancelled: Callable[[], bool] = lambda: False) -> tuple[DataFrame, DataFrame]:
    """(raw, report) of all sources in roots, one after the other. A source whose folder can't be read is left out, with a row that says failed."""
    parts, reports = [], []
    for name, root in roots.items():
        try:
            raw, report = sources[name].fetch(spark, root, queries, as_of, cancelled)
            parts.append(raw)
        except Exception as e:  # one board's failure must not lose the others' postings
            report = spark.createDataFrame([(name, None, None, f"failed: {type(e).__name__}", 0)], REPORT)
        reports.append(report)
    if not parts:
        raise ValueError("no source could be read")
    return boards.union_all(parts), boards.union_all(reports)
