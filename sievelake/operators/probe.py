"""Probes of stored postings: which to check, where to ask, and what an answer means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import taxonomy

LIMIT, RECHECK_HOURS, MIN_LIVE_CHARS, PROBE_CHARS = 250, 24, 400, 8000
POSTING_MARKS = ["/jobs/view/", "/job-listings-", "/jobs-guest/", "/job/"]


def due(p: DataFrame, now: Column, limit: int | None = LIMIT, hours: int = RECHECK_HOURS) -> DataFrame:
    """Active rows never checked or not since so many hours, the longest unchecked first; at most limit, the batch size of a pass."""
    old = F.col("last_checked_at").isNull() | (F.col("last_checked_at") < now - F.expr(f"INTERVAL '{hours}' HOUR"))
    rows = p.where(F.col("is_active") & old).orderBy(F.col("last_checked_at").asc_nulls_first(), F.col("id").asc())
    return rows.limit(limit) if limit else rows


def probe_url(source: Column, external_id: Column, apply_link: Column, api: str) -> Column:
    guest = (source == "linkedin") & (F.coalesce(external_id, F.lit("")) != "")
    return F.when(guest, F.concat(F.lit(api.rstrip("/") + "/"), external_id)).otherwise(apply_link)


def redirected_away(final_url: Column, url: Column) -> Column:
    """Whether a posting's address led to one that is none; a trailing slash makes no difference."""
    bare = lambda u: F.regexp_replace(F.coalesce(u, F.lit("")), "/+$", "")
    posting = lambda u: F.coalesce(u, F.lit("")).rlike("|".join(POSTING_MARKS))
    return (bare(final_url) != bare(url)) & posting(url) & ~posting(final_url)


def classify(status: Column, final_url: Column, url: Column, text: Column) -> Column:
    """struct(verdict, reason) of an answer; text is the page's text. Refusals say nothing about the posting."""
    out = lambda verdict, reason: F.struct(F.lit(verdict).alias("verdict"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    body = F.substring(F.coalesce(text, F.lit("")), 1, PROBE_CHARS)
    return (
        F.when(status.isNull(), out("unknown", "no_response"))
        .when(status.isin(404, 410), out("gone", "http_gone"))
        .when(status >= 400, out("unknown", F.concat(F.lit("http_"), status.cast("string"))))
        .when(redirected_away(final_url, url), out("gone", "redirected_away"))
        .when(taxonomy.looks_dead(body), out("gone", "dead_page"))
        .when(F.length(body) < MIN_LIVE_CHARS, out("unknown", "thin_page"))
        .otherwise(out("alive", "ok"))
    )


def reasons(results: DataFrame) -> DataFrame:
    return results.groupBy("verdict", "reason").agg(F.count("*").alias("n"))
