"""Commands over a store of postings: python -m sievelake.cli COMMAND."""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sievelake import config
from sievelake.operators import ingest, lifecycle, search
from sievelake.operators.common import metrics
from sievelake.session import get_session
from sievelake.sources import jsonl
from sievelake.sources.store import Store

STORED = (
    "id long, fingerprint string, source string, external_id string, apply_link string, title string, company string, location string, description string, "
    "experience_text string, experience_min int, experience_max int, salary_text string, salary_min double, salary_max double, skills array<string>, category string, "
    "categories array<string>, seniority string, work_mode string, posted_at timestamp_ntz, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, is_active boolean, "
    "expired_at timestamp_ntz, expiry_reason string, last_checked_at timestamp_ntz, check_failures int, search_blob string"
)


def current(spark: SparkSession, store: Store) -> DataFrame:
    return store.read().select(*spark.createDataFrame([], STORED).columns) if store.exists() else spark.createDataFrame([], STORED)


def import_jsonl(spark: SparkSession, store: Store, path: str, now, settings: config.Settings) -> dict:
    """Read, classify, deduplicate and upsert a file of records; the counts of what happened, taken by the job that writes."""
    records = jsonl.read(spark, path)
    raw = jsonl.to_raw(records).withColumn("raw_id", F.monotonically_increasing_id())  # the order within and among files
    marked, seen = ingest.observed(ingest.classify(raw, now, settings.rules))
    done = store.upsert(ingest.dedup_richest(ingest.kept(marked)), now, empty=spark.createDataFrame([], STORED))
    return {**jsonl.malformed(records).first().asDict(), **done.tallies, "rejections": ingest.observed_rejections(seen)}


def maintain(spark: SparkSession, store: Store, now, settings: config.Settings) -> dict:
    """Stale, aged out, purged: one pass over the store."""

    def change(p: DataFrame) -> DataFrame:
        after = lifecycle.expire_aged_out(lifecycle.deactivate_stale(p, now, settings.stale_days), now, settings.age_out_days)
        return lifecycle.purge_expired(lifecycle.purge_old(after, now, settings.purge_days), now, settings.purge_expired_days)

    store.rewrite(change)
    return store.stats(now).select("total", "active").first().asDict()


def reindex(spark: SparkSession, store: Store, now, settings: config.Settings) -> dict:
    """Classify all stored rows anew."""
    tallies = Observation("reindex")

    def change(p: DataFrame) -> DataFrame:
        return lifecycle.reindex(p, now, settings.rules).observe(tallies, *lifecycle.reindex_counts())

    store.rewrite(change)
    return metrics(tallies)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sievelake")
    parser.add_argument("--store", help="folder of the store")
    parser.add_argument("--as-of", help="the time to take for now, in ISO format; default: the clock")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("import", "export"):
        sub.add_parser(name).add_argument("path")
    for name in ("maintain", "reindex", "stats"):
        sub.add_parser(name)
    s = sub.add_parser("search")
    s.add_argument("q", nargs="?")
    for name in ("source", "category", "seniority", "work-mode", "skill"):
        s.add_argument(f"--{name}", action="append", default=[])
    s.add_argument("--location")
    s.add_argument("--company")
    for name in ("min-experience", "max-experience", "posted-within-days"):
        s.add_argument(f"--{name}", type=int)
    s.add_argument("--page", type=int, default=1)
    s.add_argument("--size", type=int, default=search.DEFAULT_PAGE)
    s.add_argument("--sort", default="posted_at", choices=sorted(search.SORT_COLUMNS))
    s.add_argument("--order", default="desc", choices=("asc", "desc"))
    a = parser.parse_args(argv)

    settings = config.load()
    spark = get_session()
    store = Store(spark, a.store or settings.store)
    at = datetime.fromisoformat(a.as_of) if a.as_of else datetime.now(timezone.utc).replace(tzinfo=None)
    now = F.lit(at.isoformat(" ")).cast("timestamp_ntz")
    if a.command == "import":
        print(import_jsonl(spark, store, a.path, now, settings))
    elif a.command == "export":
        jsonl.export(current(spark, store), a.path)
    elif a.command == "maintain":
        print(maintain(spark, store, now, settings))
    elif a.command == "reindex":
        print(reindex(spark, store, now, settings))
    elif a.command == "stats":
        print(store.stats(now).first().asDict())
        store.facets().orderBy("facet", F.desc("n"), "value").show(60, truncate=False)
    else:
        f = search.Filters(a.q, a.source, a.category, a.seniority, a.work_mode, a.skill, a.location, a.company, a.min_experience, a.max_experience, True, a.posted_within_days)
        p = store.searched(f)
        print(search.page_meta(p, f, now, a.page, a.size).first().asDict())
        search.search(p, f, now, a.page, a.size, a.sort, a.order).select("id", "title", "company", "location", "experience_min", "posted_at").show(a.size, truncate=40)


if __name__ == "__main__":
    main()
