"""One run from raw postings to the store: classify, reject, collapse, apply a profile, merge, keep house."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sievelake.functions.vocab import DEFAULT, Vocabulary
from sievelake.operators import ingest, lifecycle, profiles
from sievelake.operators.common import metrics, where_after
from sievelake.operators.ingest import IngestRules
from sievelake.sources.markers import Lease
from sievelake.sources.store import Store


def tag_of(run_id: int) -> str:
    return f"run-{run_id}"


@contextmanager
def jobs_of(spark: SparkSession, run_id: int) -> Iterator[None]:
    """Every job that this thread starts inside belongs to the run, so that cancel() finds it."""
    spark.sparkContext.addJobTag(tag_of(run_id))
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag_of(run_id))


def cancel(spark: SparkSession, run_id: int) -> None:
    """Stop the run's jobs at once; what it has committed stays, and what it was writing is part of no version. For a stop between batches see streaming."""
    spark.sparkContext.cancelJobsWithTag(tag_of(run_id))


class Busy(RuntimeError):
    """Another run is going on."""


def run_once(
    store: Store, raw: DataFrame, now: Column, clock: float, empty: DataFrame, rules: IngestRules = IngestRules(), v: Vocabulary = DEFAULT, profile: profiles.Profile | None = None, cancelled: bool = False
) -> dict:
    """The stats of the run: jobs_seen, jobs_kept, jobs_new, jobs_updated, jobs_rejected and rejections by reason, a profile's included.

    One run holds the store's lease at a time; clock is the time in seconds that it counts from. The counts are taken by the job that computes the
    rows, so raw is read once. cancelled: raw is what was collected before the run was stopped; it is stored, but housekeeping is left out, as it is
    after a profile's run.
    """
    lease = Lease(store.markers)
    held = lease.acquire(clock)
    if held is None:
        raise Busy("another run holds the store")
    try:
        marked, seen = ingest.observed(ingest.classify(raw, now, rules, v))
        rows, by_profile = ingest.dedup_richest(ingest.kept(marked)), None
        if profile is not None:
            by_profile = Observation("profile")
            judged = profiles.apply_profile(rows, profile)
            is_ = lambda r: F.count_if(F.coalesce(F.col("profile_reason") == r, F.lit(False)))
            judged = judged.observe(by_profile, *[is_(r).alias(r) for r in profiles.REASONS])
            rows = where_after(judged, F.col("profile_reason").isNull())
        done = store.upsert(rows.select(*ingest.PAYLOAD), now, lease=held, empty=empty)
        if not cancelled and profile is None:
            store.rewrite(lambda p: lifecycle.housekeeping(p, now), lease=held)
        rejections = ingest.observed_rejections(seen)
        if by_profile is not None:
            rejections |= {r: n for r, n in metrics(by_profile).items() if n}
        kept = done.tallies["created"] + done.tallies["updated"]
        return {"jobs_seen": metrics(seen).get("seen", 0), "jobs_kept": kept, "jobs_new": done.tallies["created"], "jobs_updated": done.tallies["updated"], "jobs_rejected": sum(rejections.values()), "rejections": rejections}
    finally:
        lease.release(held)
