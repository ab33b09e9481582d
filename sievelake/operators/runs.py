"""The run ledger and the event log."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.text import python_slice

REPLAY, RUNS_KEPT, ORPHAN_MINUTES, ERROR_CHARS = 800, 10, 90, 4000


def progress(done: Column, total: Column) -> Column:
    """Percent with one decimal, half up; 0 for a run without work."""
    return F.when(total == 0, 0.0).otherwise(F.round(F.least(done / total, F.lit(1.0)) * 100, 1))


def duration(started: Column, finished: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.round((micros(finished) - micros(started)) / 1e6, 2)


def latest(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(n)


def active(runs: DataFrame) -> DataFrame:
    """The newest running run, if any."""
    return latest(runs.where(F.col("status") == "running"), 1)


def may_start(runs: DataFrame) -> bool:
    """Whether no run is going on."""
    return runs.where(F.col("status") == "running").limit(1).isEmpty()


#: What finish() takes from a run's stats, where they have it.
COUNTERS = ["jobs_seen", "jobs_new", "jobs_updated", "jobs_rejected"]


def create(runs: DataFrame, sources: list[str], trigger: str, now: Column, stats: dict | None = None) -> DataFrame:
    """runs plus a new running one; stats, kept as JSON, holds what is known already, so that a running run tells what it is. Columns it does not set are null."""
    new = runs.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select(
        "id", F.lit("running").alias("status"), F.lit(trigger).alias("trigger"), F.array(*[F.lit(s) for s in sources]).alias("sources"), F.lit(0).alias("queries_total"), F.lit(0).alias("queries_done"), now.alias("started_at")
    )
    if "stats" in runs.columns:
        new = new.withColumn("stats", F.lit(json.dumps(stats or {})))
    for c in COUNTERS:
        if c in runs.columns:
            new = new.withColumn(c, F.lit(0))
    return runs.unionByName(new, allowMissingColumns=True)


def finish(runs: DataFrame, run_id: int, status: str, now: Column, error: str | None = None, stats: dict | None = None) -> DataFrame:
    """runs with one ended: its duration, its error cut to ERROR_CHARS, and, if stats are given, those and each counter that they have."""
    mine = F.col("id") == run_id
    runs = runs.withColumn("duration_seconds", F.when(mine, duration(F.col("started_at"), now)).otherwise(F.col("duration_seconds")))
    new = {"status": F.lit(status), "finished_at": now}
    if error:
        new["error"] = python_slice(F.lit(error), ERROR_CHARS)
    if stats:
        new |= {c: F.lit(int(stats[c])) for c in COUNTERS if c in stats and c in runs.columns}
        if "stats" in runs.columns:
            new["stats"] = F.lit(json.dumps(stats))
    return runs.withColumns({c: F.when(mine, v.cast(runs.schema[c].dataType)).otherwise(F.col(c)) for c, v in new.items()})


def reap(runs: DataFrame, now: Column, minutes: int | None = ORPHAN_MINUTES) -> DataFrame:
    """Running runs older than so many minutes fail; None means all."""
    old = F.col("status") == "running"
    if minutes is not None:
        old = old & (F.col("started_at") < now - F.expr(f"INTERVAL '{minutes}' MINUTE"))
    return runs.withColumns({"finished_at": F.when(old, now).otherwise(F.col("finished_at")), "status": F.when(old, "failed").otherwise(F.col("status"))})


def replay(events: DataFrame, last: int = REPLAY) -> DataFrame:
    """The last events of each run, for a new subscriber."""
    w = Window.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= last).drop("_nth")


def prune(events: DataFrame, runs: DataFrame, kept: int = RUNS_KEPT) -> DataFrame:
    """Events without those of finished runs other than the newest few."""
    done = runs.where(F.col("status") != "running").select(F.col("id").alias("run_id"))
    stay = done.orderBy(F.desc("run_id")).limit(kept)  # so few ids
    drop = done.join(F.broadcast(stay), "run_id", "left_anti")
    return events.join(drop, "run_id", "left_anti")


def event_progress(events: DataFrame) -> DataFrame:
    """run_id, done, total so far."""
    return events.groupBy("run_id").agg(F.max("done").alias("done"), F.max("total").alias("total"))


def failure_streaks(probes: DataFrame) -> DataFrame:
    """Over a history of probes (id, ts, verdict): the failures in a row up to each, an alive or gone probe starting anew."""
    order = Window.partitionBy("id").orderBy("ts")
    reset = F.sum((F.col("verdict") != "unknown").cast("int")).over(order)
    again = Window.partitionBy("id", "_reset").orderBy("ts")
    return probes.withColumn("_reset", reset).withColumn("streak", F.sum((F.col("verdict") == "unknown").cast("int")).over(again)).drop("_reset")
