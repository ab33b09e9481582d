"""Facet counts and summary statistics over the active postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _label(column: str, unknown: str = "Unknown"):
    return F.when(F.col(column).isNull() | (F.col(column) == ""), unknown).otherwise(F.col(column))


def facet(postings: DataFrame, column: str, limit: int = 50) -> DataFrame:
    """value, n: the most frequent values of a column, greatest count first, then by value.

    Null and empty are two groups, as they are counted before they are named; both are called Unknown.
    """
    counted = postings.where("is_active").groupBy(column).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), F.col(column).asc_nulls_first()).limit(limit).select(_label(column).alias("value"), "n")


def skill_facet(postings: DataFrame, limit: int = 60) -> DataFrame:
    """value, n over the elements of skills."""
    each = postings.where("is_active").select(F.explode("skills").alias("value"))
    return each.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


#: How many values of a facet are shown.
FACET_LIMITS = {"source": 50, "category": 50, "seniority": 50, "work_mode": 50, "location": 40, "company": 40}


SKILL_LIMIT = 60

#: What a posting counts for: a facet and a value. Names that begin with = are no facets for the reader but what stats() sums up.
ENTRIES = "array<struct<facet: string, value: string>>"


def entries(postings: DataFrame, of: str = "") -> Column:
    """Everything that a row counts for, as ENTRIES; of: a prefix of the columns' names."""
    have = {c: F.col(f"{of}{c}") for c in postings.columns}
    one = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.cast("string").alias("value"))
    none = F.array().cast(ENTRIES)
    listed = F.concat(
        F.array(one("=active", F.lit("")), *[one(c, have[c]) for c in FACET_LIMITS if c in have]),
        F.transform(F.coalesce(have["skills"], F.array().cast("array<string>")), lambda s: one("skills", s)) if "skills" in have else none,
    )
    gone = F.array(one("=expired", F.lit("")), one("=reason", have["expiry_reason"])) if {"expired_at", "expiry_reason"} <= have.keys() else none
    ended = ~have["is_active"] & have["expired_at"].isNotNull() if "expired_at" in have else F.lit(False)
    seen = F.array(one("=first_seen", have["first_seen_at"])) if "first_seen_at" in have else none
    return F.concat(F.array(one("=total", F.lit(""))), seen, F.when(have["is_active"], listed).otherwise(none), F.when(ended, gone).otherwise(none))


def counted(entry: DataFrame, sign: int) -> DataFrame:
    """(facet, value, n) of rows (e), an entry each; sign -1 takes them away."""
    return entry.groupBy("e.facet", "e.value").agg((F.count("*") * sign).alias("n"))


def ranked(counts: DataFrame) -> DataFrame:
    """facet, value, n of the most frequent values of each facet, from (facet, value, n) of all of them.

    The rank has one literal bound for all facets, which Spark turns into a limit of each task's rows before they are dealt by facet, so
    no task holds all companies or skills; what is left, some rows of each task, is cut to each facet's own limit.
    """
    most = {**FACET_LIMITS, "skills": SKILL_LIMIT}
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), F.col("value").asc_nulls_first()))
    first = counts.where(F.col("facet").isin(*most)).withColumn("_rank", rank).where(F.col("_rank") <= max(most.values()))
    limit = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])[F.col("facet")]
    named = F.when(F.col("facet") == "skills", F.col("value")).otherwise(_label("value"))
    return first.where(F.col("_rank") <= limit).select("facet", named.alias("value"), "n")


def all_facets(postings: DataFrame) -> DataFrame:
    """facet, value, n of every facet, skills included, from one scan and one shuffle of partial counts by (facet, value)."""
    active = postings.where("is_active")
    return ranked(counted(active.select(F.explode(entries(active)).alias("e")), 1))


def stats_of(counts: DataFrame, last_seen: DataFrame, as_of: Column) -> DataFrame:
    """What stats() gives, from (facet, value, n) of all entries and one row with last_seen_at."""
    of = lambda facet: F.coalesce(F.sum(F.when(F.col("facet") == facet, F.col("n"))), F.lit(0))
    fresh = (F.col("facet") == "=first_seen") & (F.col("value").cast("timestamp_ntz") >= as_of - F.expr("INTERVAL '1' DAY"))
    values = lambda facet: F.count(F.when((F.col("facet") == facet) & F.col("value").isNotNull(), 1))
    return counts.agg(
        of("=total").alias("total"), of("=active").alias("active"), F.coalesce(F.sum(F.when(fresh, F.col("n"))), F.lit(0)).alias("added_today"), values("company").alias("companies"), values("category").alias("categories"), of("=expired").alias("expired")
    ).join(F.broadcast(last_seen), F.lit(True))  # one row


def expiry_breakdown(postings: DataFrame) -> DataFrame:
    """reason, n of the rows that were expired."""
    gone = postings.where("not is_active and expired_at is not null")
    return gone.groupBy("expiry_reason").agg(F.count("*").alias("n")).select(_label("expiry_reason", "unknown").alias("reason"), "n")


def counts(postings: DataFrame) -> DataFrame:
    return postings.agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"))


def stats(postings: DataFrame, as_of) -> DataFrame:
    """One row for the dashboard, from one scan."""
    return postings.agg(
        F.count("*").alias("total"),
        F.count_if("is_active").alias("active"),
        F.count_if(F.col("first_seen_at") >= as_of - F.expr("INTERVAL '1' DAY")).alias("added_today"),
        F.count_distinct(F.when(F.col("is_active"), F.col("company"))).alias("companies"),
        F.count_distinct(F.when(F.col("is_active"), F.col("category"))).alias("categories"),
        F.count_if(~F.col("is_active") & F.col("expired_at").isNotNull()).alias("expired"),
        F.max("last_seen_at").alias("last_seen_at"),
    )


def with_last_run(stats: DataFrame, runs: DataFrame) -> DataFrame:
    """The row of stats() with last_run, the newest run as a struct, null if there is none."""
    last = runs.orderBy(F.desc("id")).limit(1).select(F.struct("*").alias("last_run"))
    return stats.join(last, F.lit(True), "left")  # one row each
