"""Profiles: a named scope that keeps some of the postings and says why it drops the others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions import taxonomy, vocab
from sievelake.functions.matcher import compile_terms, has_term
from sievelake.functions.vocab import DEFAULT, Vocabulary
from sievelake.operators.common import where_after


@dataclass(frozen=True)
class Profile:
    key: str
    label: str
    description: str
    location: str
    queries: tuple[str, ...]
    location_terms: tuple[str, ...] = ()
    max_experience_years: int = 1
    fresher_seniorities: tuple[str, ...] = ("fresher", "intern")
    require_startup: bool = False

    def reject_reason(self, v: Vocabulary = DEFAULT) -> Column:
        years = F.col("experience_min")
        fresher = F.when(years > self.max_experience_years, False).when(years == 0, True).otherwise(F.col("seniority").isin(*self.fresher_seniorities))
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        if self.location_terms:
            out = out.when(~has_term(F.col("location"), compile_terms(self.location_terms)), "outside_target_city")
        out = out.when(~F.coalesce(fresher, F.lit(False)), "not_fresher")
        if self.require_startup:
            out = out.when(~taxonomy.is_startup(F.col("company"), F.col("title"), F.col("description"), v), "not_startup")
        return out


CITY_FRESHERS = Profile(
    key="bangalore-fresher-startups",
    label="City freshers at start-ups",
    description="Entry-level roles at young companies in one city",
    location="Bengaluru, Karnataka, India",
    queries=tuple(vocab.FRESHER_QUERIES),
    location_terms=tuple(vocab.CITY),
    require_startup=True,
)
#: Every reason that a profile gives.
REASONS = ["outside_target_city", "not_fresher", "not_startup"]
PROFILES = {p.key: p for p in (CITY_FRESHERS,)}


def get_profile(key: str) -> Profile:
    """By key, whatever the case and with underscores for dashes."""
    name = key.strip().lower().replace("_", "-")
    if name not in PROFILES:
        raise ValueError(f"unknown profile {key!r}; known: {sorted(PROFILES)}")
    return PROFILES[name]


def resolve_profile(profile: "str | Profile | None") -> Profile | None:
    return get_profile(profile) if isinstance(profile, str) else profile


def apply_profile(postings: DataFrame, profile: Profile, v: Vocabulary = DEFAULT) -> DataFrame:
    """postings with profile_reason, null where the profile keeps them."""
    return postings.withColumn("profile_reason", profile.reject_reason(v))


def profile_kept(marked: DataFrame) -> DataFrame:
    return where_after(marked, F.col("profile_reason").isNull())


def profile_funnel(marked: DataFrame) -> DataFrame:
    """reason ('kept' for those that stay), n."""
    return marked.groupBy(F.coalesce("profile_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def catalogue(spark: SparkSession, profiles=PROFILES) -> DataFrame:
    rows = [(p.key, p.label, p.description, p.location, list(p.queries), len(p.queries), p.max_experience_years, p.require_startup) for p in profiles.values()]
    return spark.createDataFrame(rows, "key string, label string, description string, location string, queries array<string>, query_count int, max_experience_years int, require_startup boolean")


def resolve_queries(explicit: list[str] | None, limit: int | None = None, profile: Profile | None = None, v: Vocabulary = DEFAULT) -> list[str]:
    """The given queries, else the profile's, else the catalogue's; blanks dropped; limit None or 0 means all."""
    chosen = explicit or (list(profile.queries) if profile else v.search_queries)
    chosen = [q.strip() for q in chosen if q and q.strip()]
    return chosen[:limit] if limit else chosen


def plan_units(n_queries: int, pages_per_source: dict[str, int]) -> int:
    return sum(n_queries * max(1, p) for p in pages_per_source.values())
