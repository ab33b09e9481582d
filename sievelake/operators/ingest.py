"""Ingest: clean, classify, reject with a reason, collapse duplicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sievelake.functions import parse, taxonomy, text
from sievelake.functions.vocab import DEFAULT, Vocabulary
from sievelake.operators.common import metrics, nth_by, where_after


@dataclass(frozen=True)
class IngestRules:
    """The limits that decide what is kept; max_age_days 0 keeps any age."""

    max_experience_years: int = 3
    max_age_days: int = 45
    min_description_chars: int = 60
    include_internships: bool = True


PAYLOAD = [
    "fingerprint", "source", "external_id", "apply_link", "title", "company", "location", "description", "experience_text", "experience_min",
    "experience_max", "salary_text", "salary_min", "salary_max", "skills", "category", "categories", "seniority", "work_mode", "posted_at",
]


def _blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike("\\S")


def classify(raw: DataFrame, as_of: Column, rules: IngestRules = IngestRules(), v: Vocabulary = DEFAULT) -> DataFrame:
    """raw postings with PAYLOAD columns and reject_reason, null where the posting is kept; the first reason that holds counts.

    raw has source, external_id, title, company, apply_link, location, experience_text, salary_text, description, posted_at, declared_skills and
    raw_id, the order of arrival. Every regular expression runs once for each row.
    """
    df = raw.withColumn("_incomplete", _blank(F.col("title")) | _blank(F.col("company")) | _blank(F.col("apply_link")))
    df = df.withColumns(
        {
            "title": text.clean_text(F.col("title"), 300),
            "company": text.clean_text(F.col("company"), 300),
            "location": text.clean_text(F.col("location"), 300),
            "description": text.clean_text(F.col("description"), 20_000),
            "experience_text": text.clean_text(F.col("experience_text"), 120),
            "salary_text": text.clean_text(F.col("salary_text"), 200),
            "_tags": F.filter(F.transform(F.coalesce("declared_skills", F.array().cast("array<string>")), lambda t: text.clean_text(t)), lambda t: t != ""),
        }
    )
    found = taxonomy.extract_skills(F.col("title"), F.col("description"), F.array_join("_tags", " "), v=v)
    df = df.withColumn("_found", found)
    df = df.withColumns({"skills": taxonomy.merge_tags(F.col("_found"), F.col("_tags")), "_years": parse.resolve_experience(F.col("experience_text"), F.col("title"), F.col("description"))})
    df = df.withColumns({"experience_min": F.col("_years.min"), "experience_max": F.col("_years.max"), "_salary": parse.salary(F.col("salary_text"))})
    df = df.withColumn("seniority", taxonomy.seniority(F.col("title"), F.col("experience_text"), F.col("experience_min")))
    df = df.withColumn("reject_reason", reject_reason(as_of, rules, v))
    df = df.withColumn("_scores", taxonomy.category_scores(F.col("title"), F.col("skills"), F.col("description"), v))
    return df.withColumns(
        {
            "salary_min": F.col("_salary.min"),
            "salary_max": F.col("_salary.max"),
            "category": taxonomy.best_category(F.col("_scores"), v),
            "categories": taxonomy.top_categories(F.col("_scores")),
            "work_mode": taxonomy.work_mode(F.col("location"), F.col("title"), F.col("description")),
            "fingerprint": text.fingerprint(F.col("title"), F.col("company"), F.col("location")),
        }
    ).select("raw_id", *PAYLOAD, "reject_reason")


def reject_reason(as_of: Column, rules: IngestRules, v: Vocabulary) -> Column:
    years, level, most = F.col("experience_min"), F.col("seniority"), rules.max_experience_years
    empty = (F.length("description") < rules.min_description_chars) & (F.size("_tags") == 0) & (F.size("skills") == 0)
    out = F.when(F.col("_incomplete"), "incomplete")
    out = out.when(taxonomy.looks_dead(F.col("description")), "dead_listing")
    out = out.when(~taxonomy.is_tech(F.col("title"), F.col("description"), F.col("skills"), v), "not_tech")
    out = out.when(empty & ~taxonomy.has_strong_title(F.col("title"), v), "no_content")
    out = out.when(years > most, "experience_too_high")
    if not rules.include_internships:
        out = out.when(level == "intern", "experience_too_high")
    out = out.when((level == "lead") & (years.isNull() | (years > most)), "experience_too_high")
    if rules.max_age_days:
        out = out.when(F.col("posted_at") < as_of - F.expr(f"INTERVAL '{rules.max_age_days}' DAY"), "posting_too_old")
    return out


def kept(classified: DataFrame) -> DataFrame:
    return where_after(classified, F.col("reject_reason").isNull())


def rejections(classified: DataFrame) -> DataFrame:
    """reject_reason, n."""
    return where_after(classified.select("reject_reason"), F.col("reject_reason").isNotNull()).groupBy("reject_reason").agg(F.count("*").alias("n"))


#: Every reason that reject_reason() gives.
REASONS = ["incomplete", "dead_listing", "not_tech", "no_content", "experience_too_high", "posting_too_old"]


def observed(classified: DataFrame) -> tuple[DataFrame, Observation]:
    """classified as it is, and its counts (seen, kept, and each of REASONS), which the job that computes it takes along."""
    seen = Observation("ingest")
    is_ = lambda r: F.count_if(F.coalesce(F.col("reject_reason") == r, F.lit(False)))
    counts = [F.count("*").alias("seen"), F.count_if(F.col("reject_reason").isNull()).alias("kept"), *[is_(r).alias(r) for r in REASONS]]
    return classified.observe(seen, *counts), seen


def observed_rejections(seen: Observation) -> dict[str, int]:
    """What rejections() counts, from an observation; waits for the job that takes it."""
    return {r: n for r, n in metrics(seen).items() if r in REASONS and n}


def dedup_richest(postings: DataFrame) -> DataFrame:
    """One row per fingerprint: the longest description, the earliest arrival where it ties."""
    return nth_by(postings, ["fingerprint"], [F.length("description").desc(), F.col("raw_id").asc()])


def dedup_first(cards: DataFrame) -> DataFrame:
    """One row per external_id, or apply_link where there is none: the earliest arrival."""
    key = F.coalesce(F.nullif("external_id", F.lit("")), F.col("apply_link"))
    return nth_by(cards.withColumn("_key", key), ["_key"], [F.col("raw_id").asc()]).drop("_key")


def ingest(raw: DataFrame, as_of: Column, rules: IngestRules = IngestRules(), v: Vocabulary = DEFAULT) -> DataFrame:
    """The postings to store: classified, kept, one per fingerprint."""
    return dedup_richest(kept(classify(raw, as_of, rules, v)))


def per_source(raw: DataFrame) -> DataFrame:
    return raw.groupBy("source").agg(F.count("*").alias("n"))
