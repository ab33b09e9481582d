"""JSON Lines: import of legacy records and export of active postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions import parse

FIELDS = ("title", "company", "location", "experience", "salary", "apply_link", "description", "skills", "source", "posted_at", "scraped_at")
_BLANKS = " \t\r\x0b\x0c"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each line that is not blank: the FIELDS, and malformed, whether the line is no JSON object.

    Every field is read as text, so a field of another type than expected costs no other field; skills that are no list are null.
    """
    lines = spark.read.text(path).select(F.btrim("value", F.lit(_BLANKS)).alias("line")).where("line <> ''")
    # Read as a list of one, so that anything after the object makes the line malformed.
    records = F.from_json(F.concat(F.lit("["), "line", F.lit("]")), f"array<struct<{', '.join(f'{c}: string' for c in FIELDS)}>>")
    parsed = lines.select("line", records.alias("records")).select(F.get("records", F.lit(0)).alias("r"), (~F.col("line").startswith("{") | ~F.size("records").eqNullSafe(1)).alias("malformed"))
    skills = F.from_json(F.when(F.col("r.skills").startswith("["), F.col("r.skills")), "array<string>")
    return parsed.select(*[(skills if c == "skills" else F.col(f"r.{c}")).alias(c) for c in FIELDS], "malformed")


def to_raw(records: DataFrame) -> DataFrame:
    """Well-formed records as raw postings; posted_at comes from scraped_at, as the exporter's reader expects."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return records.where("not malformed").select(
        F.coalesce("source", F.lit("legacy")).alias("source"), F.lit(None).cast("string").alias("external_id"), text("title").alias("title"), text("company").alias("company"), text("location").alias("location"),
        text("experience").alias("experience_text"), text("salary").alias("salary_text"), text("apply_link").alias("apply_link"), text("description").alias("description"),
        parse.iso_date(F.col("scraped_at")).alias("posted_at"), F.coalesce("skills", F.array().cast("array<string>")).alias("declared_skills"),
    )


def malformed(records: DataFrame) -> DataFrame:
    """One row: malformed, lines."""
    return records.agg(F.count_if("malformed").alias("malformed"), F.count("*").alias("lines"))


def export_rows(postings: DataFrame) -> DataFrame:
    """The 14 fields of an exported record, active rows only."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return postings.where("is_active").select(
        "title", "company", "location", F.col("experience_text").alias("experience"), F.col("salary_text").alias("salary"), "apply_link", "description", "skills", "category", "seniority", "work_mode", "source",
        iso("posted_at").alias("posted_at"), iso("first_seen_at").alias("scraped_at"),
    )


def export(postings: DataFrame, path: str) -> None:
    export_rows(postings).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
