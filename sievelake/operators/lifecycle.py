"""What happens to stored postings, as functions from one snapshot to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions import parse, taxonomy, text
from sievelake.functions.vocab import DEFAULT, Vocabulary
from sievelake.operators import facets
from sievelake.operators.ingest import PAYLOAD, IngestRules

STALE_DAYS, PURGE_DAYS, AGE_OUT_DAYS, PURGE_EXPIRED_DAYS, MAX_FAILURES = 21, 60, 60, 3, 3


def _days(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' DAY")


def _set(df: DataFrame, when: Column, **values: Column) -> DataFrame:
    """df with those columns changed where the condition holds; null counts as no."""
    hit = F.coalesce(when, F.lit(False))
    return df.withColumns({c: F.when(hit, v.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def upsert(existing: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """The snapshot after incoming postings (PAYLOAD, one row per fingerprint) are stored, with action: insert, update or keep.

    Stored rows take over the payload, except an empty description over one that is there and a null posted_at; they come alive again and
    keep id and first_seen_at. New rows get ids after the greatest, in order of fingerprint.
    """
    after = merge(existing, incoming, now).drop("before")
    return after if "id" not in existing.columns else _numbered(existing, after)


def merge(existing: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """upsert() but for the numbering: new rows have incoming's id, if it has one. before: the facet entries that updated rows had."""
    old, new = existing.alias("o"), incoming.select(*PAYLOAD, *(["id"] if "id" in incoming.columns else [])).alias("n")
    joined = old.join(new, F.col("o.fingerprint") == F.col("n.fingerprint"), "full_outer")
    both = F.col("o.fingerprint").isNotNull() & F.col("n.fingerprint").isNotNull()
    fresh = F.col("o.fingerprint").isNull()
    touched = F.col("n.fingerprint").isNotNull()
    out: dict[str, Column] = {}
    for c in existing.columns:
        o = F.col(f"o.{c}")
        if c in PAYLOAD:
            n = F.col(f"n.{c}")
            if c == "description":
                n = F.when(both & (F.coalesce(n, F.lit("")) == ""), o).otherwise(n)
            elif c == "posted_at":
                n = F.coalesce(n, o)
            out[c] = F.when(touched, n).otherwise(o)
        elif c == "id" and "id" in incoming.columns:
            out[c] = F.coalesce(o, F.col("n.id"))
        elif c == "first_seen_at":
            out[c] = F.when(fresh, now).otherwise(o)
        elif c == "last_seen_at":
            out[c] = F.when(touched, now).otherwise(o)
        elif c == "is_active":
            out[c] = F.when(touched, True).otherwise(o)
        elif c == "expired_at":
            out[c] = F.when(~touched, o)
        elif c == "expiry_reason":
            out[c] = F.when(touched, "").otherwise(o)
        elif c == "check_failures":
            out[c] = F.when(touched, 0).otherwise(o)
        else:
            out[c] = o
    action = F.when(fresh, "insert").when(both, "update").otherwise("keep")
    before = F.when(both, facets.entries(existing, "o."))
    after = joined.select(*[c.alias(name) for name, c in out.items()], action.alias("action"), before.alias("before"))
    if "search_blob" in existing.columns:
        blob = text.search_blob(*[F.col(c) for c in ("title", "company", "location", "category", "skills")])
        after = after.withColumn("search_blob", F.when(F.col("action") == "keep", F.col("search_blob")).otherwise(blob))
    return after


def numbered(incoming: DataFrame, top: int) -> DataFrame:
    """incoming with ids after top, in order of fingerprint: buckets by the fingerprint's first letters are counted, then each row is placed in its bucket.

    No window spans the whole table: sorting goes by 4096 buckets of three hexadecimal digits, whose totals are 4096 rows.
    """
    new = incoming.withColumn("_bucket", F.substring("fingerprint", 1, 3))
    sizes = new.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy("fingerprint"))
    # The totals are at most 4096 rows.
    placed = new.withColumn("_nth", nth).join(F.broadcast(sizes.select("_bucket", before.alias("_before"))), "_bucket")
    return placed.withColumn("id", (F.lit(top) + F.col("_before") + F.col("_nth")).cast("long")).drop("_bucket", "_nth", "_before")


def _numbered(existing: DataFrame, after: DataFrame) -> DataFrame:
    """Ids for the inserted rows, after the greatest of existing."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    new = numbered(after.where("action = 'insert'"), 0).join(F.broadcast(top), F.lit(True))  # one row
    return after.where("action <> 'insert'").unionByName(new.withColumn("id", F.col("id") + F.col("_top")).select(*after.columns))


def tallies(upserted: DataFrame) -> DataFrame:
    return upserted.agg(F.count_if(F.col("action") == "insert").alias("created"), F.count_if(F.col("action") == "update").alias("updated"))


def deactivate_stale(p: DataFrame, now: Column, days: int = STALE_DAYS) -> DataFrame:
    return _set(p, F.col("is_active") & (F.col("last_seen_at") < now - _days(days)), is_active=F.lit(False))


def expire_aged_out(p: DataFrame, now: Column, days: int = AGE_OUT_DAYS) -> DataFrame:
    if not days:
        return p
    old = F.col("is_active") & (F.col("posted_at") < now - _days(days))
    return _set(p, old, expired_at=now, expiry_reason=F.lit("aged_out"), is_active=F.lit(False))


def purge_old(p: DataFrame, now: Column, days: int = PURGE_DAYS) -> DataFrame:
    gone = ~F.col("is_active") & (F.col("last_seen_at") < now - _days(days))
    return p.where(~F.coalesce(gone, F.lit(False)))


def purge_expired(p: DataFrame, now: Column, days: int = PURGE_EXPIRED_DAYS) -> DataFrame:
    gone = ~F.col("is_active") & (F.col("expired_at") < now - _days(days))
    return p.where(~F.coalesce(gone, F.lit(False)))


def housekeeping(p: DataFrame, now: Column) -> DataFrame:
    """Stale, aged out, purge old, purge expired, in that order; what turned stale isn't aged out as well."""
    return purge_expired(purge_old(expire_aged_out(deactivate_stale(p, now), now), now), now)


def after_run(p: DataFrame, now: Column, cancelled: bool = False, profile_run: bool = False) -> DataFrame:
    """housekeeping() once a run has ended, save after a cancelled one or one that saw only a profile's part of the postings."""
    return p if cancelled or profile_run else housekeeping(p, now)


def expire_ids(p: DataFrame, ids: DataFrame, reason: str, now: Column) -> DataFrame:
    """Active rows whose id is in ids are retired with that reason."""
    hit = ids.select(F.col("id").alias("_id")).distinct()
    joined = p.join(hit, p.id == F.col("_id"), "left")
    return _set(joined, F.col("is_active") & F.col("_id").isNotNull(), expired_at=now, expiry_reason=F.lit(reason), is_active=F.lit(False)).drop("_id")


def apply_probes(p: DataFrame, results: DataFrame, now: Column, max_failures: int = MAX_FAILURES) -> DataFrame:
    """results (id, verdict alive, gone or unknown): alive clears failures, gone retires, the third unknown in a row retires as unreachable."""
    r = results.select(F.col("id").alias("_id"), "verdict")
    j = p.join(r, p.id == F.col("_id"), "left")
    alive, gone, unknown = (F.coalesce(F.col("verdict") == x, F.lit(False)) for x in ("alive", "gone", "unknown"))
    failures = F.coalesce("check_failures", F.lit(0)) + 1
    given_up = unknown & (failures >= max_failures)
    retire = gone | given_up
    checked = alive | gone | unknown
    # Every new value is computed from the old row.
    new = {
        "check_failures": F.when(alive | gone, 0).when(unknown, failures).otherwise(F.col("check_failures")),
        "last_seen_at": F.when(alive, now).otherwise(F.col("last_seen_at")),
        "last_checked_at": F.when(checked, now).otherwise(F.col("last_checked_at")),
        "expired_at": F.when(retire, now).otherwise(F.col("expired_at")),
        "expiry_reason": F.when(gone, "gone").when(given_up, "unreachable").otherwise(F.col("expiry_reason")),
        "is_active": F.when(retire, False).otherwise(F.col("is_active")),
    }
    return j.select(*[new.get(c, F.col(c)).cast(p.schema[c].dataType).alias(c) for c in p.columns])


def probe_report(before: DataFrame, results: DataFrame, max_failures: int = MAX_FAILURES) -> DataFrame:
    """One row: checked, alive, gone, inconclusive, retired."""
    j = before.select("id", "check_failures").join(results, "id")
    is_ = lambda x: F.col("verdict") == x
    retired = is_("gone") | (is_("unknown") & (F.coalesce("check_failures", F.lit(0)) + 1 >= max_failures))
    return j.agg(
        F.count("*").alias("checked"), F.count_if(is_("alive")).alias("alive"), F.count_if(is_("gone")).alias("gone"), F.count_if(is_("unknown")).alias("inconclusive"), F.count_if(retired).alias("retired")
    )


def maintenance(p: DataFrame, results: DataFrame | None, now: Column, run_active: bool = False) -> tuple[DataFrame, str]:
    """housekeeping(), then probe results unless there are none or a run is active; what probes retire isn't purged in the same pass."""
    after = housekeeping(p, now)
    if results is None:
        return after, "disabled"
    if run_active:
        return after, "skipped: scrape_running"
    return apply_probes(after, results, now), "verified"


REDERIVED = ["experience_min", "experience_max", "category", "categories", "seniority", "work_mode"]


def reindex(p: DataFrame, now: Column, rules: IngestRules = IngestRules(), v: Vocabulary = DEFAULT) -> DataFrame:
    """Every row with REDERIVED columns computed anew from its texts, and _old_* of those columns for reindex_tallies().

    Active rows that are too senior now or not technical are retired as rejected; nothing comes alive again and skills stay.
    """
    if "search_blob" not in p.columns:
        p = p.withColumn("search_blob", F.lit(None).cast("string"))
    df = p.withColumns({f"_old_{c}": F.col(c) for c in [*REDERIVED, "is_active", "search_blob"]})
    t, d, x, s = F.col("title"), F.col("description"), F.col("experience_text"), F.col("skills")
    df = df.withColumns({"_years": parse.resolve_experience(x, t, d), "_scores": taxonomy.category_scores(t, s, d, v)})
    df = df.withColumns({"experience_min": F.col("_years.min"), "experience_max": F.col("_years.max"), "category": taxonomy.best_category(F.col("_scores"), v), "categories": taxonomy.top_categories(F.col("_scores"))})
    df = df.withColumns({"seniority": taxonomy.seniority(t, x, F.col("experience_min")), "work_mode": taxonomy.work_mode(F.col("location"), t, d)})
    df = df.withColumn("search_blob", text.search_blob(t, F.col("company"), F.col("location"), F.col("category"), s))
    bad = F.coalesce(F.col("experience_min") > rules.max_experience_years, F.lit(False)) | ~taxonomy.is_tech(t, d, s, v)
    out = _set(df.withColumn("_bad", F.col("is_active") & bad), F.col("_bad"), expired_at=now, expiry_reason=F.lit("rejected"), is_active=F.lit(False))
    return out.drop("_years", "_scores", "_bad")


def reindex_counts() -> list[Column]:
    """What reindex() did, as aggregates over its rows."""
    differ = lambda c: ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    return [
        F.count("*").alias("scanned"),
        F.count_if(differ("search_blob")).alias("reblobbed"),
        F.count_if(differ("category")).alias("recategorised"),
        F.count_if(differ("experience_min") | differ("experience_max")).alias("re_experienced"),
        F.count_if(differ("is_active")).alias("retired"),
    ]


def reindex_tallies(r: DataFrame) -> DataFrame:
    return r.agg(*reindex_counts())


def sync_schema(stored: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Additive evolution: a missing column appears with its type and default, a null in a column with a default is filled."""
    new = {}
    for c, (kind, default) in defaults.items():
        have = F.col(c) if c in stored.columns else F.lit(None).cast(kind)
        new[c] = have if default is None else F.coalesce(have, F.lit(default).cast(kind))
    return stored.withColumns(new)
