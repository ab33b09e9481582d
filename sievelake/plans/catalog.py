"""Every query of the library with the SQL that another engine runs for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelake.functions import parse, taxonomy, text, vocab
from sievelake.functions.matcher import compile_terms, has_term
from sievelake.functions.vocab import DEFAULT
from sievelake.operators import facets, ingest, lifecycle, probe, profiles, runs, search
from sievelake.operators.common import inline_after, scratch_folder
from sievelake.operators.search import Filters
from sievelake.plans import fixtures
from sievelake.plans.fixtures import AS_OF, DESCRIPTIONS, case_of, oracle, view
from sievelake.sources import boards, html_text, jsonl, paged
from sievelake.sources.store import Store
from sievelake.streaming import tail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}



def now():
    """The fixture's clock; a column can be made only where a session runs."""
    return F.lit(AS_OF).cast("timestamp_ntz")


NOW_SQL = f"TIMESTAMP '{AS_OF}'"
#: A list as one string, so that every engine compares it alike.
joined = lambda c: F.array_join(c, "|")


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, views: bool = True) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = oracle(sql) if views else sql


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored postings with their search blob."""
    p = view(spark, sf_dir, "postings").drop("t", "d", "g", "x", "l")
    return p.withColumn("search_blob", text.search_blob(*[F.col(c) for c in ("title", "company", "location", "category", "skills")]))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "postings_raw").withColumn("declared_skills", text.split_csv(F.col("tags")))


# ------------------------------------------------------------------ search

SLIM = ["id", "source", "title", "company", "location", "experience_min", "experience_max", "category", "seniority", "work_mode", "posted_at"]
SLIM_SQL = ", ".join(SLIM)
BLOB_SQL = "lower(concat_ws(' ', nullif(title,''), nullif(company,''), nullif(location,''), nullif(category,''), CASE WHEN len(skills) > 0 THEN '|' || lower(array_to_string(skills, '|')) || '|' END))"


def slim(df: DataFrame) -> DataFrame:
    return df.select(*SLIM)


MAIN = Filters(q="sql", skill=["SQL"], max_experience=2)
MAIN_WHERE = f"is_active AND (contains({BLOB_SQL}, 'sql') OR contains(lower(description), 'sql')) AND list_contains(skills, 'SQL') AND (experience_min <= 2 OR experience_min IS NULL)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slim(search.search(postings(spark, sf_dir), MAIN, now()))


add("search_page", flagship, f"SELECT {SLIM_SQL} FROM postings WHERE {MAIN_WHERE} ORDER BY posted_at DESC NULLS LAST, id DESC LIMIT 25")
add("search_page_2", lambda s, d: slim(search.search(postings(s, d), MAIN, now(), page=2, size=10)), f"SELECT {SLIM_SQL} FROM postings WHERE {MAIN_WHERE} ORDER BY posted_at DESC NULLS LAST, id DESC LIMIT 10 OFFSET 10")
add("search_count", lambda s, d: search.total(postings(s, d), MAIN, now()), f"SELECT count(*) AS total FROM postings WHERE {MAIN_WHERE}")
add(
    "search_meta",
    lambda s, d: search.page_meta(postings(s, d), MAIN, now(), page=2, size=10),
    f"SELECT 2 AS page, 10 AS page_size, count(*) AS total, CAST(ceil(count(*) / 10) AS BIGINT) AS total_pages, 2 < ceil(count(*) / 10) AS has_next, true AS has_prev FROM postings WHERE {MAIN_WHERE}",
)
_FILTERS = {
    "filter_source": (Filters(source=["LinkedIn"]), "source = 'linkedin'"),
    "filter_category": (Filters(category=["Backend", "Frontend"]), "category IN ('Backend', 'Frontend')"),
    "filter_category_is_case_sensitive": (Filters(category=["backend"]), "false"),
    "filter_seniority": (Filters(seniority=["Intern", "junior"]), "seniority IN ('intern', 'junior')"),
    "filter_work_mode": (Filters(work_mode=["REMOTE"]), "work_mode = 'remote'"),
    "filter_location": (Filters(location="bengal"), "contains(lower(location), 'bengal')"),
    "filter_company": (Filters(company="INFOSYS"), "contains(lower(company), 'infosys')"),
    "filter_skill_all": (Filters(skill=["sql", " Python "]), "list_contains(skills, 'SQL') AND list_contains(skills, 'Python')"),
    "filter_skill_exact": (Filters(skill=["java"]), "list_contains(skills, 'Java')"),
    "filter_exp_lenient": (Filters(min_experience=2, max_experience=3), "(experience_max >= 2 OR experience_max IS NULL) AND (experience_min <= 3 OR experience_min IS NULL)"),
    "filter_exp_strict": (Filters(min_experience=2, max_experience=3, include_unknown_experience=False), "experience_max >= 2 AND experience_min <= 3"),
    "filter_posted_within": (Filters(posted_within_days=14), f"(posted_at >= {NOW_SQL} - INTERVAL 14 DAY OR posted_at IS NULL)"),
    "filter_text": (Filters(q="  Bachelor "), f"(contains({BLOB_SQL}, 'bachelor') OR contains(lower(description), 'bachelor'))"),
    "filter_blank_text": (Filters(q="   "), "true"),
    "filter_inactive_too": (Filters(source=["naukri"], active_only=False), "source = 'naukri'"),
}
for _name, (_f, _sql) in _FILTERS.items():
    add(_name, lambda s, d, f=_f: slim(search.matching(postings(s, d), f, now())), f"SELECT {SLIM_SQL} FROM postings WHERE {'' if not _f.active_only else 'is_active AND '}({_sql})")
for _c, _k in search.SORT_COLUMNS.items():
    for _o in ("asc", "desc"):
        _nulls = "NULLS LAST" if _o == "desc" else "NULLS FIRST"
        add(
            f"sort_{_c}_{_o}",
            lambda s, d, c=_c, o=_o: slim(search.search(postings(s, d), Filters(), now(), page=2, size=50, sort=c, order=o)),
            f"SELECT {SLIM_SQL} FROM postings WHERE is_active ORDER BY {_k} {_o} {_nulls}, id DESC LIMIT 50 OFFSET 50",
        )
add(
    "filter_wildcards_literal",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").where(F.lower("text").contains("%%") | F.lower("text").contains("a_b")).select("doc_id", "source"),
    "SELECT doc_id, source FROM documents WHERE contains(lower(text), '%%') OR contains(lower(text), 'a_b')",
    views=False,
)
_DETAIL = ["id", "description", "external_id", "expired_at", "expiry_reason", "last_checked_at"]
add(
    "posting_detail",
    lambda s, d: search.detail(postings(s, d), postings(s, d).agg(F.max("id")).first()[0]).select(*_DETAIL),
    f"SELECT {', '.join(_DETAIL)} FROM postings WHERE id = (SELECT max(id) FROM postings)",
)
add("added_today", lambda s, d: search.added_since(postings(s, d), now()), f"SELECT count(*) AS n FROM postings WHERE first_seen_at >= {NOW_SQL} - INTERVAL 1 DAY")

# ------------------------------------------------------------------ facets


def _facet_sql(c: str, n: int) -> str:
    return f"SELECT CASE WHEN v IS NULL OR v = '' THEN 'Unknown' ELSE v END AS value, n FROM (SELECT {c} AS v, count(*) AS n FROM postings WHERE is_active GROUP BY 1 ORDER BY n DESC, v NULLS FIRST LIMIT {n})"


for _c, _n in facets.FACET_LIMITS.items():
    add(f"facet_{_c}", lambda s, d, c=_c, n=_n: facets.facet(postings(s, d), c, n), _facet_sql(_c, _n))
_SKILLS_SQL = "SELECT v AS value, n FROM (SELECT v, count(*) AS n FROM (SELECT unnest(skills) AS v FROM postings WHERE is_active) GROUP BY v ORDER BY n DESC, v LIMIT 60)"
add("facet_skills", lambda s, d: facets.skill_facet(postings(s, d)), _SKILLS_SQL)
_FACETS_SQL = " UNION ALL ".join([*(f"SELECT '{c}' AS facet, * FROM ({_facet_sql(c, n)})" for c, n in facets.FACET_LIMITS.items()), f"SELECT 'skills' AS facet, * FROM ({_SKILLS_SQL})"])
add("facets_all", lambda s, d: facets.all_facets(postings(s, d)), _FACETS_SQL)
add(
    "facet_document_source",
    lambda s, d: facets.facet(s.read.parquet(f"{d}/documents.parquet").withColumn("is_active", F.lit(True)), "source", 20),
    "SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 20",
    views=False,
)
add(
    "expiry_breakdown",
    lambda s, d: facets.expiry_breakdown(postings(s, d)),
    "SELECT CASE WHEN expiry_reason = '' THEN 'unknown' ELSE expiry_reason END AS reason, count(*) AS n FROM postings WHERE NOT is_active AND expired_at IS NOT NULL GROUP BY 1",
)
add("posting_counts", lambda s, d: facets.counts(postings(s, d)), "SELECT count(*) AS total, count(*) FILTER (is_active) AS active FROM postings")
_STATS_SQL = f"""SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (first_seen_at >= {NOW_SQL} - INTERVAL 1 DAY) AS added_today,
    count(DISTINCT company) FILTER (is_active) AS companies, count(DISTINCT category) FILTER (is_active) AS categories,
    count(*) FILTER (NOT is_active AND expired_at IS NOT NULL) AS expired, max(last_seen_at) AS last_seen_at FROM postings"""
add("stats_summary", lambda s, d: facets.stats(postings(s, d), now()), _STATS_SQL)

# ------------------------------------------------------------------ text

_CLEAN = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
add(
    "clean_text",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("cleaned"), text.clean_text(F.col("text"), 40).alias("head")),
    f"SELECT doc_id, md5({_CLEAN.format('text')}) AS cleaned, substring({_CLEAN.format('text')}, 1, 40) AS head FROM documents",
    views=False,
)
_FP = f"sha1({_NORM.format('title')} || '|' || {_NORM.format('company')} || '|' || split_part({_NORM.format('location')}, ' ', 1))"
add("fingerprint", lambda s, d: raw(s, d).select("raw_id", text.fingerprint(F.col("title"), F.col("company"), F.col("location")).alias("fingerprint")), f"SELECT raw_id, {_FP} AS fingerprint FROM postings_raw")
add("search_blob", lambda s, d: postings(s, d).select("id", "search_blob", text.skills_fence(F.col("skills")).alias("fence")), f"SELECT id, {BLOB_SQL} AS search_blob, CASE WHEN len(skills) = 0 THEN '' ELSE '|' || lower(array_to_string(skills, '|')) || '|' END AS fence FROM postings")
add("slug", lambda s, d: raw(s, d).select("raw_id", text.slug(F.col("location")).alias("slug"), text.seo_key(F.col("title"), "Bangalore").alias("key"), text.search_url("https://x.example/", F.col("title"), F.lit(2)).alias("url")),
    "SELECT raw_id, trim(regexp_replace(lower(location), '[^a-z0-9]+', '-', 'g'), '-') AS slug, replace(lower(title), ' ', '-') || '-jobs-in-bangalore' AS key, 'https://x.example/' || replace(lower(title), ' ', '-') || '-jobs-2' AS url FROM postings_raw")
add("strip_tracking", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", text.strip_tracking(F.col("url")).alias("url")), "SELECT page_id, split_part(url, '?', 1) AS url FROM pages", views=False)
add(
    "absolute_url",
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", *[text.absolute_url(e, "https://b.example/").alias(n) for n, e in (("whole", F.col("url")), ("bare", F.regexp_replace("url", "^https?:", "")), ("path", F.regexp_replace("url", "^https?://[^/]*", "")))]),
    """SELECT page_id, url AS whole, 'https:' || regexp_replace(url, '^https?:', '') AS bare, CASE WHEN p = '' THEN '' WHEN starts_with(p, '/') THEN 'https://b.example' || p ELSE 'https://b.example/' || p END AS path
    FROM (SELECT *, regexp_replace(url, '^https?://[^/]*', '') AS p FROM pages)""",
    views=False,
)
add("id_from_link", lambda s, d: raw(s, d).select("raw_id", text.id_from_link(text.strip_tracking(F.col("apply_link"))).alias("any_id"), text.id_from_link(text.strip_tracking(F.col("apply_link")), 4).alias("long_id")),
    "SELECT raw_id, CASE WHEN apply_link <> '' THEN CAST(raw_id AS VARCHAR) END AS any_id, CASE WHEN apply_link <> '' AND raw_id >= 1000 THEN CAST(raw_id AS VARCHAR) END AS long_id FROM postings_raw")
add("split_csv", lambda s, d: raw(s, d).select("raw_id", joined("declared_skills").alias("parts"), F.size("declared_skills").alias("n")),
    "SELECT raw_id, replace(tags, ',', '|') AS parts, CASE WHEN tags = '' THEN 0 ELSE len(regexp_split_to_array(tags, '[,|]')) END AS n FROM postings_raw")

# ------------------------------------------------------------------ parse

_two = lambda c: [F.col(f"{c}.min").alias("low"), F.col(f"{c}.max").alias("high")]
add("salary", lambda s, d: raw(s, d).select("raw_id", parse.salary(F.col("salary_text")).alias("p")).select("raw_id", *_two("p")),
    f"SELECT raw_id, {case_of('s', ['300000.0::DOUBLE', 'NULL', '15000000.0::DOUBLE', 'NULL'])} AS low, {case_of('s', ['500000.0::DOUBLE', 'NULL', '15000000.0::DOUBLE', 'NULL'])} AS high FROM postings_raw")
add("experience_field", lambda s, d: raw(s, d).select("raw_id", parse.experience(F.col("experience_text")).alias("p")).select("raw_id", *_two("p")),
    f"SELECT raw_id, {case_of('x', ['0', '5', '0', 'NULL', 'NULL', '2', 'NULL'])} AS low, {case_of('x', ['2', '7', '1', 'NULL', 'NULL', '5', 'NULL'])} AS high FROM postings_raw")
add("experience_label", lambda s, d: raw(s, d).select("raw_id", parse.label_years(F.col("experience_text")).alias("p")).select("raw_id", *_two("p")), f"SELECT raw_id, CASE WHEN x = 3 THEN 5 END AS low, CAST(NULL AS INT) AS high FROM postings_raw")
#: What each description and title of the fixture states.
_PROSE = ["NULL", "4", "NULL", "NULL", "1", "NULL"], ["NULL", "NULL", "NULL", "NULL", "3", "NULL"]
_TITLE_YEARS = "CASE WHEN t IN (6, 7) THEN {0} END"
add("experience_prose", lambda s, d: raw(s, d).select("raw_id", parse.experience_in_prose(F.col("description")).alias("p")).select("raw_id", *_two("p")),
    f"SELECT raw_id, {case_of('d', _PROSE[0])} AS low, {case_of('d', _PROSE[1])} AS high FROM postings_raw")
YEARS_LOW = f"CASE WHEN x IN (0,1,2,3,5) THEN {case_of('x', ['0', '5', '0', '5', 'NULL', '2', 'NULL'])} WHEN d IN (1,4) THEN {case_of('d', _PROSE[0])} ELSE {_TITLE_YEARS.format(0)} END"
YEARS_HIGH = f"CASE WHEN x IN (0,1,2,3,5) THEN {case_of('x', ['2', '7', '1', 'NULL', 'NULL', '5', 'NULL'])} WHEN d IN (1,4) THEN {case_of('d', _PROSE[1])} ELSE {_TITLE_YEARS.format(1)} END"
add("resolve_experience", lambda s, d: raw(s, d).select("raw_id", parse.resolve_experience(F.col("experience_text"), F.col("title"), F.col("description")).alias("p")).select("raw_id", *_two("p")),
    f"SELECT raw_id, {YEARS_LOW} AS low, {YEARS_HIGH} AS high FROM postings_raw")
add(
    "epoch_ms",
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", parse.epoch(F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).alias("from_ms"), parse.epoch(F.col("event_id")).alias("from_s")),
    "SELECT event_id, make_timestamp((epoch_us(ts) // 1000000) * 1000000) AS from_ms, CASE WHEN event_id > 0 THEN make_timestamp(event_id * 1000000) END AS from_s FROM events",
    views=False,
)
add(
    "iso_date",
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", parse.iso_date(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("whole"), parse.iso_date(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" or so"))).alias("day"), parse.iso_date(F.date_format("ts", "yyyy")).alias("year")),
    "SELECT event_id, date_trunc('second', ts) AS whole, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(NULL AS TIMESTAMP) AS year FROM events",
    views=False,
)
_AGO = ["'just now'", "'3 hours ago'", "'1 hour ago'", "'Yesterday'", "'5 days ago'", "'2 weeks ago'", "'30+ Days Ago'", "'a month ago'", "'1 year ago'", "'whenever'"]
_AGO_SQL = [NOW_SQL, NOW_SQL, *(f"{NOW_SQL} - INTERVAL '{k} hours'" for k in (1, 24, 120, 336, 720, 720, 8760)), "NULL"]
add(
    "relative_date",
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", parse.relative_date(F.expr(case_of("event_id % 10", _AGO)), now()).alias("at")),
    f"SELECT event_id, {case_of('event_id % 10', _AGO_SQL)} AS at FROM events",
    views=False,
)

# ------------------------------------------------------------------ classification


def _any(terms) -> str:
    """RE2 has no look-around; on the fixture's plain texts word boundaries say the same."""
    return r"(?i)\b(?:" + "|".join(re.escape(t).replace("'", "''") for t in sorted(terms, key=lambda t: (-len(t), t)) if re.match(r"\w.*\w$|\w$", t)) + r")\b"


def _has(column: str, terms) -> str:
    return f"regexp_matches({column}, '{_any(terms)}')"


_FOUND = [
    {"AWS", "Django", "PostgreSQL", "Python", "REST APIs"}, {"React", "TypeScript"}, {"Docker", "Kubernetes", "Terraform"}, {"Java"}, {"Java", "JavaScript", "SQL"}, set(),
], [{"Python", "SQL"}, {"React"}, set(), {"Docker"}, {"Java", "SQL"}]


def _skill_list(found: set[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in sorted(found)) + "]::VARCHAR[]"


SKILLS_CTE = f"""tagged AS (SELECT *, list_sort(list_distinct(list_concat({case_of('d', [_skill_list(f) for f in _FOUND[0]])}, {case_of('g', [_skill_list(f) for f in _FOUND[1]])}))) AS found FROM postings_raw),
skilled AS (SELECT *, CASE WHEN g = 1 THEN list_append(found, 'Zarnix Suite') ELSE found END AS skills FROM tagged)"""


def _score_sql() -> str:
    hits = lambda c, k: f"len(regexp_extract_all({c}, '{_any(k)}'))"
    return ", ".join(f"5 * {hits('title', ks)} + 2 * {hits(chr(40) + 'array_to_string(skills, chr(32))' + chr(41), ks)} + {hits('description', ks)} AS c{k}" for k, ks in enumerate(vocab.CATEGORIES.values()))


_N = len(vocab.CATEGORIES)
_B, _FE = list(vocab.CATEGORIES).index("Backend"), list(vocab.CATEGORIES).index("Frontend")
_MOST = f"greatest({', '.join(f'c{k}' for k in range(_N))})"
SCORED_CTE = f"{SKILLS_CTE}, scored AS (SELECT *, {_score_sql()} FROM skilled)"
CATEGORY_SQL = f"CASE WHEN {_MOST} = 0 THEN 'Other' WHEN c{_B} >= 5 AND c{_FE} >= 5 THEN 'Full Stack' " + " ".join(f"WHEN c{k} = {_MOST} THEN '{name}'" for k, name in enumerate(vocab.CATEGORIES)) + " END"
TECH_SQL = f"""CASE WHEN {_has('title', vocab.STRONG_TECH)} THEN true WHEN {_has('title', vocab.NON_TECH)} THEN false
  WHEN {_has('title', vocab.GENERIC_ROLES)} AND ({_has('title', vocab.QUALIFIERS)} OR len(skills) >= 2) THEN true ELSE len(skills) >= 4 AND {_has('description', vocab.STRONG_TECH)} END"""
SENIORITY_SQL = f"CASE t WHEN 6 THEN 'intern' WHEN 5 THEN 'lead' WHEN 7 THEN 'fresher' ELSE CASE WHEN x = 2 THEN 'fresher' WHEN ({YEARS_LOW}) IS NULL THEN 'mid' WHEN ({YEARS_LOW}) = 0 THEN 'fresher' WHEN ({YEARS_LOW}) <= 2 THEN 'junior' WHEN ({YEARS_LOW}) <= 5 THEN 'mid' WHEN ({YEARS_LOW}) <= 8 THEN 'senior' ELSE 'lead' END END"


def with_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw(spark, sf_dir)
    found = taxonomy.extract_skills(F.col("title"), F.col("description"), F.array_join("declared_skills", " "))
    return r.withColumn("found", found).withColumn("skills", taxonomy.merge_tags(F.col("found"), F.col("declared_skills")))


add("skills", lambda s, d: with_skills(s, d).select("raw_id", joined("found").alias("found"), joined("skills").alias("skills")), None)
ORACLES["skills"] = oracle("SELECT 1").replace(" SELECT 1", f", {SKILLS_CTE} SELECT raw_id, array_to_string(found, '|') AS found, array_to_string(skills, '|') AS skills FROM skilled")


def with_views(more: str, select: str) -> str:
    return f"WITH {fixtures.ctes('duckdb')}, {more} {select}"


ORACLES["skills"] = with_views(SKILLS_CTE, "SELECT raw_id, array_to_string(found, '|') AS found, array_to_string(skills, '|') AS skills FROM skilled")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_skills(spark, sf_dir).withColumn("scores", taxonomy.category_scores(F.col("title"), F.col("skills"), F.col("description")))


add("categorize", lambda s, d: _scored(s, d).select("raw_id", taxonomy.best_category(F.col("scores")).alias("category")))
ORACLES["categorize"] = with_views(SCORED_CTE, f"SELECT raw_id, {CATEGORY_SQL} AS category FROM scored")
add("category_scores", lambda s, d: inline_after(_scored(s, d), "scores", "raw_id").select("raw_id", "name", "score"))
ORACLES["category_scores"] = with_views(SCORED_CTE, " UNION ALL ".join(f"SELECT raw_id, '{name}' AS name, c{k} AS score FROM scored WHERE c{k} > 0" for k, name in enumerate(vocab.CATEGORIES)))
add("secondary_categories", lambda s, d: _scored(s, d).select("raw_id", joined(taxonomy.top_categories(F.col("scores"))).alias("categories")))
add("is_tech", lambda s, d: with_skills(s, d).select("raw_id", taxonomy.is_tech(F.col("title"), F.col("description"), F.col("skills")).alias("is_tech"), taxonomy.has_strong_title(F.col("title")).alias("strong")))
ORACLES["is_tech"] = with_views(SKILLS_CTE, f"SELECT raw_id, {TECH_SQL} AS is_tech, {_has('title', vocab.STRONG_TECH)} AS strong FROM skilled")
add("seniority", lambda s, d: raw(s, d).withColumn("p", parse.resolve_experience(F.col("experience_text"), F.col("title"), F.col("description"))).select("raw_id", taxonomy.seniority(F.col("title"), F.col("experience_text"), F.col("p.min")).alias("seniority")),
    f"SELECT raw_id, {SENIORITY_SQL} AS seniority FROM postings_raw")
MODE_SQL = "CASE l WHEN 2 THEN 'remote' WHEN 4 THEN 'hybrid' ELSE 'onsite' END"
add("work_mode", lambda s, d: raw(s, d).select("raw_id", taxonomy.work_mode(F.col("location"), F.col("title"), F.col("description")).alias("work_mode")), f"SELECT raw_id, {MODE_SQL} AS work_mode FROM postings_raw")
add("looks_dead", lambda s, d: raw(s, d).select("raw_id", taxonomy.looks_dead(F.col("description")).alias("dead")), "SELECT raw_id, contains(lower(description), 'position has been filled') AS dead FROM postings_raw")
_EDGE = r"(?i)(?:^|[^a-z0-9+#.]|(?:^|[^a-z0-9])\.)(?:the|of|la)(?:$|[^a-z0-9+#.]|\.(?:$|[^a-z0-9]))"
add("term_match", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", has_term(F.col("text"), compile_terms(["the", "of", "la"])).alias("hit")), f"SELECT doc_id, regexp_matches(text, '{_EDGE}') AS hit FROM documents", views=False)
_STARTUP = "d = 2 AND company <> 'Infosys Limited'"
add("startup", lambda s, d: raw(s, d).select("raw_id", taxonomy.is_enterprise(F.col("company")).alias("enterprise"), taxonomy.startup_signal(F.col("company"), F.col("title"), F.col("description")).alias("signal"), taxonomy.is_startup(F.col("company"), F.col("title"), F.col("description")).alias("startup")),
    f"SELECT raw_id, company = 'Infosys Limited' AS enterprise, CASE WHEN d = 2 THEN 'early-stage' END AS signal, {_STARTUP} AS startup FROM postings_raw")

# Texts that differ from row to row, and oracles that find the terms in them.
_SKILL_TERMS = fixtures.plain(DEFAULT.alias_to_skill)
_VARIED = fixtures.varied(
    fixtures.plain([*vocab.STRONG_TECH, *vocab.GENERIC_ROLES, *vocab.QUALIFIERS, *vocab.NON_TECH, *vocab.INTERN_TERMS, *vocab.LEAD_TERMS, *vocab.SENIOR_TERMS, *vocab.JUNIOR_TERMS]),
    _SKILL_TERMS, fixtures.plain([*vocab.DEAD_PHRASES, *vocab.STARTUP_SIGNALS, *vocab.REMOTE_TERMS, *vocab.HYBRID_TERMS, *DEFAULT.keyword_to_category, "0 years of experience", "minimum 4 years of experience"]), _SKILL_TERMS,
)


def _varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "varied", _VARIED)


def add_varied(name: str, run: Callable[[DataFrame], DataFrame], select: str, more: str = "") -> None:
    QUERIES[name] = lambda s, d: run(_varied(s, d))
    ORACLES[name] = with_views(f"{_VARIED}{', ' if more else ''}{more}", select)


def _map_sql(mapping: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in mapping.items() if fixtures.plain([k], "'|+#")) + "}"


_FOUND_SQL = f"""named AS (SELECT *, list_distinct(list_transform(regexp_extract_all(title || ' ' || chr(10) || ' ' || description, '{_any(_SKILL_TERMS)}'), lambda m: {_map_sql(DEFAULT.alias_to_skill)}[lower(m)])) AS all_found FROM varied),
found AS (SELECT *, list_sort(all_found)[1:{taxonomy.MAX_SKILLS}] AS skills FROM named)"""
add_varied("varied_skills", lambda v: v.select("raw_id", joined(taxonomy.extract_skills(F.col("title"), F.col("description"))).alias("skills")), "SELECT raw_id, array_to_string(skills, '|') AS skills FROM found", _FOUND_SQL)
_WORDS = fixtures.plain(DEFAULT.keyword_to_category, "'|+#")  # names of skills like Node.js are matched too
_HIT_PARTS = f"""hits AS (
  SELECT raw_id, 1 AS part, 5 AS w, regexp_extract_all(title, '{_any(_WORDS)}') AS ms FROM found UNION ALL SELECT raw_id, 2, 2, regexp_extract_all(array_to_string(skills, ' '), '{_any(_WORDS)}') FROM found
  UNION ALL SELECT raw_id, 3, 1, regexp_extract_all(description[1:4000], '{_any(_WORDS)}') FROM found),
each_hit AS (SELECT raw_id, w, part * 100000 + i AS place, {_map_sql(DEFAULT.keyword_to_category)}[lower(ms[i])] AS name FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM hits)),
ranks AS (SELECT unnest({list(vocab.CATEGORIES)}) AS name, generate_subscripts({list(vocab.CATEGORIES)}, 1) AS rank),
scored AS (SELECT raw_id, name, sum(w) AS score, min(place) AS nth, any_value(rank) AS rank FROM each_hit JOIN ranks USING (name) GROUP BY raw_id, name)"""
_HITS_SQL = f"{_FOUND_SQL}, {_HIT_PARTS}"


def _varied_scores(v: DataFrame) -> DataFrame:
    found = v.withColumn("skills", taxonomy.extract_skills(F.col("title"), F.col("description")))
    return found.withColumn("scores", taxonomy.category_scores(F.col("title"), F.col("skills"), F.col("description")))


add_varied("varied_category_scores", lambda v: inline_after(_varied_scores(v), "scores", "raw_id").select("raw_id", "name", F.col("score").cast("long")), "SELECT raw_id, name, CAST(score AS BIGINT) AS score FROM scored", _HITS_SQL)
add_varied(
    "varied_categories",
    lambda v: _varied_scores(v).select("raw_id", taxonomy.best_category(F.col("scores")).alias("category")),
    """SELECT v.raw_id, CASE WHEN s.raw_id IS NULL THEN 'Other' WHEN back >= 5 AND front >= 5 THEN 'Full Stack' ELSE best END AS category FROM varied v
    LEFT JOIN (SELECT raw_id, arg_min(name, -score * 1000 + rank) AS best, sum(score) FILTER (name = 'Backend') AS back, sum(score) FILTER (name = 'Frontend') AS front FROM scored GROUP BY 1) s ON v.raw_id = s.raw_id""",
    _HITS_SQL,
)
_TOP_SQL = """SELECT v.raw_id, coalesce(c, '') AS categories FROM {0} v LEFT JOIN (SELECT raw_id, string_agg(name, '|' ORDER BY score DESC, nth) AS c
    FROM (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY score DESC, nth) AS k FROM scored) WHERE k <= 3 AND score >= 2 GROUP BY 1) s ON v.raw_id = s.raw_id"""
add_varied("varied_secondary_categories", lambda v: _varied_scores(v).select("raw_id", joined(taxonomy.top_categories(F.col("scores"))).alias("categories")), _TOP_SQL.format("varied"), _HITS_SQL)
ORACLES["secondary_categories"] = with_views(f"{SKILLS_CTE}, found AS (SELECT raw_id, title, skills, description FROM skilled), {_HIT_PARTS}", _TOP_SQL.format("skilled"))
add_varied(
    "varied_is_tech",
    lambda v: v.withColumn("skills", taxonomy.extract_skills(F.col("title"), F.col("description"))).select("raw_id", taxonomy.is_tech(F.col("title"), F.col("description"), F.col("skills")).alias("is_tech")),
    f"SELECT raw_id, {TECH_SQL} AS is_tech FROM found",
    _FOUND_SQL,
)
add_varied(
    "varied_seniority",
    lambda v: v.select("raw_id", taxonomy.seniority(F.col("title"), F.lit(""), F.lit(None).cast("int")).alias("seniority")),
    f"""SELECT raw_id, CASE WHEN {_has('title', vocab.INTERN_TERMS)} THEN 'intern' WHEN {_has('title', vocab.LEAD_TERMS)} THEN 'lead' WHEN {_has('title', vocab.SENIOR_TERMS)} THEN 'senior'
    WHEN {_has('title', vocab.FRESHER_TERMS)} THEN 'fresher' WHEN {_has('title', vocab.JUNIOR_TERMS)} THEN 'junior' ELSE 'mid' END AS seniority FROM varied""",
)
add_varied(
    "varied_work_mode",
    lambda v: v.select("raw_id", taxonomy.work_mode(F.lit("Pune"), F.col("title"), F.col("description")).alias("work_mode")),
    f"SELECT raw_id, CASE WHEN {_has('t', vocab.HYBRID_TERMS)} THEN 'hybrid' WHEN {_has('t', vocab.REMOTE_TERMS)} THEN 'remote' ELSE 'onsite' END AS work_mode FROM (SELECT *, 'Pune ' || title || ' ' || description[1:600] AS t FROM varied)",
)
add_varied(
    "varied_looks_dead",
    lambda v: v.select("raw_id", taxonomy.looks_dead(F.col("description")).alias("dead")),
    "SELECT raw_id, " + " OR ".join(f"contains(lower(description[1:4000]), '{p}')" for p in vocab.DEAD_PHRASES) + " AS dead FROM varied",
)
_SIGNALS = fixtures.plain(vocab.STARTUP_SIGNALS)
add_varied(
    "varied_startup",
    lambda v: v.select("raw_id", taxonomy.is_enterprise(F.col("company")).alias("enterprise"), taxonomy.startup_signal(F.col("company"), F.col("title"), F.col("description")).alias("signal")),
    f"SELECT raw_id, {_has('company', [*vocab.ENTERPRISE, *vocab.STAFFING])} AS enterprise, nullif(lower(regexp_extract(description, '{_any(_SIGNALS)}')), '') AS signal FROM varied",
)

# ------------------------------------------------------------------ ingest

CLEANED = DESCRIPTIONS[0].replace("  ", " ")
REASON_SQL = f"""CASE WHEN apply_link = '' THEN 'incomplete' WHEN d = 3 THEN 'dead_listing' WHEN NOT {TECH_SQL} THEN 'not_tech'
  WHEN length(description) < 60 AND tags = '' AND len(skills) = 0 AND NOT {_has('title', vocab.STRONG_TECH)} THEN 'no_content'
  WHEN ({YEARS_LOW}) > 3 THEN 'experience_too_high' WHEN t = 5 AND (({YEARS_LOW}) IS NULL OR ({YEARS_LOW}) > 3) THEN 'experience_too_high'
  WHEN posted_at < {NOW_SQL} - INTERVAL 45 DAY THEN 'posting_too_old' END"""
INGEST_CTE = f"""{SCORED_CTE}, judged AS (SELECT *, {REASON_SQL} AS reject_reason, {YEARS_LOW} AS experience_min, {YEARS_HIGH} AS experience_max, {SENIORITY_SQL} AS seniority, {CATEGORY_SQL} AS category, {MODE_SQL} AS work_mode, {_FP} AS fingerprint, length({_CLEAN.format('description')}) AS n_description FROM scored),
kept AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY n_description DESC, raw_id) AS nth FROM judged WHERE reject_reason IS NULL), stored AS (SELECT * FROM kept WHERE nth = 1)"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.classify(raw(spark, sf_dir), now())


add("reject_reasons", lambda s, d: ingest.rejections(_classified(s, d)))
ORACLES["reject_reasons"] = with_views(INGEST_CTE, "SELECT reject_reason, count(*) AS n FROM judged WHERE reject_reason IS NOT NULL GROUP BY 1")
_KEPT = ["raw_id", "fingerprint", "title", "company", "experience_min", "experience_max", "seniority", "category", "work_mode"]
add("ingest_kept", lambda s, d: ingest.kept(_classified(s, d)).select(*_KEPT, joined("skills").alias("skills"), F.length("description").alias("n_description")))
ORACLES["ingest_kept"] = with_views(INGEST_CTE, f"SELECT {', '.join(_KEPT)}, array_to_string(skills, '|') AS skills, n_description FROM kept")
add("ingest", lambda s, d: ingest.ingest(raw(s, d), now()).select(*_KEPT, joined("skills").alias("skills")))
ORACLES["ingest"] = with_views(INGEST_CTE, f"SELECT {', '.join(_KEPT)}, array_to_string(skills, '|') AS skills FROM stored")
add(
    "dedup_richest",
    lambda s, d: ingest.dedup_richest(raw(s, d).withColumn("fingerprint", text.fingerprint(F.col("title"), F.col("company"), F.col("location")))).select("raw_id", "fingerprint"),
    f"SELECT raw_id, fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY length(description) DESC, raw_id) AS nth FROM (SELECT *, {_FP} AS fingerprint FROM postings_raw)) WHERE nth = 1",
)
add(
    "dedup_documents",
    lambda s, d: ingest.nth_by(s.read.parquet(f"{d}/documents.parquet").withColumn("fp", F.sha1(F.lower(text.clean_text(F.col("text"))))), ["fp"], [F.length("text").desc(), F.col("doc_id")]).select("doc_id", "fp"),
    f"SELECT doc_id, fp FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY length(text) DESC, doc_id) AS nth FROM (SELECT *, sha1(lower({_CLEAN.format('text')})) AS fp FROM documents)) WHERE nth = 1",
    views=False,
)
add(
    "dedup_first",
    lambda s, d: ingest.dedup_first(raw(s, d).withColumn("external_id", F.expr("cast(raw_id % 500 as string)")).withColumn("external_id", F.when(F.col("raw_id") % 3 > 0, F.col("external_id")))).select("raw_id", "external_id"),
    """SELECT raw_id, external_id FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(external_id, apply_link) ORDER BY raw_id) AS nth
    FROM (SELECT raw_id, apply_link, CASE WHEN raw_id % 3 > 0 THEN CAST(raw_id % 500 AS VARCHAR) END AS external_id FROM postings_raw)) WHERE nth = 1""",
)
add("per_source", lambda s, d: ingest.per_source(raw(s, d)), "SELECT source, count(*) AS n FROM postings_raw GROUP BY 1")
add("profile_funnel", lambda s, d: profiles.profile_funnel(profiles.apply_profile(ingest.ingest(raw(s, d), now()), profiles.CITY_FRESHERS)))
ORACLES["profile_funnel"] = with_views(
    INGEST_CTE,
    f"""SELECT CASE WHEN l <> 0 THEN 'outside_target_city' WHEN experience_min > 1 OR (coalesce(experience_min, 1) <> 0 AND seniority NOT IN ('fresher', 'intern')) THEN 'not_fresher'
    WHEN NOT ({_STARTUP}) THEN 'not_startup' ELSE 'kept' END AS reason, count(*) AS n FROM stored GROUP BY 1""",
)


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every profile, with how many of the ingested postings it keeps."""
    rows = ingest.ingest(raw(spark, sf_dir), now())
    out = profiles.catalogue(spark).withColumn("queries", joined("queries"))
    kept = [profiles.profile_kept(profiles.apply_profile(rows, p)).agg(F.lit(key).alias("key"), F.count("*").alias("kept")) for key, p in profiles.PROFILES.items()]
    return out.join(boards.union_all(kept), "key")


add("profile_catalogue", lambda s, d: _profiles(s, d).select("key", "location", "query_count", "max_experience_years", "require_startup", "kept"))
ORACLES["profile_catalogue"] = with_views(
    INGEST_CTE,
    f"""SELECT '{profiles.CITY_FRESHERS.key}' AS key, '{profiles.CITY_FRESHERS.location}' AS location, {len(vocab.FRESHER_QUERIES)} AS query_count, {profiles.CITY_FRESHERS.max_experience_years} AS max_experience_years, true AS require_startup,
    count(*) FILTER (l = 0 AND NOT (coalesce(experience_min, 0) > 1 OR (coalesce(experience_min, 1) <> 0 AND seniority NOT IN ('fresher', 'intern'))) AND ({_STARTUP})) AS kept FROM stored""",
)
_META = {"category": sorted(vocab.CATEGORIES), "seniority": vocab.SENIORITY_LEVELS, "work_mode": vocab.WORK_MODES, "skills": sorted(vocab.SKILLS)}


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that a search can ask for, with how many active postings have each."""
    known = spark.createDataFrame([(kind, value) for kind, values in _META.items() for value in values], "facet string, value string")
    p = postings(spark, sf_dir).where("is_active")
    return known.join(facets.counted(p.select(F.explode(facets.entries(p)).alias("e")), 1), ["facet", "value"], "left").select(F.col("facet").alias("kind"), "value", F.coalesce("n", F.lit(0)).alias("n"))


add("meta_catalogue", _meta)
ORACLES["meta_catalogue"] = with_views(
    "known AS (" + " UNION ALL ".join(f"SELECT '{kind}' AS kind, unnest({values}) AS value" for kind, values in _META.items()) + """),
    has AS (SELECT 'skills' AS kind, unnest(skills) AS value FROM postings WHERE is_active UNION ALL SELECT 'category', category FROM postings WHERE is_active UNION ALL SELECT 'seniority', seniority FROM postings WHERE is_active UNION ALL SELECT 'work_mode', work_mode FROM postings WHERE is_active)""",
    "SELECT kind, value, (SELECT count(*) FROM has WHERE has.kind = known.kind AND has.value = known.value) AS n FROM known",
)

# ------------------------------------------------------------------ lifecycle

_STATE = ["id", "is_active", "expired_at", "expiry_reason", "last_seen_at", "last_checked_at", "check_failures"]


def _state(df: DataFrame) -> DataFrame:
    return df.select(*_STATE)


def _state_sql(source: str = "postings", **changed: str) -> str:
    return "SELECT " + ", ".join(f"{changed[c]} AS {c}" if c in changed else c for c in _STATE) + f" FROM {source}"


_stale = f"is_active AND last_seen_at < {NOW_SQL} - INTERVAL 21 DAY"
_aged = f"is_active AND coalesce(posted_at < {NOW_SQL} - INTERVAL 60 DAY, false)"
_old = f"NOT is_active AND last_seen_at < {NOW_SQL} - INTERVAL 60 DAY"
_exp = f"NOT is_active AND coalesce(expired_at < {NOW_SQL} - INTERVAL 3 DAY, false)"


def _retired_sql(hit: str, reason: str, source: str = "postings") -> str:
    return _state_sql(source, is_active=f"is_active AND NOT ({hit})", expired_at=f"CASE WHEN {hit} THEN {NOW_SQL} ELSE expired_at END", expiry_reason=f"CASE WHEN {hit} THEN '{reason}' ELSE expiry_reason END")


add("deactivate_stale", lambda s, d: _state(lifecycle.deactivate_stale(postings(s, d), now())), _state_sql(is_active=f"is_active AND NOT ({_stale})"))
add("expire_aged_out", lambda s, d: _state(lifecycle.expire_aged_out(postings(s, d), now())), _retired_sql(_aged, "aged_out"))
add("purge_old", lambda s, d: _state(lifecycle.purge_old(postings(s, d), now())), f"{_state_sql()} WHERE NOT ({_old})")
add("purge_expired", lambda s, d: _state(lifecycle.purge_expired(postings(s, d), now())), f"{_state_sql()} WHERE NOT ({_exp})")
_HOUSE = f"""fresh AS (SELECT * REPLACE (is_active AND NOT ({_stale}) AS is_active) FROM postings),
aged AS (SELECT * REPLACE (is_active AND NOT ({_aged}) AS is_active, CASE WHEN {_aged} THEN {NOW_SQL} ELSE expired_at END AS expired_at, CASE WHEN {_aged} THEN 'aged_out' ELSE expiry_reason END AS expiry_reason) FROM fresh),
housed AS (SELECT * FROM aged WHERE NOT ({_old}) AND NOT ({_exp}))"""
add("housekeeping", lambda s, d: _state(lifecycle.housekeeping(postings(s, d), now())))
ORACLES["housekeeping"] = with_views(_HOUSE, _state_sql("housed"))
add("expire_ids", lambda s, d: _state(lifecycle.expire_ids(postings(s, d), s.range(0, 2000, 3), "rejected", now())), _retired_sql("is_active AND id < 2000 AND id % 3 = 0", "rejected"))


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir)
    new = p.where("id % 2 = 0").withColumn("description", F.expr("case when id % 6 = 0 then '' else 'New text' end")).withColumn("posted_at", F.expr("case when id % 10 = 0 then null else posted_at end"))
    return lifecycle.upsert(p.where("id % 3 <> 0"), new.select(*ingest.PAYLOAD), now())


_UPSERT = f"""old AS (SELECT * FROM postings WHERE id % 3 <> 0), new AS (SELECT * REPLACE (CASE WHEN id % 6 = 0 THEN '' ELSE 'New text' END AS description, CASE WHEN id % 10 = 0 THEN NULL ELSE posted_at END AS posted_at) FROM postings WHERE id % 2 = 0),
ins AS (SELECT *, (SELECT max(id) FROM old) + row_number() OVER (ORDER BY fingerprint) AS new_id FROM new WHERE fingerprint NOT IN (SELECT fingerprint FROM old)),
merged AS (
  SELECT new_id AS id, fingerprint, description, posted_at, {NOW_SQL} AS first_seen_at, {NOW_SQL} AS last_seen_at, true AS is_active, CAST(NULL AS TIMESTAMP) AS expired_at, '' AS expiry_reason, 0 AS check_failures, CAST(NULL AS TIMESTAMP) AS last_checked_at, 'insert' AS action FROM ins
  UNION ALL SELECT o.id, o.fingerprint, CASE WHEN n.id IS NULL OR n.description = '' THEN o.description ELSE n.description END, CASE WHEN n.id IS NULL THEN o.posted_at ELSE coalesce(n.posted_at, o.posted_at) END, o.first_seen_at,
    CASE WHEN n.id IS NULL THEN o.last_seen_at ELSE {NOW_SQL} END, n.id IS NOT NULL OR o.is_active, CASE WHEN n.id IS NULL THEN o.expired_at END, CASE WHEN n.id IS NULL THEN o.expiry_reason ELSE '' END,
    CASE WHEN n.id IS NULL THEN o.check_failures ELSE 0 END, o.last_checked_at, CASE WHEN n.id IS NULL THEN 'keep' ELSE 'update' END FROM old o LEFT JOIN new n ON o.fingerprint = n.fingerprint)"""
_MERGED = ["id", "fingerprint", "description", "posted_at", "first_seen_at", "last_seen_at", "is_active", "expired_at", "expiry_reason", "check_failures", "last_checked_at", "action"]
add("upsert", lambda s, d: _halves(s, d).select(*_MERGED))
ORACLES["upsert"] = with_views(_UPSERT, f"SELECT {', '.join(_MERGED)} FROM merged")
add("upsert_metrics", lambda s, d: lifecycle.tallies(_halves(s, d)))
ORACLES["upsert_metrics"] = with_views(_UPSERT, "SELECT count(*) FILTER (action = 'insert') AS created, count(*) FILTER (action = 'update') AS updated FROM merged")


# ------------------------------------------------------------------ the store


def _stored(spark: SparkSession, sf_dir: str, rows: DataFrame) -> Store:
    store = Store(spark, scratch_folder(spark, "store"), 16)
    store.commit(rows)
    return store


def _upserted(spark: SparkSession, sf_dir: str) -> Store:
    """Two thirds of the postings, then two batches with the even ones, some of which have moved to another company."""
    at = scratch_folder(spark, "postings")
    postings(spark, sf_dir).write.parquet(at)  # once for all three
    p = spark.read.parquet(at)
    store = _stored(spark, sf_dir, p.where("id % 3 <> 0"))
    new = p.where("id % 2 = 0").withColumns({"description": F.expr("case when id % 6 = 0 then '' else 'New text' end"), "company": F.expr("case when id % 8 = 0 then 'Moved Ltd' else company end")})
    for part in ("id % 4 = 0", "id % 4 = 2"):
        store.upsert(new.where(part).select(*ingest.PAYLOAD), now())
    return store


_MOVED = f"""postings_before AS (SELECT * FROM postings), after AS (SELECT * REPLACE (CASE WHEN id % 8 = 0 THEN 'Moved Ltd' ELSE company END AS company, is_active OR id % 2 = 0 AS is_active,
  CASE WHEN id % 2 = 0 THEN NULL ELSE expired_at END AS expired_at, CASE WHEN id % 2 = 0 THEN {NOW_SQL} ELSE last_seen_at END AS last_seen_at, CASE WHEN id % 3 = 0 THEN {NOW_SQL} ELSE first_seen_at END AS first_seen_at,
  CASE WHEN id % 2 = 0 AND (id % 6 <> 0 OR id % 3 = 0) THEN CASE WHEN id % 6 = 0 THEN '' ELSE 'New text' END ELSE description END AS description) FROM postings WHERE id % 3 <> 0 OR id % 2 = 0)"""
_KNOWN = ["fingerprint", "company", "description", "is_active", "expired_at", "first_seen_at", "last_seen_at"]
add("store_upsert", lambda s, d: _upserted(s, d).read().select(*_KNOWN))
ORACLES["store_upsert"] = with_views(_MOVED, f"SELECT {', '.join(_KNOWN)} FROM after")
add("store_facets", lambda s, d: _upserted(s, d).facets())
ORACLES["store_facets"] = with_views(_MOVED, _FACETS_SQL.replace("FROM postings", "FROM after"))
add("store_stats", lambda s, d: _upserted(s, d).stats(now()))
ORACLES["store_stats"] = with_views(_MOVED, _STATS_SQL.replace("FROM postings", "FROM after"))
_RARE = Filters(q="Customer#000000007", company="customer")
add("store_search", lambda s, d: slim(search.search(_stored(s, d, postings(s, d)).searched(MAIN), MAIN, now())), f"SELECT {SLIM_SQL} FROM postings WHERE {MAIN_WHERE} ORDER BY posted_at DESC NULLS LAST, id DESC LIMIT 25")
add("store_rare_search", lambda s, d: slim(search.matching(_stored(s, d, postings(s, d)).searched(_RARE), _RARE, now())), f"SELECT {SLIM_SQL} FROM postings WHERE is_active AND contains({BLOB_SQL}, 'customer#000000007') AND contains(lower(company), 'customer')")
add(
    "store_detail",
    lambda s, d: (lambda store: search.detail(store.by_id(store.commit_of().top_id), store.commit_of().top_id).select(*_DETAIL))(_stored(s, d, postings(s, d))),
    f"SELECT {', '.join(_DETAIL)} FROM postings WHERE id = (SELECT max(id) FROM postings)",
)
add("store_housekeeping", lambda s, d: _state((lambda store: (store.rewrite(lambda p: lifecycle.housekeeping(p, now())), store.read())[1])(_stored(s, d, postings(s, d)))))
ORACLES["store_housekeeping"] = with_views(_HOUSE, _state_sql("housed"))


def _reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.reindex(postings(spark, sf_dir), now())


_RE = f"""re AS (SELECT *, {_score_sql()} FROM postings), re2 AS (SELECT *, {CATEGORY_SQL} AS new_category, {YEARS_LOW} AS new_min, {YEARS_HIGH} AS new_max,
  is_active AND (coalesce(({YEARS_LOW}) > 3, false) OR NOT {TECH_SQL}) AS bad FROM re)"""
add("reindex_tallies", lambda s, d: lifecycle.reindex_tallies(_reindexed(s, d)))
ORACLES["reindex_tallies"] = with_views(_RE, "SELECT count(*) AS scanned, count(*) FILTER (new_category IS DISTINCT FROM category) AS reblobbed, count(*) FILTER (new_category IS DISTINCT FROM category) AS recategorised, count(*) FILTER (new_min IS DISTINCT FROM experience_min OR new_max IS DISTINCT FROM experience_max) AS re_experienced, count(*) FILTER (bad) AS retired FROM re2")
add("reindex", lambda s, d: _reindexed(s, d).select("id", "category", "experience_min", "experience_max", "is_active", "expiry_reason"))
ORACLES["reindex"] = with_views(_RE, "SELECT id, new_category AS category, new_min AS experience_min, new_max AS experience_max, is_active AND NOT bad AS is_active, CASE WHEN bad THEN 'rejected' ELSE expiry_reason END AS expiry_reason FROM re2")
add(
    "sync_schema",
    lambda s, d: lifecycle.sync_schema(postings(s, d).select("id", "external_id"), {"external_id": ("string", ""), "check_failures": ("int", 0), "expired_at": ("timestamp_ntz", None)}),
    "SELECT id, coalesce(external_id, '') AS external_id, 0 AS check_failures, CAST(NULL AS TIMESTAMP) AS expired_at FROM postings",
)

# ------------------------------------------------------------------ probes

add(
    "probe_select",
    lambda s, d: probe.due(postings(s, d), now()).select("id", "last_checked_at"),
    f"SELECT id, last_checked_at FROM postings WHERE is_active AND (last_checked_at IS NULL OR last_checked_at < {NOW_SQL} - INTERVAL 24 HOUR) ORDER BY last_checked_at NULLS FIRST, id LIMIT 250",
)
add("probe_url", lambda s, d: postings(s, d).select("id", probe.probe_url(F.col("source"), F.col("external_id"), F.col("apply_link"), "https://api.example/p/").alias("url")),
    "SELECT id, CASE WHEN source = 'linkedin' AND external_id IS NOT NULL THEN 'https://api.example/p/' || external_id ELSE apply_link END AS url FROM postings")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "probes")
    return p.select("id", probe.classify(F.col("status_code"), F.col("final_url"), F.col("probe_url"), F.col("body")).alias("r")).select("id", "r.verdict", "r.reason")


_V = """verdicts AS (SELECT id, CASE WHEN status_code IS NULL THEN 'unknown' WHEN status_code IN (404, 410) THEN 'gone' WHEN status_code >= 400 THEN 'unknown' WHEN away THEN 'gone' WHEN contains(body, 'has been filled') THEN 'gone' WHEN length(body) < 400 THEN 'unknown' ELSE 'alive' END AS verdict,
  CASE WHEN status_code IS NULL THEN 'no_response' WHEN status_code IN (404, 410) THEN 'http_gone' WHEN status_code >= 400 THEN 'http_' || status_code WHEN away THEN 'redirected_away' WHEN contains(body, 'has been filled') THEN 'dead_page' WHEN length(body) < 400 THEN 'thin_page' ELSE 'ok' END AS reason
  FROM (SELECT *, id % 7 = 5 AND probe_url <> '' AS away FROM probes))"""
add("probe_classify", _results)
ORACLES["probe_classify"] = with_views(_V, "SELECT * FROM verdicts")
add("probe_reasons", lambda s, d: probe.reasons(_results(s, d)))
ORACLES["probe_reasons"] = with_views(_V, "SELECT verdict, reason, count(*) AS n FROM verdicts GROUP BY ALL")
add("probe_apply", lambda s, d: _state(lifecycle.apply_probes(postings(s, d), _results(s, d), now())))
_RETIRE = "coalesce(verdict = 'gone' OR (verdict = 'unknown' AND check_failures + 1 >= 3), false)"
_PROBED_SQL = _state_sql(
        "j",
        is_active=f"is_active AND NOT {_RETIRE}",
        expired_at=f"CASE WHEN {_RETIRE} THEN {NOW_SQL} ELSE expired_at END",
        expiry_reason=f"CASE WHEN verdict = 'gone' THEN 'gone' WHEN {_RETIRE} THEN 'unreachable' ELSE expiry_reason END",
        last_seen_at=f"CASE WHEN verdict = 'alive' THEN {NOW_SQL} ELSE last_seen_at END",
        last_checked_at=f"CASE WHEN verdict IS NOT NULL THEN {NOW_SQL} ELSE last_checked_at END",
        check_failures="CASE WHEN verdict IN ('alive', 'gone') THEN 0 WHEN verdict = 'unknown' THEN check_failures + 1 ELSE check_failures END",
    )
ORACLES["probe_apply"] = with_views(f"{_V}, j AS (SELECT p.*, v.verdict FROM postings p LEFT JOIN verdicts v ON p.id = v.id)", _PROBED_SQL)
add("probe_report", lambda s, d: lifecycle.probe_report(postings(s, d), _results(s, d)))
ORACLES["probe_report"] = with_views(_V, f"SELECT count(*) AS checked, count(*) FILTER (verdict = 'alive') AS alive, count(*) FILTER (verdict = 'gone') AS gone, count(*) FILTER (verdict = 'unknown') AS inconclusive, count(*) FILTER ({_RETIRE}) AS retired FROM postings JOIN verdicts USING (id)")
add("maintenance", lambda s, d: _state(lifecycle.maintenance(postings(s, d), _results(s, d), now())[0]))
ORACLES["maintenance"] = with_views(f"{_HOUSE}, {_V}, j AS (SELECT p.*, v.verdict FROM housed p LEFT JOIN verdicts v ON p.id = v.id)", _PROBED_SQL)

# ------------------------------------------------------------------ runs and events


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "runs")


add("runs_progress", lambda s, d: _runs(s, d).select("id", runs.progress(F.col("queries_done"), F.col("queries_total")).alias("progress"), runs.duration(F.col("started_at"), F.col("finished_at")).alias("seconds")),
    "SELECT id, round(CAST(least(queries_done::DOUBLE / queries_total, 1.0) * 100 AS DOUBLE), 1) AS progress, round((epoch_us(finished_at) - epoch_us(started_at)) / 1e6, 2) AS seconds FROM runs")
add("runs_latest", lambda s, d: runs.latest(_runs(s, d), 20).select("id", "status"), "SELECT id, status FROM runs ORDER BY id DESC LIMIT 20")
add("runs_active", lambda s, d: runs.active(_runs(s, d)).select("id", "status"), "SELECT id, status FROM runs WHERE status = 'running' ORDER BY id DESC LIMIT 1")
_CLOCK = "2024-01-01 04:00:00"
add("runs_reap", lambda s, d: runs.reap(_runs(s, d), F.lit(_CLOCK).cast("timestamp_ntz")).select("id", "status", "finished_at"),
    f"SELECT id, CASE WHEN r THEN 'failed' ELSE status END AS status, CASE WHEN r THEN TIMESTAMP '{_CLOCK}' ELSE finished_at END AS finished_at FROM (SELECT *, status = 'running' AND started_at < TIMESTAMP '{_CLOCK}' - INTERVAL 90 MINUTE AS r FROM runs)")
add("events_replay", lambda s, d: runs.replay(view(s, d, "run_events"), 20).select("event_id", "run_id"),
    "SELECT event_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS nth FROM run_events) WHERE nth <= 20")
add("events_prune", lambda s, d: runs.prune(view(s, d, "run_events"), _runs(s, d)).groupBy("run_id").agg(F.count("*").alias("n")),
    "SELECT run_id, count(*) AS n FROM run_events WHERE run_id NOT IN (SELECT id FROM runs WHERE status <> 'running' AND id NOT IN (SELECT id FROM runs WHERE status <> 'running' ORDER BY id DESC LIMIT 10)) GROUP BY 1")
add("event_progress", lambda s, d: runs.event_progress(view(s, d, "run_events").withColumns({"done": F.col("event_id") % 77, "total": F.col("event_id") % 99})),
    "SELECT run_id, max(event_id % 77) AS done, max(event_id % 99) AS total FROM run_events GROUP BY 1")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What new subscribers to all runs are sent: a streaming query over the landed events, with a backlog of 6; every 13th event ends its run."""
    at = scratch_folder(spark, "events")
    events = view(spark, sf_dir, "run_events").withColumn("type", F.expr("case when event_id % 13 = 0 then 'done' else type end"))
    events.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{at}/in")
    tail.start(stream, lambda rows, n: rows.write.mode("overwrite").parquet(f"{at}/out/{n}"), f"{at}/checkpoint", backlog=6).awaitTermination()
    return spark.read.schema(tail.TAILED).option("recursiveFileLookup", "true").parquet(f"{at}/out")


add("events_tail", lambda s, d: _streamed(s, d).select("run_id", "event_id", "nth"),
    """SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS nth FROM (SELECT *, min(CASE WHEN event_id % 13 = 0 THEN back END) OVER (PARTITION BY run_id) AS none,
      max(CASE WHEN event_id % 13 = 0 THEN back END) OVER (PARTITION BY run_id) AS first_done FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS back FROM run_events) WHERE back <= 6)
    WHERE first_done IS NULL OR back >= first_done""")  # fmt: skip
_SIDE = lambda p, c, f: lifecycle.after_run(p, now(), cancelled=c, profile_run=f).agg(F.count_if("is_active").alias("active"), F.count("*").alias("total"))
add("housekeeping_guard", lambda s, d: boards.union_all([_SIDE(postings(s, d), c, f).withColumn("guarded", F.lit(c or f)) for c, f in ((False, False), (True, False), (False, True))]))
ORACLES["housekeeping_guard"] = with_views(_HOUSE, "SELECT count(*) FILTER (is_active) AS active, count(*) AS total, false AS guarded FROM housed UNION ALL (SELECT count(*) FILTER (is_active), count(*), true FROM postings, range(2) GROUP BY range)")
add("dashboard", lambda s, d: facets.with_last_run(facets.stats(postings(s, d), now()), _runs(s, d)).select("total", "active", "companies", F.col("last_run.id").alias("last_run"), F.col("last_run.status").alias("last_status")),
    "SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(DISTINCT company) FILTER (is_active) AS companies, (SELECT max(id) FROM runs) AS last_run, (SELECT status FROM runs ORDER BY id DESC LIMIT 1) AS last_status FROM postings")
add("failure_streaks", lambda s, d: runs.failure_streaks(s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("id"), (F.col("ts") + F.make_dt_interval(secs=F.col("event_id") / 1e6)).alias("ts"), F.when(F.col("event_type") == "error", "unknown").otherwise("alive").alias("verdict"))).groupBy("id").agg(F.max("streak").alias("longest")),
    """SELECT id, max(streak) AS longest FROM (SELECT id, sum(f) OVER (PARTITION BY id, block ORDER BY ts, event_id) AS streak FROM (
    SELECT *, sum(1 - f) OVER (PARTITION BY id ORDER BY ts, event_id) AS block FROM (SELECT user_id AS id, ts, event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f FROM events))) GROUP BY id""", views=False)  # fmt: skip

# ------------------------------------------------------------------ sources

add("html_text", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", html_text.html_to_text(F.col("html")).alias("text")))
_CARD = "<div class=\"base-card\" data-entity-urn=\"urn:li:jobPosting:{0}\"><h3 class=\"base-search-card__title\"> {1} </h3><h4 class=\"base-search-card__subtitle\">{2}</h4><span class=\"job-search-card__location\">{3}</span><a class=\"base-card__full-link\" href=\"/jobs/view/x-{0}?trk=1\">go</a><time datetime=\"2024-05-01\">x</time></div>"


def _card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = re.split(r"\{(\d)\}", _CARD)
    columns = [F.col("raw_id").cast("string"), F.col("title"), F.col("company"), F.col("location")]
    return raw(spark, sf_dir).select(F.col("raw_id").alias("page_id"), F.concat(*[columns[int(p)] if k % 2 else F.lit(p) for k, p in enumerate(parts)]).alias("html"))


add("html_cards", lambda s, d: boards.linkedin_cards(_card_pages(s, d), now()).select("external_id", "title", "company", "location", "apply_link", "posted_at"),
    "SELECT CAST(raw_id AS VARCHAR) AS external_id, title, company, location, 'https://www.linkedin.com/jobs/view/x-' || raw_id AS apply_link, TIMESTAMP '2024-05-01' AS posted_at FROM postings_raw")


def _board_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda kind, c: F.struct(F.lit(kind).alias("type"), F.col(c).alias("label"))
    item = F.struct(
        F.col("raw_id").cast("string").alias("jobId"), "title", F.col("company").alias("companyName"), F.col("apply_link").alias("jdURL"), F.array(place("Location", "location"), place("experience", "experience_text"), place("salary", "salary_text")).alias("placeholders"),
        F.unix_millis(F.col("posted_at").cast("timestamp")).alias("createdDate"), F.lit("3 days ago").alias("footerPlaceholderLabel"), F.col("description").alias("jobDescription"), F.col("tags").alias("tagsAndSkills"),
    )
    return raw(spark, sf_dir).select(F.to_json(F.struct(F.array(item).alias("jobDetails"))).alias("body"))


add(
    "json_scan",
    lambda s, d: boards.naukri_json(_board_json(s, d), now()).select("external_id", "title", "location", "experience_text", "apply_link", "posted_at", joined("declared_skills").alias("tags")),
    f"SELECT CAST(raw_id AS VARCHAR) AS external_id, title, location, experience_text, split_part(apply_link, '?', 1) AS apply_link, coalesce(posted_at, {NOW_SQL} - INTERVAL 3 DAY) AS posted_at, replace(tags, ',', '|') AS tags FROM postings_raw WHERE apply_link <> ''",
)
add(
    "json_props",
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")),
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    views=False,
)
add("jsonl_export", lambda s, d: jsonl.export_rows(postings(s, d)).select("title", "company", "apply_link", "posted_at", "scraped_at"),
    "SELECT title, company, apply_link, strftime(posted_at, '%Y-%m-%dT%H:%M:%S+00:00') AS posted_at, strftime(first_seen_at, '%Y-%m-%dT%H:%M:%S+00:00') AS scraped_at FROM postings WHERE is_active")
_SHEET = "<div class=\"srp-jobtuple-wrapper\"><a class=\"title\" href=\"/job-listings-{1}-12345{0}?x=1\">{1}</a><a class=\"comp-name\">{2}</a><span class=\"loc-wrap\"><span>{3}</span></span><span class=\"expwdth\">0-2 Yrs</span><ul class=\"tags-gt\"><li>Go</li><li>SQL</li></ul><span class=\"job-post-day\">2 days ago</span></div>"


def _filled(spark: SparkSession, sf_dir: str, template: str, rows: DataFrame | None = None) -> DataFrame:
    """page_id, html of a page for each raw posting."""
    parts = re.split(r"\{(\d)\}", template)
    columns = [F.col("raw_id").cast("string"), F.col("title"), F.col("company"), F.col("location"), F.col("description")]
    rows = raw(spark, sf_dir) if rows is None else rows
    return rows.withColumns({"page_id": F.col("raw_id"), "html": F.concat(*[columns[int(p)] if k % 2 else F.lit(p) for k, p in enumerate(parts)])})


add("sheet_cards", lambda s, d: boards.naukri_cards(_filled(s, d, _SHEET).select("page_id", "html"), now()).select("page_id", "external_id", "title", "company", "location", "experience_text", "posted_at", joined("declared_skills").alias("tags")),
    f"SELECT CAST(raw_id AS VARCHAR) AS page_id, CASE WHEN raw_id >= 100 THEN '12345' || raw_id END AS external_id, title, company, location, '0-2 Yrs' AS experience_text, {NOW_SQL} - INTERVAL 2 DAY AS posted_at, 'Go|SQL' AS tags FROM postings_raw")
_DETAIL_PAGE = "<div class=\"show-more-less-html__markup\"><p>{4}</p></div><li class=\"description__job-criteria-item\"><h3 class=\"description__job-criteria-subheader\">Seniority level</h3><span class=\"description__job-criteria-text\">Associate</span></li>"
add(
    "detail_pages",
    lambda s, d: boards.attach_details(
        raw(s, d).select(F.col("raw_id").cast("string").alias("external_id"), F.lit("").alias("description"), F.col("experience_text")),
        boards.linkedin_details(_filled(s, d, _DETAIL_PAGE, raw(s, d).where("raw_id % 2 = 0")).select(F.col("raw_id").cast("string").alias("external_id"), "html")),
    ).select("external_id", F.trim("description").alias("description"), "experience_text"),
    "SELECT CAST(raw_id AS VARCHAR) AS external_id, CASE WHEN raw_id % 2 = 0 THEN trim(regexp_replace(description, '\\s+', ' ', 'g')) ELSE '' END AS description, CASE WHEN raw_id % 2 = 0 THEN 'Associate' ELSE experience_text END AS experience_text FROM postings_raw",
)


def _landed(spark: SparkSession, sf_dir: str) -> str:
    """Pages of ten cards by title, as a fetcher would have landed them; the third page of every second title is empty."""
    nth = F.row_number().over(Window.partitionBy("t").orderBy("raw_id"))
    cards = _filled(spark, sf_dir, _CARD).withColumn("page", F.ceil(nth / 10).cast("int")).where("page <= 5")
    empty = (F.col("t") % 2 == 0) & (F.col("page") == 3)
    at = scratch_folder(spark, "landed")
    pages = cards.groupBy(F.col("t").cast("string").alias("query"), "page").agg(F.when(F.first(empty), "<p>none</p>").otherwise(F.array_join(F.sort_array(F.collect_list("html")), "")).alias("html"))
    pages.repartition("query", "page").write.partitionBy("query", "page").text(at)
    return at


def _fetched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return paged.SOURCES["linkedin"].fetch(spark, _landed(spark, sf_dir), [str(t) for t in range(8)], now())


_PAGED = "paged AS (SELECT *, CAST(ceil(nth / 10.0) AS INT) AS page FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY raw_id) AS nth FROM postings_raw)), seen AS (SELECT * FROM paged WHERE page <= 4 AND (t % 2 = 1 OR page < 3))"
add("paged_cards", lambda s, d: _fetched(s, d)[0].select("query", "page", "external_id", "title"))
ORACLES["paged_cards"] = with_views(_PAGED, "SELECT CAST(t AS VARCHAR) AS query, page, CAST(raw_id AS VARCHAR) AS external_id, title FROM seen")
add("paged_report", lambda s, d: _fetched(s, d)[1])
ORACLES["paged_report"] = with_views(_PAGED, "SELECT 'linkedin' AS source, CAST(t AS VARCHAR) AS query, page, CASE WHEN t % 2 = 0 AND page = 3 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN t % 2 = 0 AND page = 3 THEN 0 ELSE count(*) END AS cards FROM paged WHERE page <= 4 AND (t % 2 = 1 OR page <= 3) GROUP BY t, page")
add("sources_union", lambda s, d: ingest.per_source(boards.union_all([boards.linkedin_cards(_filled(s, d, _CARD).select("page_id", "html"), now()), boards.naukri_cards(_filled(s, d, _SHEET).select("page_id", "html"), now())])),
    "SELECT 'linkedin' AS source, count(*) AS n FROM postings_raw UNION ALL SELECT 'naukri', count(*) FROM postings_raw")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported rows as a file of JSON Lines, in which every 50th line is broken."""
    rows = postings(spark, sf_dir)
    record = F.to_json(F.struct("title", "company", F.col("apply_link"), F.col("skills"), F.date_format("posted_at", "yyyy-MM-dd").alias("scraped_at")))
    at = scratch_folder(spark, "lines")
    rows.select(F.when(F.col("id") % 50 == 0, F.concat(F.lit("!"), record)).otherwise(record)).write.text(at)
    return jsonl.read(spark, at)


add("jsonl_import", lambda s, d: jsonl.to_raw(_lines(s, d)).select("title", "company", "apply_link", joined("declared_skills").alias("tags")), "SELECT title, company, apply_link, array_to_string(skills, '|') AS tags FROM postings WHERE id % 50 <> 0")
add("jsonl_malformed", lambda s, d: jsonl.malformed(_lines(s, d)).select("malformed"), "SELECT count(*) AS malformed FROM postings WHERE id % 50 = 0")
_CATALOGUE = profiles.resolve_queries(None, 12)


def _asked_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search catalogue, with how many raw postings have each query's words in their title."""
    titles = raw(spark, sf_dir).groupBy(F.lower("title").alias("t")).agg(F.count("*").alias("n"))
    hits = titles.select("n", F.explode(F.filter(F.array(*[F.lit(q) for q in _CATALOGUE]), lambda q: F.col("t").contains(q))).alias("query"))
    known = spark.createDataFrame(list(enumerate(_CATALOGUE)), "nth int, query string")
    return known.join(hits.groupBy("query").agg(F.sum("n").alias("n")), "query", "left").select("nth", "query", F.coalesce("n", F.lit(0)).alias("n"))


add("search_queries", _asked_titles, f"SELECT CAST(k - 1 AS INT) AS nth, q[k] AS query, (SELECT count(*) FROM postings_raw WHERE contains(lower(title), q[k])) AS n FROM (SELECT {_CATALOGUE} AS q, unnest(range(1, {len(_CATALOGUE) + 1})) AS k)")
