"""Views over the test tables in SQL that Spark and DuckDB share, so both engines start from the same postings.

Only a few words differ between the dialects; they are filled in by sql().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-06-30 00:00:00"
TABLES = ["nation", "customer", "orders", "events", "documents", "pages"]

_DIALECTS = {
    "spark": {"TS": "TIMESTAMP_NTZ", "DIV": "div", "LIST": lambda xs: f"array({', '.join(xs)})" if xs else "CAST(array() AS array<string>)", "SPLIT": "split({0}, '[,|]')"},
    "duckdb": {"TS": "TIMESTAMP", "DIV": "//", "LIST": lambda xs: f"CAST([{', '.join(xs)}] AS VARCHAR[])", "SPLIT": "regexp_split_to_array({0}, '[,|]')"},
}

TITLES = ["Backend Developer", "Frontend Developer", "DevOps Engineer", "Data Analyst", "Sales Executive", "Tech Lead", "Software Engineer Intern", "Graduate Engineer Trainee"]
LOCATIONS = ["Bengaluru, Karnataka", "Pune", "Remote", "", "Hybrid - Hyderabad"]
EXPERIENCE = ["0-2 Yrs", "5+ years", "Fresher", "Mid-Senior level", "", "2 to 5", "Not Applicable"]
SALARIES = ["3-5 Lacs PA", "Not disclosed", "1.5 Cr", ""]
DESCRIPTIONS = [
    "We build backend services with Python, Django and PostgreSQL.  REST APIs run on AWS and are reviewed daily by the whole team of engineers.",
    "Build responsive pages with React and TypeScript. Minimum 4+ years of experience is required for this role.",
    "We are an early-stage startup. Docker, Kubernetes and Terraform are what the founding team uses every single day of the week.",
    "This position has been filled. Thank you for your interest in Java roles.",
    "A 4 year bachelor degree is what we ask of candidates who join this group in the coming season of hiring. You will write Java and JavaScript, and 1-3 years of experience in SQL helps.",
    "",
]
TAGS = ["Python,SQL", "React|Zarnix Suite", "", "Docker", "Java,java,SQL"]


def _case(key: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values[:-1]))
    return f"CASE {key} {arms} ELSE '{values[-1]}' END"


def case_of(key: str, values: list) -> str:
    """CASE over numbered values that are SQL texts already."""
    arms = " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values[:-1]))
    return f"CASE {key} {arms} ELSE {values[-1]} END"


def ctes(dialect: str) -> str:
    """WITH-list of the views, without the WITH."""
    d = _DIALECTS[dialect]
    ts, div, split, lst = d["TS"], d["DIV"], d["SPLIT"], d["LIST"]
    raw = f"""postings_raw AS (
  SELECT o_orderkey AS raw_id, o_custkey % 8 AS t, o_orderkey % 6 AS d, o_orderkey % 5 AS g, o_orderkey % 7 AS x, o_orderkey % 4 AS s, n_nationkey % 5 AS l,
    CASE WHEN o_orderstatus = 'F' THEN 'linkedin' ELSE 'naukri' END AS source,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR(20)) END AS external_id,
    CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE 'https://jobs.example.com/job-listings-' || CAST(o_orderkey AS VARCHAR(20)) || '?src=' || o_orderstatus END AS apply_link,
    {_case("o_custkey % 8", TITLES)} AS title,
    CASE WHEN o_custkey % 10 = 0 THEN 'Infosys Limited' ELSE c_name END AS company,
    {_case("n_nationkey % 5", LOCATIONS)} AS location,
    {_case("o_orderkey % 7", EXPERIENCE)} AS experience_text,
    {_case("o_orderkey % 4", SALARIES)} AS salary_text,
    {_case("o_orderkey % 6", DESCRIPTIONS)} AS description,
    {_case("o_orderkey % 5", TAGS)} AS tags,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE {ts} '{AS_OF}' - INTERVAL '1' DAY * CAST(o_orderkey % 97 AS INT) END AS posted_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""
    no = lst([])
    skills = case_of("g", [lst(["'Python'", "'SQL'"]), lst(["'React'", "'Zarnix Suite'"]), no, lst(["'Docker'"]), lst(["'Java'", "'SQL'"])])
    post = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY title, company, location ORDER BY length(description) DESC, raw_id) AS nth FROM postings_raw
), postings AS (
  SELECT raw_id AS id, md5(title || '|' || company || '|' || location) AS fingerprint, source, external_id, apply_link, title, company, location, description, experience_text, salary_text, posted_at, t, d, g, x, l,
    {case_of("x", ["0", "5", "0", "5", "CAST(NULL AS INT)", "2", "CAST(NULL AS INT)"])} AS experience_min,
    {case_of("x", ["2", "7", "1", "CAST(NULL AS INT)", "CAST(NULL AS INT)", "5", "CAST(NULL AS INT)"])} AS experience_max,
    {case_of("raw_id % 4", ["CAST(300000 AS DOUBLE)", "CAST(NULL AS DOUBLE)", "CAST(15000000 AS DOUBLE)", "CAST(NULL AS DOUBLE)"])} AS salary_min,
    {case_of("raw_id % 4", ["CAST(500000 AS DOUBLE)", "CAST(NULL AS DOUBLE)", "CAST(15000000 AS DOUBLE)", "CAST(NULL AS DOUBLE)"])} AS salary_max,
    {skills} AS skills,
    {case_of("t", ["'Backend'", "'Frontend'", "'DevOps / Cloud / SRE'", "'Data Engineering / Analytics'", "'Other'", "CAST(NULL AS VARCHAR(20))", "'Software Engineering'", "''"])} AS category,
    {lst(["'Backend'"])} AS categories,
    {case_of("t", ["'mid'", "'junior'", "'mid'", "'senior'", "'mid'", "'lead'", "'intern'", "'fresher'"])} AS seniority,
    {case_of("l", ["'onsite'", "'onsite'", "'remote'", "'onsite'", "'hybrid'"])} AS work_mode,
    coalesce(posted_at, {ts} '{AS_OF}' - INTERVAL '1' DAY * 30) AS first_seen_at,
    {ts} '{AS_OF}' - INTERVAL '1' DAY * CAST(raw_id % 70 AS INT) AS last_seen_at,
    raw_id % 4 <> 0 AS is_active,
    CASE WHEN raw_id % 4 <> 0 THEN '' ELSE {case_of("raw_id % 5", ["'aged_out'", "'gone'", "'unreachable'", "'rejected'", "''"])} END AS expiry_reason,
    CASE WHEN raw_id % 4 = 0 AND raw_id % 5 <> 4 THEN {ts} '{AS_OF}' - INTERVAL '1' DAY * CAST(raw_id % 9 AS INT) END AS expired_at,
    CASE WHEN raw_id % 7 = 0 THEN NULL ELSE {ts} '{AS_OF}' - INTERVAL '1' HOUR * CAST((raw_id {div} 11) % 61 AS INT) END AS last_checked_at,
    CAST((raw_id {div} 13) % 3 AS INT) AS check_failures
  FROM ranked WHERE nth = 1
), probes AS (
  SELECT id, {case_of("id % 7", ["200", "404", "410", "403", "CAST(NULL AS INT)", "200", "200"])} AS status_code,
    CASE WHEN id % 7 = 5 THEN 'https://jobs.example.com/search' ELSE apply_link || '&ref=probe' END AS final_url, apply_link AS probe_url,
    CASE WHEN id % 7 = 6 THEN 'thin' WHEN id % 14 = 7 THEN 'Sorry, this position has been filled.' ELSE repeat('A long page about the role. ', 20) END AS body
  FROM postings WHERE is_active
), runs AS (
  SELECT user_id AS id, {case_of("user_id % 5", ["'completed'", "'failed'", "'running'", "'cancelled'", "'completed'"])} AS status, min(ts) AS started_at, max(ts) AS finished_at,
    count(*) AS queries_total, count(CASE WHEN event_type <> 'error' THEN 1 END) AS queries_done FROM events GROUP BY user_id
), run_events AS (SELECT event_id, user_id AS run_id, ts, event_type AS type, props AS message FROM events)"""
    return f"{raw}, {post}"


def plain(terms, but: str = "'|+#.") -> list[str]:
    """The terms that begin and end with a letter or digit and hold none of but: on texts of these, word boundaries say what the matcher's edges say."""
    return sorted({t.lower() for t in terms if t[:1].isalnum() and t[-1:].isalnum() and not set(t) & set(but)})


def varied(titles: list[str], skills: list[str], phrases: list[str], aliases: list[str]) -> str:
    """A view of texts that differ by row: titles of two terms, descriptions of six skills and two phrases, and of many skills on every 40th row.

    Which terms a row gets follows from its number, so both engines make the same texts and everything else has to be computed from them.
    """

    def pick(terms: list[str], k: int, step: int) -> str:
        return f"split_part('{'|'.join(terms)}', '|', CAST(1 + ({k} + raw_id * {step}) % {len(terms)} AS INT))"

    some = " || ', ' || ".join(pick(skills, 7 * k, 2 * k + 1) for k in range(6))
    many = " || ' / ' || ".join(pick(aliases, 5 * k, 11) for k in range(70))
    company = pick(plain(["Nimbus Works", "Infosys", "Blue Staffing", "Orchard Labs", "Deloitte", "Quill Tech", "Placement Point", "Series Labs"]), 0, 1)
    return f"""varied AS (SELECT raw_id, {pick(titles, 0, 1)} || ' - ' || {pick(titles, 3, 7)} AS title, {company} AS company,
    'We need ' || {some} || '. ' || {pick(phrases, 0, 1)} || '. Also ' || {pick(phrases, 5, 3)} || '.' || CASE WHEN raw_id % 40 = 0 THEN ' And ' || {many} ELSE '' END AS description FROM postings_raw)"""


def oracle(select: str) -> str:
    """DuckDB SQL: the views, then the select."""
    return f"WITH {ctes('duckdb')} {select}"


def view(spark: SparkSession, sf_dir: str, name: str, more: str = "") -> DataFrame:
    """One of the views above as a DataFrame; more: further views."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(f"WITH {ctes('spark')}{', ' if more else ''}{more} SELECT * FROM {name}")
