"""Search, facets, ingest, profiles, lifecycle, probes, runs, sources and streaming."""

import json
import numbers

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievelake.operators import facets, ingest, lifecycle, probe, profiles, runs, search
from sievelake.operators.search import Filters
from sievelake.plans import catalog, fixtures
from sievelake.sources import boards, html_text, jsonl
from sievelake.sources.store import Store
from sievelake.streaming import ingest as streaming

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def postings(spark):
    return catalog.postings(spark, SF).cache()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in fixtures.TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda v: "" if pd.isna(v) else str(pd.Timestamp(v)) if hasattr(v, "year") else f"{float(v):.6f}" if isinstance(v, numbers.Number) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", ["search_page", "filter_exp_strict", "sort_posted_at_asc", "facets_all", "ingest", "category_scores", "profile_funnel", "upsert", "maintenance", "posting_detail", "store_upsert", "store_facets", "store_stats", "store_search", "store_rare_search", "store_detail", "store_housekeeping", "housekeeping", "probe_apply", "reindex", "html_cards", "json_scan", "varied_skills", "varied_category_scores", "varied_categories", "varied_secondary_categories", "secondary_categories", "varied_is_tech", "varied_seniority", "varied_work_mode", "varied_looks_dead", "varied_startup", "sheet_cards", "detail_pages", "paged_cards", "paged_report", "sources_union", "jsonl_import", "jsonl_malformed", "event_progress", "events_tail", "housekeeping_guard", "dashboard", "meta_catalogue", "profile_catalogue", "search_queries"])
def test_queries_equal_their_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalog.ORACLES[name]).df())


def test_pages_make_up_the_whole(spark, postings):
    f = Filters(source=["naukri"])
    n = search.total(postings, f, catalog.now()).first().total
    ids = [r.id for k in range(1, n // 10 + 2) for r in search.search(postings, f, catalog.now(), page=k, size=10).collect()]
    assert len(ids) == len(set(ids)) == n
    assert search.search(postings, f, catalog.now(), page=999, size=10).count() == 0
    plan = search.search(postings, f, catalog.now())._jdf.queryExecution().toString()
    assert "TakeOrdered" in plan


def test_filters_reach_the_scan(spark, tmp_path, postings):
    postings.write.parquet(str(tmp_path / "p"))
    plan = search.matching(spark.read.parquet(str(tmp_path / "p")), Filters(source=["naukri"], max_experience=2), catalog.now()).select("id")._jdf.queryExecution().toString()
    pushed = plan.split("PushedFilters: ")[-1].split("]")[0]
    assert "EqualTo(is_active,true)" in pushed and "EqualTo(source,naukri)" in pushed
    assert "description" not in plan.split("ReadSchema")[-1]


def test_bad_parameters():
    with pytest.raises(ValueError):
        search.ordering("salary")
    with pytest.raises(ValueError):
        Filters(min_experience=31)
    with pytest.raises(ValueError):
        profiles.get_profile("mars-office")
    assert profiles.get_profile("Bangalore_Fresher_Startups") is profiles.CITY_FRESHERS
    assert profiles.resolve_queries(["sdet", " "], None, profiles.CITY_FRESHERS) == ["sdet"]
    assert profiles.resolve_queries(None, 3, profiles.CITY_FRESHERS) == list(profiles.CITY_FRESHERS.queries[:3])
    assert profiles.plan_units(4, {"naukri": 3, "linkedin": 4}) == 28
    with pytest.raises(ValueError):
        boards.resolve_sources(["nowhere"])
    assert boards.resolve_sources(["Naukri", "x"]) == ["naukri"]


def test_facet_sums(postings):
    active = facets.counts(postings).first().active
    assert sum(r.n for r in facets.facet(postings, "source").collect()) == active


def test_upsert_twice_is_upsert_once(spark, postings):
    new = postings.where("id % 2 = 0").select(*ingest.PAYLOAD)
    once = lifecycle.upsert(postings.where("id % 3 <> 0"), new, catalog.now())
    again = lifecycle.upsert(once.drop("action"), new, catalog.now())
    assert lifecycle.tallies(again).first().created == 0
    assert rows(once.drop("action", "skills", "categories").toPandas()) == rows(again.drop("action", "skills", "categories").toPandas())
    empty = postings.limit(0)
    assert lifecycle.tallies(lifecycle.upsert(empty, new, catalog.now())).first().created == new.count()


def test_housekeeping_is_idempotent(postings):
    once = lifecycle.housekeeping(postings, catalog.now())
    assert rows(once.select("id", "is_active", "expiry_reason").toPandas()) == rows(lifecycle.housekeeping(once, catalog.now()).select("id", "is_active", "expiry_reason").toPandas())
    assert lifecycle.maintenance(postings, None, catalog.now())[1] == "disabled"
    assert lifecycle.maintenance(postings, postings, catalog.now(), run_active=True)[1] == "skipped: scrape_running"


def test_probe_classification(spark):
    cases = [
        (None, "u", "u", "", "unknown", "no_response"),
        (404, "u", "u", "", "gone", "http_gone"),
        (403, "u", "u", "", "unknown", "http_403"),
        (200, "https://b/search", "https://b/job/1", "x" * 500, "gone", "redirected_away"),
        (200, "https://b/job/1/", "https://b/job/1", "x" * 500, "alive", "ok"),
        (200, "u", "u", "Position has been filled " + "x" * 500, "gone", "dead_page"),
        (200, "u", "u", "short", "unknown", "thin_page"),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, s int, f string, p string, b string")
    got = df.select("i", probe.classify(F.col("s"), F.col("f"), F.col("p"), F.col("b")).alias("r")).orderBy("i").collect()
    assert [tuple(r.r) for r in got] == [c[4:] for c in cases]


def test_runs(spark):
    schema = "id long, status string, trigger string, sources array<string>, queries_total int, queries_done int, started_at timestamp_ntz, finished_at timestamp_ntz, duration_seconds double, error string"
    none = spark.createDataFrame([], schema)
    assert runs.may_start(none)
    one = runs.create(none, ["naukri"], "cli", catalog.now())
    assert not runs.may_start(one) and runs.active(one).first().id == 1
    later = catalog.now() + F.expr("INTERVAL '95' MINUTE")
    assert runs.reap(one, later).first().status == "failed" and runs.reap(one, catalog.now()).first().status == "running"
    done = runs.finish(one, 1, "completed", later, "e" * 5000).first()
    assert (done.status, done.duration_seconds, len(done.error)) == ("completed", 5700.0, 4000)


def test_ingest_reasons(spark):
    base = dict(raw_id=1, source="s", external_id=None, title="Python Developer", company="C", apply_link="l", location="", experience_text="0-1 Yrs", salary_text="", description="d" * 80, posted_at=None, declared_skills=["Python"])
    cases = [({}, None), ({"title": " "}, "incomplete"), ({"description": "Job expired"}, "dead_listing"), ({"title": "Sales Executive"}, "not_tech"), ({"experience_text": "5-8 Yrs"}, "experience_too_high"), ({"title": "Tech Lead - Python", "experience_text": ""}, "experience_too_high"), ({"posted_at": pd.Timestamp("2024-01-01").to_pydatetime()}, "posting_too_old")]
    schema = "raw_id long, source string, external_id string, title string, company string, apply_link string, location string, experience_text string, salary_text string, description string, posted_at timestamp_ntz, declared_skills array<string>"
    names = [c.split()[0] for c in schema.split(", ")]
    data = [tuple({**base, **change, "raw_id": i}[n] for n in names) for i, (change, _) in enumerate(cases)]
    got = {r.raw_id: r.reject_reason for r in ingest.classify(spark.createDataFrame(data, schema), catalog.now()).collect()}
    assert [got[i] for i in range(len(cases))] == [reason for _, reason in cases]


def test_html():
    assert html_text.to_text("a &lt; b") == "a &lt; b"
    assert html_text.to_text("<p>One <b>two</b></p><script>x</script><p>three&amp;</p>") == "One two three&"
    assert html_text.to_text(None) == ""


def test_detail_pages(spark):
    page = '<div class="show-more-less-html__markup"><p>Body <i>text</i></p></div><ul><li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">Seniority level</h3><span class="description__job-criteria-text">Associate</span></li><li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">Employment type</h3><span class="description__job-criteria-text">Internship</span></li></ul>'
    details = boards.linkedin_details(spark.createDataFrame([("7", page)], "external_id string, html string"))
    cards = spark.createDataFrame([("7", "", ""), ("8", "old", "x")], "external_id string, description string, experience_text string")
    got = {r.external_id: (r.description, r.experience_text) for r in boards.attach_details(cards, details).collect()}
    assert got == {"7": ("Body text", "Associate Internship"), "8": ("old", "x")}


def test_naukri_cards(spark):
    page = '<div class="srp-jobtuple-wrapper"><a class="title" href="/job-listings-dev-12345678?x=1">Dev</a><a class="comp-name">Co</a><span class="loc-wrap"><span>Pune</span></span><span class="expwdth">0-2 Yrs</span><span class="sal-wrap"><span>3 lpa</span></span><span class="job-desc">Do things</span><ul class="tags-gt"><li class="dot-gt">Go</li><li>SQL</li></ul><span class="job-post-day">2 days ago</span></div><div class="srp-jobtuple-wrapper">no title</div>'
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")
    (r,) = boards.naukri_cards(pages, catalog.now()).collect()
    assert (r.external_id, r.title, r.company, r.location, r.experience_text, r.salary_text, r.declared_skills, str(r.posted_at)) == ("12345678", "Dev", "Co", "Pune", "0-2 Yrs", "3 lpa", ["Go", "SQL"], "2024-06-28 00:00:00")


def test_jsonl_round_trip(spark, tmp_path, postings):
    jsonl.export(postings, str(tmp_path / "out"))
    (tmp_path / "out" / "more.json").write_text('\n{"title": "T", "skills": ["a"]}\nnot json\n' + json.dumps({"title": "U", "scraped_at": "2024-05-01"}) + "\n")
    records = jsonl.read(spark, str(tmp_path / "out"))
    raw = jsonl.to_raw(records)
    active = facets.counts(postings).first().active
    assert raw.count() == active + 2
    assert jsonl.malformed(records).first().malformed == 1
    assert raw.where("title = 'U'").first().source == "legacy"


def test_jsonl_partial_lines(spark, tmp_path):
    lines = ['{"title":"A","skills":"notalist","company":7}', '{"title":"B","skills":["x",1]}', '{"title":"C"', "[1]", "5", "  ", "", '{"title":null,"skills":null}', '{"title":"D","skills":{"a":1}} trailing']
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    records = jsonl.read(spark, str(tmp_path / "in.jsonl"))
    assert jsonl.malformed(records).first()[:] == (4, 7)
    raw = {r.title: r for r in jsonl.to_raw(records).collect()}
    assert (raw["A"].declared_skills, raw["A"].company) == ([], "7")
    assert raw["B"].declared_skills == ["x", "1"] and raw[""].declared_skills == []
    assert not {"C", "D"} & set(raw)


def test_store_and_stream(spark, tmp_path):
    raw = catalog.raw(spark, SF)
    raw.repartition(3).write.parquet(str(tmp_path / "landed"))
    empty = catalog.postings(spark, SF).limit(0)
    store = Store(spark, str(tmp_path / "store"))
    landed = streaming.read_landed(spark, str(tmp_path / "landed"), raw.schema, files_per_batch=1)
    streaming.stream_upsert(landed, store, empty, catalog.now(), str(tmp_path / "ck")).awaitTermination()
    batch = lifecycle.upsert(empty, ingest.ingest(raw, catalog.now()), catalog.now())
    assert {r.fingerprint for r in store.read().select("fingerprint").collect()} == {r.fingerprint for r in batch.select("fingerprint").collect()}
    assert len(store.versions()) == 3  # one for each micro-batch; young ones stay for their readers


@pytest.mark.parametrize("name", ["category_scores", "varied_category_scores"])
def test_scores_are_computed_once(spark, name):
    """One pass for skills and three for scores: the filter that Spark puts before inline() must not compute them again."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 4 + plan.count("P{L}+")
