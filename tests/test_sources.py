"""Paged sources, live events and whole runs."""

import os
import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from sievelake.operators import facets, ingest, lifecycle, profiles, runs, scrape
from sievelake.plans import catalog
from sievelake.sources import boards, html_text, paged
from sievelake.sources.markers import Lease
from sievelake.sources.store import Store
from sievelake.streaming import ingest as streaming
from sievelake.streaming import tail

SF = "/root/testdata/sf0.001"
CARD = '<div class="base-card" data-entity-urn="urn:li:jobPosting:{0}"><h3 class="base-search-card__title">Dev {0}</h3><a class="base-card__full-link" href="/jobs/view/x-{0}">go</a></div>'


def land(root, pages):
    """pages: {(query, page): bytes}."""
    for (q, p), body in pages.items():
        at = root / f"query={q}" / f"page={p}"
        at.mkdir(parents=True)
        (at / "page.html").write_bytes(body if isinstance(body, bytes) else body.encode())


def cards(*ids):
    return "<html>" + "".join(CARD.format(i) for i in ids) + "</html>"


@pytest.fixture
def landed(tmp_path):
    land(
        tmp_path / "in",
        {("a b", 1): cards(1, 2), ("a b", 2): cards(3), ("a b", 3): "<p>nothing</p>", ("a b", 4): cards(99), ("c", 1): cards(4), ("c", 3): cards(98), ("d", 1): "", ("d", 2): cards(97), ("e", 1): cards(5), ("e", 2): b"\xff\xfe\x00bad", ("e", 3): cards(96), ("z", 1): cards(95)},
    )
    return str(tmp_path / "in")


def test_pages_end_before_the_first_empty_one(spark, landed):
    source = paged.SOURCES["linkedin"]
    assert source.plan(["a b", "c"]) == 8
    said = []
    raw, report = source.fetch(spark, landed, ["a b", "c", "d", "e", "nothing landed", "c"], catalog.now(), report=lambda n, text: said.append(text))
    assert sorted((r.query, r.page, r.external_id) for r in raw.collect()) == [("a b", 1, "1"), ("a b", 1, "2"), ("a b", 2, "3"), ("c", 1, "4"), ("e", 1, "5")]
    want = [("a b", 1, "ok", 2), ("a b", 2, "ok", 1), ("a b", 3, "empty", 0), ("c", 1, "ok", 1), ("e", 1, "ok", 1), ("e", 2, "malformed", 0)]
    assert sorted((r.query, r.page, r.status, r.cards) for r in report.collect()) == want and len(said) == len(want)


def test_later_pages_are_not_opened(spark, landed):
    """A page after the end of its query may be unreadable: nobody reads it."""
    for q, p in (("a b", 4), ("c", 3), ("d", 2), ("e", 3), ("z", 1)):
        os.chmod(f"{landed}/query={q}/page={p}/page.html", 0)
    opened = []
    read_page = paged.BoardSource._read_page
    try:
        paged.BoardSource._read_page = lambda self, s, paths, *a: opened.extend(paths) or read_page(self, s, paths, *a)
        raw, _ = paged.SOURCES["linkedin"].fetch(spark, landed, ["a b", "c", "d", "e"], catalog.now())
    finally:
        paged.BoardSource._read_page = read_page
    assert raw.count() == 5 and len(opened) == 6 and not any("query=z" in p or "page=4" in p for p in opened)


def test_a_cancelled_fetch_keeps_what_was_read(spark, landed):
    asked = []
    raw, report = paged.SOURCES["linkedin"].fetch(spark, landed, ["a b", "c"], catalog.now(), cancelled=lambda: len(asked) >= 1 or bool(asked.append(1)))
    assert sorted(r.external_id for r in raw.collect()) == ["1", "2", "4"] and {r.page for r in report.collect()} == {1}
    none, _ = paged.SOURCES["linkedin"].fetch(spark, landed, ["a b"], catalog.now(), cancelled=lambda: True)
    assert none.count() == 0 and none.columns == raw.columns


def test_a_source_that_fails_is_left_out(spark, landed):
    raw, report = paged.fetch_all(spark, {"linkedin": landed, "naukri": landed + "/missing"}, ["c"], catalog.now())
    assert [r.external_id for r in raw.collect()] == ["4"]
    assert {(r.source, r.status.split(":")[0]) for r in report.collect()} == {("linkedin", "ok"), ("naukri", "failed")}
    with pytest.raises(ValueError):
        paged.fetch_all(spark, {"naukri": landed + "/missing"}, ["c"], catalog.now())


# ------------------------------------------------------------------ live events

START = datetime(2024, 1, 1)
EVENTS = "run_id long, event_id long, ts timestamp_ntz, type string, message string"


def publish(spark, path, run_id, ids, done=()):
    """One file of events, in the order of their numbers."""
    rows = [(run_id, i, START + timedelta(seconds=i), "done" if i in done else "log", f"m{i}") for i in ids]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(EVENTS).parquet(path)


def test_a_tail_goes_on_and_ends_with_its_run(spark, tmp_path):
    at, ck, got = str(tmp_path / "e"), str(tmp_path / "ck"), []
    publish(spark, at, 1, range(30))
    publish(spark, at, 2, range(100, 105))
    assert not tail.follow(stream(spark, at), 1, got.extend, ck, backlog=8, queue=5)
    # What was there before: the last of it; the rest counts as dropped.
    assert [r.event_id for r in got] == list(range(22, 30)) and got[-1].dropped == 22
    publish(spark, at, 1, range(30, 34))
    assert not tail.follow(stream(spark, at), 1, got.extend, ck, backlog=8, queue=5)
    # A slow reader misses what no longer fits: the last of what came.
    publish(spark, at, 1, range(34, 42))
    assert not tail.follow(stream(spark, at), 1, got.extend, ck, backlog=8, queue=5)
    assert [r.event_id for r in got] == list(range(22, 39)) and got[-1].dropped == 25 and [r.nth for r in got] == list(range(1, 18))
    publish(spark, at, 1, range(42, 47), done=[44])
    assert tail.follow(stream(spark, at), 1, got.extend, ck, backlog=8, queue=5)
    assert [r.event_id for r in got][-3:] == [42, 43, 44] and got[-1].type == "done"
    publish(spark, at, 1, range(47, 49))
    n = len(got)
    tail.follow(stream(spark, at), 1, got.extend, ck, backlog=8, queue=5)
    assert len(got) == n
    # Another subscriber has a state of its own, and finds the end in what was before.
    late = []
    assert tail.follow(stream(spark, at), 1, late.extend, str(tmp_path / "ck2"))
    assert [r.event_id for r in late] == list(range(45))


def test_a_tail_that_failed_delivers_the_batch_again_and_no_other(spark, tmp_path):
    at, ck, got = str(tmp_path / "e"), str(tmp_path / "ck"), []
    publish(spark, at, 7, range(5))
    assert not tail.follow(stream(spark, at), 7, got.extend, ck)
    publish(spark, at, 7, range(5, 9), done=[8])

    def fails(rows):
        raise RuntimeError("the reader went away")

    with pytest.raises(Exception, match="reader went away"):
        tail.follow(stream(spark, at), 7, fails, ck)
    assert tail.follow(stream(spark, at), 7, got.extend, ck)
    assert [r.event_id for r in got] == list(range(9)) and [r.nth for r in got] == list(range(1, 10))


# ------------------------------------------------------------------ runs


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("raw") / "r")
    catalog.raw(spark, SF).write.parquet(at)
    return spark.read.parquet(at)


def test_a_run_counts_what_it_did(spark, tmp_path, raw):
    empty, now = catalog.postings(spark, SF).limit(0), catalog.now()
    store = Store(spark, str(tmp_path / "s"), 4)
    stats = scrape.run_once(store, raw, now, 0.0, empty)
    marked = ingest.classify(raw, now)
    assert stats["jobs_seen"] == raw.count() and stats["rejections"] == {r.reject_reason: r.n for r in ingest.rejections(marked).collect()}
    assert stats["jobs_rejected"] == sum(stats["rejections"].values()) and stats["jobs_new"] == stats["jobs_kept"] == ingest.ingest(raw, now).count()
    again = scrape.run_once(store, raw, now, 10.0, empty)
    assert (again["jobs_new"], again["jobs_updated"]) == (0, stats["jobs_new"])
    held = Lease(store.markers).acquire(20.0)
    with pytest.raises(scrape.Busy):
        scrape.run_once(store, raw, now, 30.0, empty)
    Lease(store.markers).release(held)
    schema = "id long, status string, trigger string, sources array<string>, queries_total int, queries_done int, started_at timestamp_ntz, finished_at timestamp_ntz, duration_seconds double, error string, stats string, jobs_seen int, jobs_new int, jobs_updated int, jobs_rejected int"
    one = runs.create(spark.createDataFrame([], schema), ["naukri"], "cli", now, {"profile": "x"})
    assert one.first().stats == '{"profile": "x"}' and one.first().jobs_seen == 0
    done = runs.finish(one, 1, "completed", now, stats=stats).first()
    assert (done.jobs_seen, done.jobs_new, done.jobs_updated, done.jobs_rejected) == (stats["jobs_seen"], stats["jobs_new"], 0, stats["jobs_rejected"])
    assert runs.finish(one, 1, "failed", now, "oops").first().stats == '{"profile": "x"}'
    last = facets.with_last_run(store.stats(now), runs.finish(one, 1, "completed", now, stats=stats)).first()
    assert last.last_run.jobs_new == stats["jobs_new"] and facets.with_last_run(store.stats(now), one.limit(0)).first().last_run is None


def test_a_profile_run_merges_its_rejections_and_keeps_no_house(spark, tmp_path, raw):
    now, empty = catalog.now(), catalog.postings(spark, SF).limit(0)
    store = Store(spark, str(tmp_path / "s"), 4)
    old = catalog.postings(spark, SF).withColumn("last_seen_at", F.lit("2020-01-01").cast("timestamp_ntz"))
    store.commit(old)
    stats = scrape.run_once(store, raw, now, 0.0, empty, profile=profiles.CITY_FRESHERS)
    funnel = {r.reason: r.n for r in profiles.profile_funnel(profiles.apply_profile(ingest.ingest(raw, now), profiles.CITY_FRESHERS)).collect()}
    kept = funnel.pop("kept", 0)
    assert stats["jobs_kept"] == kept and {r: stats["rejections"][r] for r in funnel} == funnel and "not_tech" in stats["rejections"]
    assert store.read().where("last_seen_at = '2020-01-01'").count() > 0  # no housekeeping
    scrape.run_once(store, raw.limit(0), now, 100.0, empty, cancelled=True)
    assert store.read().where("last_seen_at = '2020-01-01'").count() > 0
    scrape.run_once(store, raw.limit(0), now, 200.0, empty)
    assert store.read().where("last_seen_at = '2020-01-01' and not is_active").count() == 0 < store.read().count() + 1


def test_a_cancelled_stream_keeps_its_batches_and_goes_on(spark, tmp_path, raw):
    raw.repartition(3).write.parquet(str(tmp_path / "landed"))
    empty, now = catalog.postings(spark, SF).limit(0), catalog.now()
    store, asked = Store(spark, str(tmp_path / "s"), 4), []
    go = lambda cancelled: streaming.finished(streaming.stream_upsert(streaming.read_landed(spark, str(tmp_path / "landed"), raw.schema, files_per_batch=1), store, empty, now, str(tmp_path / "ck"), cancelled=cancelled))
    assert not go(lambda: len(asked) >= 1 or bool(asked.append(1)))
    assert store.versions() == [1] and 0 < store.read().count()
    assert go(lambda: False)
    whole = lifecycle.upsert(empty, ingest.ingest(raw, now), now)
    assert {r.fingerprint for r in store.read().collect()} == {r.fingerprint for r in whole.collect()} and store.versions() == [1, 2, 3]


def test_cancel_stops_the_jobs_of_one_run(spark, tmp_path, raw):
    empty, now = catalog.postings(spark, SF).limit(0), catalog.now()
    store = Store(spark, str(tmp_path / "s"), 4)
    store.commit(catalog.postings(spark, SF))

    def slow(batches):
        for b in batches:
            time.sleep(60)
            yield b

    stuck, caught = raw.limit(20).mapInPandas(slow, raw.schema), []

    def run():
        with scrape.jobs_of(spark, 7):
            try:
                scrape.run_once(store, stuck, now, 0.0, empty)
            except Exception as e:
                caught.append(str(e))

    thread = InheritableThread(target=run)
    began = time.time()
    thread.start()
    while not spark.sparkContext.statusTracker().getActiveJobsIds():
        time.sleep(0.1)
    time.sleep(1)
    scrape.cancel(spark, 8)  # another run's
    assert thread.is_alive()
    scrape.cancel(spark, 7)
    thread.join(45)
    assert caught and "cancel" in caught[0].lower() and time.time() - began < 50
    assert store.versions() == [1] and Lease(store.markers).acquire(1.0) is not None  # the lease was given back


def test_only_the_best_row_of_each_task_travels(spark, tmp_path, raw):
    """One wide row for a fingerprint and task crosses the shuffle, and the most frequent values of a task."""
    plan = ingest.dedup_richest(raw.withColumn("fingerprint", F.sha1("title")))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange hashpartitioning")[1]
    plan = facets.all_facets(catalog.postings(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert {"Partial", "Final"} <= set(re.findall(r"WindowGroupLimit \[facet[^\n]*(Partial|Final)", plan))


def test_pages_go_to_python_in_small_batches(spark):
    """A worker holds a bounded number of pages, however many a task has."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for make in (lambda: html_text.html_to_text(F.col("html")), lambda: boards._cards(spark.createDataFrame([("1", "<p>")], "page_id string, html string"), list)):
            spark.conf.set(key, "10000")
            make()
            assert int(spark.conf.get(key)) <= html_text.BATCH_PAGES
    finally:
        spark.conf.set(key, before)
