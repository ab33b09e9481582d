"""The store: what a batch reads and writes, commits of several writers, and what is answered without a scan."""

import os
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import rows

from sievelake.operators import facets, ingest, lifecycle, search
from sievelake.operators.search import Filters
from sievelake.plans import catalog
from sievelake.sources.markers import Lease, Markers
from sievelake.sources.store import Conflict, Store, bucket_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def postings(spark, tmp_path_factory):
    """Stored postings as a table, so that scans are of files."""
    at = str(tmp_path_factory.mktemp("postings") / "p")
    catalog.postings(spark, SF).write.parquet(at)
    return spark.read.parquet(at)


def store_of(spark, path, postings, buckets=64):
    store = Store(spark, str(path), buckets)
    store.commit(postings)
    return store


def batch_of(postings, buckets, n_buckets=64):
    """Payload of the postings in some buckets, with another title."""
    return postings.where(bucket_of(F.col("fingerprint"), n_buckets).isin(buckets)).withColumn("title", F.lit("Changed")).select(*ingest.PAYLOAD)


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path, postings):
    store = store_of(spark, tmp_path / "s", postings)
    before = {r.file: r.bucket for r in store.files(store.commit_of()).collect()}
    some = sorted(set(before.values()))[:3]
    draft = store.prepare(batch_of(postings, some), catalog.now())
    done = store.publish(draft)
    after = {r.file: r.bucket for r in store.files(done).collect()}
    assert len(before) == len(set(before.values())) == len(after) > 20
    assert sorted(after[f] for f in set(after) - set(before)) == some == sorted(before[f] for f in set(before) - set(after))
    assert done.tallies["updated"] == store.read().where("title = 'Changed'").count() > 0


def test_the_plan_of_an_upsert_scans_touched_files_once(spark, tmp_path, postings):
    store = store_of(spark, tmp_path / "s", postings)
    base = store.commit_of()
    some = sorted({r.bucket for r in store.files(base).collect()})[:2]
    existing = store._of_buckets(base, some)
    assert len(existing.inputFiles()) == 2
    plan = lifecycle.merge(existing, lifecycle.numbered(batch_of(postings, some), base.top_id), catalog.now())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryFileIndex(2 paths)") == 1


def test_upserts_equal_the_plain_one(spark, tmp_path, postings):
    store = store_of(spark, tmp_path / "s", postings.where("id % 3 <> 0"), buckets=8)
    now = catalog.now()
    new = postings.where("id % 2 = 0").withColumn("description", F.expr("case when id % 6 = 0 then '' else 'New' end")).select(*ingest.PAYLOAD)
    done = store.upsert(new, now)
    plain = lifecycle.upsert(postings.where("id % 3 <> 0"), new, now)
    tallies = lifecycle.tallies(plain).first()
    assert done.tallies == {"created": tallies.created, "updated": tallies.updated} and done.version == 2
    hide = ["id", "skills", "categories", "action"]
    assert rows(store.read().drop(*hide).toPandas()) == rows(plain.drop(*hide).toPandas())
    old = {r.fingerprint: r.id for r in postings.where("id % 3 <> 0").collect()}
    got = sorted((r.fingerprint, r.id) for r in store.read().select("fingerprint", "id").collect())
    added = [i for f, i in got if f not in old]
    assert all(old[f] == i for f, i in got if f in old) and added == sorted(set(added)) and added[0] > max(old.values())


def test_two_drafts_on_one_base(spark, tmp_path, postings):
    """Of two writers that began on the same version, the second keeps its files where the buckets differ and starts again where they don't."""
    store, now = store_of(spark, tmp_path / "s", postings), catalog.now()
    k1, k2, k3 = sorted({r.bucket for r in store.files(store.commit_of()).collect()})[:3]
    a, b = store.prepare(batch_of(postings, [k1, k2]), now), store.prepare(batch_of(postings, [k3]), now)
    c = store.prepare(batch_of(postings, [k2]), now)
    assert [store.publish(a).version, store.publish(b).version] == [2, 3]
    changed = {r.b for r in store.read().where("title = 'Changed'").select(bucket_of(F.col("fingerprint"), 64).alias("b")).collect()}
    assert changed == {k1, k2, k3} and store.read().count() == postings.count()
    with pytest.raises(Conflict):
        store.publish(c)
    assert store.versions() == [1, 2, 3] and store.read(2).where("title = 'Changed'").count() < store.read(3).where("title = 'Changed'").count()
    # New rows need ids of their own, so they conflict whatever the bucket.
    fresh = lambda name: postings.limit(1).withColumn("fingerprint", F.sha1(F.lit(name))).select(*ingest.PAYLOAD)
    one, two = store.prepare(fresh("x"), now), store.prepare(fresh("y"), now)
    store.publish(one)
    with pytest.raises(Conflict):
        store.publish(two)


def test_an_upsert_that_loses_starts_again(spark, tmp_path, postings, monkeypatch):
    store, now = store_of(spark, tmp_path / "s", postings), catalog.now()
    prepare, others = store.prepare, []

    def late(*args):
        draft = prepare(*args)
        if not others:  # another writer commits between this one's files and its marker
            others.append(store.publish(prepare(batch_of(postings, [2, 4]).withColumn("company", F.lit("Other")), now)))
        return draft

    monkeypatch.setattr(store, "prepare", late)
    done = store.upsert(batch_of(postings, [4]), now)
    assert done.version == 3 and others[0].version == 2
    final = store.read().withColumn("b", bucket_of(F.col("fingerprint"), 64))
    assert final.where("b = 2 and company <> 'Other'").count() == 0 and final.where("b = 4 and title <> 'Changed'").count() == 0
    assert final.count() == postings.count() and store.counts().where("facet = '=total'").first().n == postings.count()


def test_whole_commits_conflict(spark, tmp_path, postings):
    store = store_of(spark, tmp_path / "s", postings, 4)
    draft = store._draft(store.commit_of(), postings.limit(9), None, None)
    store.commit(postings.limit(3))
    with pytest.raises(Conflict):
        store.publish(draft)
    assert store.read().count() == 3


def test_markers_and_lease(spark, tmp_path):
    m = Markers(spark, str(tmp_path / "m"))
    assert m.put("v1", "one") and not m.put("v1", "two") and m.get("v1") == "one" and m.numbers("v") == [1]
    lease = Lease(m, minutes=90)
    first = lease.acquire(1000.0)
    assert first == 1 and lease.acquire(1060.0) is None
    lease.release(first)
    second = lease.acquire(1100.0)
    assert second == 2 and not lease.holds(first) and lease.holds(second)
    assert lease.acquire(1100.0 + 91 * 60) == 3 and not lease.holds(second)  # an orphan's lease runs out


def test_a_commit_under_a_lost_lease_is_refused(spark, tmp_path, postings):
    store = store_of(spark, tmp_path / "s", postings, 4)
    lease = Lease(store.markers)
    held = lease.acquire(0.0)
    draft = store.prepare(batch_of(postings, [1], 4), catalog.now(), lease=held)
    assert lease.acquire(1e9) == held + 1
    with pytest.raises(Conflict):
        store.publish(draft)
    assert store.versions() == [1]


def test_counts_go_forward_by_changes(spark, tmp_path, postings):
    """After ten batches of inserts, updates and retirements the counts equal a full count, and no posting is scanned for them."""
    store, now = store_of(spark, tmp_path / "s", postings.where("id % 4 = 1"), 4), catalog.now()
    for k in range(8):
        part = postings.where(F.col("id") % 9 == k).withColumn("company", F.concat(F.lit("C"), (F.col("id") % (k + 2)).cast("string"))).withColumn("skills", F.when(F.col("id") % 5 == k % 5, F.array(F.lit("Go"))).otherwise(F.col("skills")))
        store.upsert(part.select(*ingest.PAYLOAD), now + F.make_dt_interval(hours=F.lit(k * 7)))
    store.rewrite(lambda p: lifecycle.housekeeping(p, now + F.make_dt_interval(days=F.lit(30))))
    store.rewrite(lambda p: lifecycle.expire_ids(p, spark.range(0, 400, 3), "rejected", now))
    late = now + F.make_dt_interval(days=F.lit(2))
    p = store.read()
    assert rows(store.facets().toPandas()) == rows(facets.all_facets(p).toPandas())
    assert rows(store.stats(late).toPandas()) == rows(facets.stats(p, late).toPandas())
    assert not any("/data/" in f for f in store.facets().inputFiles() + store.stats(late).inputFiles())


def test_long_chains_are_added_up(spark, tmp_path, postings, monkeypatch):
    monkeypatch.setattr("sievelake.sources.store.KEPT_PARTS", 2)
    store, now = store_of(spark, tmp_path / "s", postings.where("id % 2 = 0"), 2), catalog.now()
    for k in range(3):
        store.upsert(postings.where(F.col("id") % 7 == k).select(*ingest.PAYLOAD), now)
    assert max(len(x) for x in store.commit_of().parts.values()) <= 2
    assert rows(store.facets().toPandas()) == rows(facets.all_facets(store.read()).toPandas())
    ids = [r.id for r in store.read().select("id").collect()]
    assert store.by_id(max(ids)).count() == 1


def test_look_up_reads_one_file(spark, tmp_path, postings):
    store = store_of(spark, tmp_path / "s", postings)
    key = postings.selectExpr("max(id) as id").first().id
    found = store.by_id(key)
    assert found.count() == 1 and len(found.inputFiles()) == 1 and found.first().id == key
    assert store.by_id(-5).count() == 0
    after = store.upsert(batch_of(postings, [7]).limit(0).union(postings.limit(1).withColumn("fingerprint", F.lit("f" * 40)).select(*ingest.PAYLOAD)), catalog.now())
    new = store.read().where("fingerprint like 'ffff%'").first().id
    assert new > key and after.top_id >= new and len(store.by_id(new).inputFiles()) == 1 and store.by_id(new).first().fingerprint == "f" * 40


@pytest.mark.parametrize(
    "f", [Filters(q="sql"), Filters(q="Zyqqxv analyst"), Filters(company="zyqq"), Filters(skill=["sql", "python"]), Filters(location="bengal", q="django"), Filters(q="x"), Filters(q="no such words at all"), Filters()]
)
def test_searches_read_the_files_that_can_match(spark, rare, f):
    store, p = rare
    want = rows(search.matching(p, f, catalog.now()).select("id").toPandas())
    assert rows(search.matching(store.searched(f), f, catalog.now()).select("id").toPandas()) == want


@pytest.fixture(scope="module")
def rare(spark, tmp_path_factory, postings):
    """A store in which three rows have a rare word."""
    some = [r.id for r in postings.where("is_active").orderBy("id").limit(3).collect()]
    p = postings.withColumn("company", F.when(F.col("id").isin(some), "Zyqqxv Labs").otherwise(F.col("company")))
    p = p.withColumn("search_blob", catalog.text.search_blob(*[F.col(c) for c in ("title", "company", "location", "category", "skills")]))
    return store_of(spark, tmp_path_factory.mktemp("rare") / "s", p), p


def test_a_rare_word_reads_few_files(rare):
    store, _ = rare
    assert 1 <= len(store.searched(Filters(q="zyqqxv")).inputFiles()) <= 3
    assert len(store.searched(Filters(q="labs", company="ZYQQXV")).inputFiles()) <= 3
    assert len(store.searched(Filters(q="nowhere-to-be-found")).inputFiles()) == 0
    assert len(store.searched(Filters(q="developer")).inputFiles()) > 3


def test_a_replayed_batch_is_not_stored_again(spark, tmp_path, postings):
    store, now = store_of(spark, tmp_path / "s", postings, 4), catalog.now()
    assert store.upsert(batch_of(postings, [0], 4), now, batch=("q", 5)).version == 2
    assert store.upsert(batch_of(postings, [1], 4), now, batch=("q", 5)).version == 2 == store.versions()[-1]
    assert store.upsert(batch_of(postings, [1], 4), now, batch=("q", 6)).version == 3
    assert store.upsert(batch_of(postings, [1], 4), now, batch=("r", 0)).version == 4


def test_vacuum_keeps_what_is_named_or_young(spark, tmp_path, postings):
    store, now = store_of(spark, tmp_path / "s", postings, 4), catalog.now()
    for k in range(3):
        store.upsert(batch_of(postings, [k], 4), now)
    want = rows(store.read().select("id", "title").toPandas())
    store.vacuum(keep=1)
    assert store.versions() == [1, 2, 3, 4]  # all are young
    files = lambda: sum(len(f) for _, _, f in os.walk(tmp_path / "s" / "data"))
    before = files()
    store.vacuum(keep=1, min_age=-1)
    assert store.versions() == [4] and files() < before
    assert rows(store.read().select("id", "title").toPandas()) == want
    assert rows(store.facets().toPandas()) == rows(facets.all_facets(store.read()).toPandas())


def test_an_import_counts_in_the_job_that_writes(spark, tmp_path, postings):
    raw = catalog.raw(spark, SF)
    marked, seen = ingest.observed(ingest.classify(raw, catalog.now()))
    store = Store(spark, str(tmp_path / "s"), 4)
    done = store.upsert(ingest.dedup_richest(ingest.kept(marked)), catalog.now(), empty=postings.limit(0))
    want = {r.reject_reason: r.n for r in ingest.rejections(ingest.classify(raw, catalog.now())).collect()}
    assert ingest.observed_rejections(seen) == want and seen.get["seen"] == raw.count()
    assert done.tallies == {"created": store.read().count(), "updated": 0}


def test_empty_tables(spark, tmp_path, postings):
    store = Store(spark, str(tmp_path / "s"), 4)
    assert store.commit(postings.limit(0)) == 1 and store.read().count() == 0 and store.facets().count() == 0
    assert store.stats(F.lit(datetime(2024, 1, 1))).first().total == 0
    assert store.upsert(postings.limit(0).select(*ingest.PAYLOAD), catalog.now()).tallies == {"created": 0, "updated": 0}
    store.upsert(postings.limit(5).select(*ingest.PAYLOAD), catalog.now())
    assert store.read().count() == 5 and pd.notna(store.stats(catalog.now()).first().last_seen_at)


def test_postings_of_a_store_are_computed_once(spark, monkeypatch):
    """The commit and both batches read one table of postings instead of ranking all raw ones anew."""
    seen = []

    def stop(spark, sf_dir, rows):
        seen.append(rows._jdf.queryExecution().toString())
        raise StopIteration

    monkeypatch.setattr(catalog, "_stored", stop)
    with pytest.raises(StopIteration):
        catalog._upserted(spark, SF)
    assert "Window" not in seen[0]


def test_words_are_dealt_out_before_they_become_grams(spark):
    from sievelake.sources.store import grams_of

    rows = spark.createDataFrame([("f", "abcd abcd"), ("g", "abc")], "file string, text string")
    assert "RepartitionByExpression" in grams_of(rows)._jdf.queryExecution().toString()
    assert sorted(map(tuple, grams_of(rows).collect())) == [("3:abc", "f"), ("3:abc", "g"), ("3:bcd", "f")]
