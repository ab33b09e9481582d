"""A table of postings in buckets of the fingerprint, with versions.

A commit writes data files into a folder of its own, then a table of files (the former one with the entries of the buckets it
touched replaced), then a marker that is put only if no one else has put that version. A batch reads and rewrites the buckets that its
fingerprints fall into and no others. A writer that loses keeps its files if the winner touched other buckets and gave out no ids, and
else starts again on the winner's version; what it wrote before is never part of any version.

Each version also names small tables that add up: changes of facet counts, the bucket of each id, and the n-grams of the words of each
file. They answer facets, look-ups by id and contains searches without a scan of the postings.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievelake.operators import facets, lifecycle
from sievelake.operators.search import Filters, needles
from sievelake.sources.markers import Lease, Markers

BUCKETS, ATTEMPTS, KEPT_PARTS = 64, 10, 16
#: Lengths of the n-grams that files are found by; a search uses the longest that fits.
GRAMS = (3, 6)
PARTS = ("counts", "places", "grams")


class Conflict(RuntimeError):
    """Someone else's commit came first and touched the same rows."""


@dataclass(frozen=True)
class Commit:
    """What a version's marker says. files: the folder of the table of files; parts: folders whose rows add up."""

    version: int = 0
    files: str = ""
    schema: str = ""
    buckets: int = BUCKETS
    top_id: int = 0
    parts: dict = field(default_factory=lambda: {p: [] for p in PARTS})
    touched: list = field(default_factory=list)
    gave_ids: bool = False
    written_at: float = 0.0
    batches: dict = field(default_factory=dict)
    tallies: dict = field(default_factory=dict)
    lease: int | None = None


@dataclass(frozen=True)
class Draft:
    """Data files that no version names yet, and the version they were made for."""

    base: Commit
    files: DataFrame
    commit: Commit
    parts: dict
    whole: bool = False


def bucket_of(fingerprint: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(fingerprint), F.lit(buckets)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.markers = Markers(spark, f"{self.path}/commits")

    # ---------------------------------------------------------------- versions

    def versions(self) -> list[int]:
        return self.markers.numbers("v")

    def exists(self) -> bool:
        return bool(self.versions())

    def commit_of(self, version: int | None = None) -> Commit:
        if version is None:
            found = self.versions()
            if not found:
                return Commit(buckets=self.buckets)
            version = found[-1]
        return Commit(**json.loads(self.markers.get(f"v{version}")))

    def files(self, commit: Commit) -> DataFrame:
        """(file, bucket, n, first_id, last_id, last_seen) of a version."""
        return self.spark.read.schema("file string, bucket int, n long, first_id long, last_id long, last_seen timestamp_ntz").parquet(f"{self.path}/files/{commit.files}")

    def _read(self, commit: Commit, files: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(commit.schema))
        if not files:
            return self.spark.createDataFrame([], schema)
        # Folders named bucket=3 say nothing that the fingerprint doesn't.
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*files)

    def read(self, version: int | None = None, where: Column | None = None) -> DataFrame:
        """The rows of a version; where, over the table of files, leaves files out."""
        commit = self.commit_of(version)
        found = self.files(commit)
        return self._read(commit, sorted(r.file for r in (found if where is None else found.where(where)).select("file").collect()))

    # ---------------------------------------------------------------- writing

    def commit(self, snapshot: DataFrame, batch: tuple[str, int] | None = None, lease: int | None = None) -> int:
        """Replace all rows by those of a snapshot. Raises Conflict if another commit came since this one began."""
        base = self.commit_of()
        draft = self._draft(base, snapshot, None, None, batch=batch, lease=lease)
        return self.publish(draft).version

    def upsert(self, incoming: DataFrame, now: Column, batch: tuple[str, int] | None = None, lease: int | None = None, empty: DataFrame | None = None) -> Commit:
        """Merge incoming postings (PAYLOAD, one row per fingerprint) into the buckets they fall into.

        incoming is computed once. Starts again when another writer was first; empty gives the columns of a store that has no version
        yet. A batch (name, number) that is not above the last one stored under that name is not stored again. New rows take their ids from a
        range that is given out to the batch, in order of fingerprint, so ids rise but may leave gaps.
        """
        at = f"{self.path}/staging/{uuid.uuid4().hex}"
        staged = None
        for _ in range(ATTEMPTS):
            base = self.commit_of()
            if batch and base.batches.get(batch[0], -1) >= batch[1]:
                return base
            if staged is None:
                incoming.write.parquet(at)  # also where metrics that incoming observes are taken
                staged = self.spark.read.schema(incoming.schema).parquet(at)
            try:
                return self.publish(self.prepare(staged, now, base, batch, lease, empty))
            except Conflict:
                continue
        raise Conflict(f"{ATTEMPTS} other commits came first")

    def prepare(self, staged: DataFrame, now: Column, base: Commit | None = None, batch: tuple[str, int] | None = None, lease: int | None = None, empty: DataFrame | None = None) -> Draft:
        """The data files of an upsert onto base, not yet part of any version."""
        base = base or self.commit_of()
        if not base.schema:
            if empty is None:
                raise ValueError("a store without a version needs empty, which gives its columns")
            base = replace(base, schema=empty.schema.json())
        staged = staged.withColumn("bucket", bucket_of(F.col("fingerprint"), base.buckets))
        touched = sorted(r.bucket for r in staged.select("bucket").distinct().collect())
        merged = lifecycle.merge(self._of_buckets(base, touched), lifecycle.numbered(staged, base.top_id), now)
        return self._draft(base, merged, touched, staged.count(), batch=batch, lease=lease)

    def rewrite(self, change: Callable[[DataFrame], DataFrame], lease: int | None = None, where: Column | None = None) -> Commit:
        """Put change(rows) in place of the rows of those buckets that have a file for which where holds (all of them by default).

        change keeps the columns and gives no row another fingerprint; it may drop rows.
        """
        for _ in range(ATTEMPTS):
            base = self.commit_of()
            found = self.files(base)
            touched = sorted(r.bucket for r in (found if where is None else found.where(where)).select("bucket").distinct().collect())
            rows = self._of_buckets(base, touched)
            try:
                return self.publish(self._draft(base, change(rows).select(*rows.columns), touched, None, before=rows, lease=lease))
            except Conflict:
                continue
        raise Conflict(f"{ATTEMPTS} other commits came first")

    def _of_buckets(self, base: Commit, touched: list[int]) -> DataFrame:
        some = self.files(base).where(F.col("bucket").isin(touched)).select("file").collect() if base.files else []
        return self._read(base, sorted(r.file for r in some))

    def _draft(self, base: Commit, rows: DataFrame, touched: list[int] | None, incoming: int | None, before: DataFrame | None = None, batch=None, lease=None) -> Draft:
        """Write rows and what is known of them. touched None: all buckets are replaced; incoming: an upsert of so many rows."""
        name = uuid.uuid4().hex
        own = [c for c in rows.columns if c not in ("bucket", "action", "before")]
        schema = rows.select(*own).schema
        rows = rows.withColumn("bucket", bucket_of(F.col("fingerprint"), base.buckets)).repartition(max(1, base.buckets if touched is None else len(touched)), "bucket")
        rows.sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        extra = StructType(list(schema.fields))
        if incoming is not None:
            extra = extra.add("action", "string").add("before", rows.schema["before"].dataType)
        written = self.spark.read.schema(extra).option("recursiveFileLookup", "true").parquet(f"{self.path}/data/{name}")
        file = F.col("_metadata.file_path").alias("file")
        bucket = F.regexp_extract("file", "bucket=(\\d+)", 1).cast("int").alias("bucket")
        last_seen = F.max("last_seen_at") if "last_seen_at" in own else F.lit(None)
        files = written.select(file, "id", *(["last_seen_at"] if "last_seen_at" in own else [])).groupBy("file")
        files = files.agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), last_seen.cast("timestamp_ntz").alias("last_seen"))
        files.select("file", bucket, "n", "first_id", "last_id", "last_seen").coalesce(1).write.parquet(f"{self.path}/files/{name}-own")
        files = self.spark.read.parquet(f"{self.path}/files/{name}-own")

        # Facet counts go forward by what changed; replaced rows whose former entries were not carried along are counted on both sides.
        plus = written if incoming is None else written.where("action <> 'keep'")
        changes = facets.counted(plus.select(F.explode(facets.entries(plus)).alias("e")), 1)
        if incoming is not None:
            changes = changes.union(facets.counted(written.where("action = 'update'").select(F.explode("before").alias("e")), -1))
        elif before is not None:
            changes = changes.union(facets.counted(before.select(F.explode(facets.entries(before)).alias("e")), -1))
        changes = changes.groupBy("facet", "value").agg(F.sum("n").alias("n")).where("n <> 0")
        changes.write.parquet(f"{self.path}/counts/{name}")
        placed = written if touched is None else written.where("action = 'insert'") if incoming is not None else None
        if placed is not None:
            where = bucket_of(F.col("fingerprint"), base.buckets).alias("bucket")
            placed.select("id", where).repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{self.path}/places/{name}")
        texts = [F.array_join(c, " ") if c == "skills" else F.col(c) for c in ("search_blob", "description", "location", "company", "skills") if c in own]
        grams_of(written.select(file, F.concat_ws(" ", *texts).alias("text"))).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{self.path}/grams/{name}")

        tallies = {r.action: r["count"] for r in written.groupBy("action").count().collect()} if incoming is not None else {}
        top = base.top_id + incoming if incoming is not None else max(base.top_id, files.agg(F.max("last_id")).first()[0] or 0)
        commit = Commit(
            files=name, schema=schema.json(), buckets=base.buckets, top_id=top, touched=list(range(base.buckets)) if touched is None else touched, gave_ids=touched is None or bool(tallies.get("insert")), lease=lease,
            batches={**base.batches, **({batch[0]: batch[1]} if batch else {})}, tallies={"created": tallies.get("insert", 0), "updated": tallies.get("update", 0)},
        )
        return Draft(base, files, commit, {"counts": name, "grams": name, **({"places": name} if placed is not None else {})}, touched is None)

    def publish(self, draft: Draft) -> Commit:
        """Make a draft the next version. Raises Conflict if a version since its base touched the same buckets or ids, or its lease has passed on."""
        base = draft.base
        for _ in range(ATTEMPTS):
            if draft.commit.lease is not None and not Lease(self.markers).holds(draft.commit.lease):
                raise Conflict("a later run holds the lease")
            name = uuid.uuid4().hex
            entries = draft.files
            if base.files:
                entries = self.files(base).where(~F.col("bucket").isin(draft.commit.touched)).unionByName(entries)
            entries.coalesce(1).write.parquet(f"{self.path}/files/{name}")
            parts = {p: [*([] if draft.whole else base.parts[p]), *([draft.parts[p]] if p in draft.parts else [])] for p in PARTS}
            commit = replace(draft.commit, version=base.version + 1, files=name, parts=self._compacted(parts), batches={**base.batches, **draft.commit.batches}, top_id=max(base.top_id, draft.commit.top_id), written_at=time.time())
            if self.markers.put(f"v{commit.version}", json.dumps(asdict(commit))):
                return commit
            last = self.commit_of()
            since = [self.commit_of(v) for v in range(base.version + 1, last.version + 1)]
            for other in since:
                if set(other.touched) & set(draft.commit.touched) or other.gave_ids and draft.commit.gave_ids or last.buckets != draft.commit.buckets:
                    raise Conflict(f"version {other.version} touched the same rows")
            base = last
        raise Conflict(f"{ATTEMPTS} other commits came first")

    def _compacted(self, parts: dict) -> dict:
        """Chains of more than KEPT_PARTS folders are added up into one."""
        out = dict(parts)
        for p, folders in parts.items():
            if len(folders) > KEPT_PARTS:
                name = uuid.uuid4().hex
                rows = self.spark.read.parquet(*[f"{self.path}/{p}/{f}" for f in folders])
                if p == "counts":
                    rows = rows.groupBy("facet", "value").agg(F.sum("n").alias("n")).where("n <> 0")
                else:
                    key = "id" if p == "places" else "gram"
                    rows = rows.repartitionByRange(key).sortWithinPartitions(key)
                rows.write.parquet(f"{self.path}/{p}/{name}")
                out[p] = [name]
        return out

    # ---------------------------------------------------------------- reading without a scan

    def _part(self, commit: Commit, p: str, schema: str) -> DataFrame:
        folders = commit.parts[p]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def counts(self, version: int | None = None) -> DataFrame:
        """(facet, value, n), n > 0: all facet counts of a version, from the changes of each commit."""
        rows = self._part(self.commit_of(version), "counts", "facet string, value string, n long")
        return rows.groupBy("facet", "value").agg(F.sum("n").alias("n")).where("n <> 0")

    def facets(self, version: int | None = None) -> DataFrame:
        """What facets.all_facets() gives for the rows of a version."""
        return facets.ranked(self.counts(version))

    def stats(self, as_of: Column, version: int | None = None) -> DataFrame:
        """What facets.stats() gives for the rows of a version."""
        return facets.stats_of(self.counts(version), self.files(self.commit_of(version)).agg(F.max("last_seen").alias("last_seen_at")), as_of)

    def by_id(self, key: int, version: int | None = None) -> DataFrame:
        """The row with an id, from the file that holds it."""
        commit = self.commit_of(version)
        places = self._part(commit, "places", "id long, bucket int").where(F.col("id") == key)
        buckets = [r.bucket for r in places.select("bucket").distinct().collect()]
        some = F.col("bucket").isin(buckets) & F.lit(key).between(F.col("first_id"), F.col("last_id"))
        return self.read(commit.version, some).where(F.col("id") == key)

    def searched(self, f: Filters, version: int | None = None) -> DataFrame:
        """The rows of those files that can have a match for the texts of a filter; search.matching() and the like do the rest."""
        commit = self.commit_of(version)
        wanted = {(n, part[i : i + n]) for part in needles(f) for n in [max((g for g in GRAMS if g <= len(part)), default=0)] if n for i in range(len(part) - n + 1)}
        if not wanted:
            return self.read(commit.version)
        grams = sorted(f"{n}:{g}" for n, g in wanted)
        held = self._part(commit, "grams", "gram string, file string").where(F.col("gram").isin(grams)).distinct()
        found = held.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
        live = self.files(commit).select("file").join(found, "file", "left_semi")
        return self._read(commit, sorted(r.file for r in live.collect()))

    def vacuum(self, keep: int = 2, min_age: float = 3600.0) -> None:
        """Delete versions but the last ones, and files that no version left names, both only if they are older than min_age seconds.

        A reader that began less than min_age ago keeps its files, and so does a writer that has not published yet.
        """
        now = time.time()
        kept: list[Commit] = []
        all_versions = self.versions()
        for v in all_versions:
            commit = self.commit_of(v)
            if v in all_versions[-keep:] or now - commit.written_at < min_age:
                kept.append(commit)
            else:
                self.markers.delete(f"v{v}")
        named = {p: {f for c in kept for f in c.parts[p]} for p in PARTS}
        named["files"] = {c.files for c in kept}
        named["staging"] = set()
        for folder, names in named.items():
            self._delete_old(f"{folder}/*", now - min_age, lambda path, names=names: path.getName() in names)
        # Files of one folder live on in different versions, so they go one by one.
        tail = lambda path: "/".join(path.split("/")[-3:])
        live = {tail(r.file) for c in kept for r in self.files(c).select("file").collect()}
        self._delete_old("data/*/*/*", now - min_age, lambda path: tail(path.toString()) in live)

    def _delete_old(self, pattern: str, before: float, keep: Callable) -> None:
        fs = self.markers.fs()
        for status in fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")) or []:
            if status.getModificationTime() / 1000 <= before and not keep(status.getPath()):
                fs.delete(status.getPath(), True)


def grams_of(rows: DataFrame) -> DataFrame:
    """(gram, file) of rows (file, text): the n-grams of each file's distinct words; words end at blanks, as the parts of a searched text do."""
    words = rows.select("file", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word")).where("word <> ''").distinct()
    # Words are few bytes but make many grams each: dealt out, as they would else be gathered into a task or two.
    words = words.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "word")
    letters = F.filter(F.split("word", ""), lambda x: x != "")

    def grams(n: int) -> Column:
        # Letter by letter, so that a long word costs its length and not the square of it.
        starts = F.sequence(F.lit(1), F.greatest(F.size("c") - (n - 1), F.lit(1)))
        each = F.transform(starts, lambda i: F.concat(F.lit(f"{n}:"), *[F.try_element_at("c", i + k) for k in range(n)]))
        return F.when(F.size("c") >= n, each).otherwise(F.array().cast("array<string>"))

    made = words.withColumn("c", letters).select("file", F.explode(F.concat(*[grams(n) for n in GRAMS])).alias("gram"))
    return made.distinct().select("gram", "file")
