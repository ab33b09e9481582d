"""Small files that are put where nothing was before: what makes commits and leases safe between writers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Markers:
    """Named texts in one folder; put() succeeds for one writer only.

    It needs a file system whose rename refuses a target that exists, as HDFS does; on local folders a hard link does the same.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def fs(self):
        return self.at("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self, prefix: str) -> list[int]:
        """The numbers n of the markers named prefix and n, rising."""
        found = self.fs().globStatus(self.at(f"{prefix}*")) or []
        tails = [s.getPath().getName().removeprefix(prefix) for s in found]
        return sorted(int(t) for t in tails if t.isdigit())

    def get(self, name: str) -> str:
        stream = self.fs().open(self.at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def has(self, name: str) -> bool:
        return self.fs().exists(self.at(name))

    def put(self, name: str, text: str) -> bool:
        """Whether this call made the marker; it appears with its whole text or not at all."""
        fs, draft, final = self.fs(), self.at(f"drafts/{uuid.uuid4().hex}"), self.at(name)
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getScheme() != "file":
                return not fs.exists(final) and fs.rename(draft, final)
            os.link(draft.toUri().getPath(), final.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(draft, False)

    def delete(self, name: str) -> None:
        self.fs().delete(self.at(name), True)


class Lease:
    """One run at a time: lease n + 1 is given out only once lease n has been given back or is older than so many minutes.

    The number fences the holder: a commit under a lease is refused when a later lease has been given out.
    """

    def __init__(self, markers: Markers, minutes: int = 90, name: str = "lease"):
        self.markers, self.minutes, self.name = markers, minutes, name

    def current(self) -> int:
        return (self.markers.numbers(f"{self.name}-") or [0])[-1]

    def acquire(self, now: float) -> int | None:
        """The number of a new lease, or None while another run holds one; now in seconds."""
        n = self.current()
        if n and not self.markers.has(f"{self.name}-{n}.back") and now - float(self.markers.get(f"{self.name}-{n}")) < 60 * self.minutes:
            return None
        return n + 1 if self.markers.put(f"{self.name}-{n + 1}", repr(now)) else None

    def release(self, n: int) -> None:
        self.markers.put(f"{self.name}-{n}.back", "")

    def holds(self, n: int) -> bool:
        return self.current() == n and not self.markers.has(f"{self.name}-{n}.back")
