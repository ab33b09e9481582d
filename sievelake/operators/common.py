"""What several operators share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; only a local master gets one of its own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="scratch-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def where_after(df: DataFrame, condition) -> DataFrame:
    """df.where(condition), kept above what computes its columns.

    Catalyst would move the filter below projections and repeat there every costly expression the condition mentions. A running number,
    which it may not move a filter across, keeps each expression computed once.
    """
    marked = df.withColumn("_fence", F.monotonically_increasing_id())
    return marked.where(condition & (F.col("_fence") >= 0)).drop("_fence")


def inline_after(df: DataFrame, rows: str, *keep: str) -> DataFrame:
    """keep and the fields of the array of structs rows, one row for each, with rows computed once.

    Spark puts a filter for rows without elements before an inline() and moves it below the projection that computes rows, which is then computed for the filter too. It may
    not move one across a running number that the filter depends on.
    """
    full = where_after(df.select(*keep, rows), F.size(rows) > 0)
    return full.select(*keep, F.inline(rows))


def nth_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order."""
    from pyspark.sql import Window

    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def metrics(seen: Observation) -> dict[str, int]:
    """What an observation has counted; waits for the job that takes it. Spark leaves it out of a plan that turns out to be empty while it runs: nothing then."""
    try:
        return dict(seen.get)
    except Py4JJavaError:
        return {}
