"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sievelake.functions.vocab import DEFAULT, Vocabulary
from sievelake.operators.ingest import IngestRules, ingest
from sievelake.sources.store import Store


class Cancelled(RuntimeError):
    """A run was asked to stop, at a boundary between batches."""


def finished(query: StreamingQuery) -> bool:
    """Wait for a query; False if it was cancelled, an error if it failed in another way."""
    try:
        query.awaitTermination()
        return True
    except StreamingQueryException as e:
        if "Cancelled" not in str(e):
            raise
        return False


def stream_upsert(raw: DataFrame, store: Store, empty: DataFrame, as_of: Column, checkpoint: str, rules: IngestRules = IngestRules(), v: Vocabulary = DEFAULT, cancelled: Callable[[], bool] = lambda: False, every: str | None = None) -> StreamingQuery:
    """Each micro-batch of raw postings is classified, deduplicated and upserted into the store; ends when what is there has been read, or
    goes on for ever with a batch as often as every says ("10 minutes").

    empty has the columns of the store. A batch rewrites the buckets it touches only. The commit holds the batch's number under the checkpoint's
    name, so a batch that is replayed after a failure is not stored twice. Former versions stay for an hour, for those who read them.

    cancelled is asked between batches: what was stored stays, the query ends with Cancelled before the next batch, and the same call goes on
    from there later.
    """

    def batch(rows: DataFrame, n: int) -> None:
        if cancelled():
            raise Cancelled(f"stopped before batch {n}")
        store.upsert(ingest(rows, as_of, rules, v), as_of, batch=(checkpoint, n), empty=empty)
        store.vacuum()

    writer = raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_landed(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
