"""Live events of runs, each subscriber with a streaming query and state of its own."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Events that a new subscriber is shown of what was before, and those that wait for a slow one; more are dropped.
BACKLOG, QUEUE = 800, 1000

TAILED = "run_id long, event_id long, ts timestamp_ntz, type string, message string, nth long, dropped long"
_STATE = "subscribed boolean, done boolean, sent long, dropped long"


def tailed(events: DataFrame, backlog: int = BACKLOG, queue: int = QUEUE) -> DataFrame:
    """The stream of what a subscriber to each run is sent, from a stream of events (run_id, event_id, ts, type, message).

    Of the events that are there when it subscribes, the last backlog ones; of those that came since it last asked, the first queue ones. A run's
    event of type done ends it: later ones are neither sent nor counted. nth counts what was sent of a run and dropped what was not, so far. Null run ids and
    times are left out. State is four numbers a run; a task holds at most backlog or queue events of one run.
    """

    def step(key, frames, state: GroupState):
        subscribed, done, sent, dropped = state.get if state.exists else (False, False, 0, 0)
        held: list = []  # a heap of the last or, with signs turned, first events
        most, seen = (queue if subscribed else backlog), 0
        if not done:
            for pdf in frames:
                for ts, event_id, kind, message in zip(pdf.ts, pdf.event_id, pdf.type, pdf.message):
                    at = (ts.value, event_id)
                    seen += 1
                    rank = at if not subscribed else (-at[0], -at[1])
                    entry = (rank, at, ts, event_id, kind, message)
                    if len(held) < most:
                        heapq.heappush(held, entry)
                    else:
                        heapq.heappushpop(held, entry)
        rows = sorted((e[1:] for e in held), key=lambda e: e[0])
        dropped += seen - len(rows)
        ends = next((k for k, e in enumerate(rows) if e[3] == "done"), None)
        rows, done = (rows, done) if ends is None else (rows[: ends + 1], True)
        state.update((True, done, sent + len(rows), dropped))
        out = pd.DataFrame([(key[0], e[2], e[1], e[3], e[4], sent + k + 1, dropped) for k, e in enumerate(rows)], columns=["run_id", "event_id", "ts", "type", "message", "nth", "dropped"])
        yield out.astype({"ts": "datetime64[ns]"})

    clean = events.where(F.col("run_id").isNotNull() & F.col("ts").isNotNull()).select(F.col("run_id").cast("long"), F.col("event_id").cast("long"), F.col("ts").cast("timestamp_ntz"), "type", F.col("message").cast("string"))
    return clean.groupBy("run_id").applyInPandasWithState(step, TAILED, _STATE, "append", GroupStateTimeout.NoTimeout)


def follow(events: DataFrame, run_id: int, deliver: Callable[[list], None], checkpoint: str, backlog: int = BACKLOG, queue: int = QUEUE) -> bool:
    """Deliver what is there of a run since this subscriber's checkpoint, in order; whether the run's end was among it.

    Call it again until it says so: each call goes on where the last one ended, also after a failure in between. A batch is marked as
    delivered by the checkpoint, so one whose delivery failed comes again and none else does.
    """
    ended = []

    def batch(rows: DataFrame, _: int) -> None:
        found = rows.orderBy("nth").collect()  # at most the larger of backlog and queue
        deliver(found)
        ended.extend(r for r in found if r.type == "done")

    start(events.where(F.col("run_id") == run_id), batch, checkpoint, backlog, queue).awaitTermination()
    return bool(ended)


def start(events: DataFrame, batch: Callable, checkpoint: str, backlog: int = BACKLOG, queue: int = QUEUE) -> StreamingQuery:
    return tailed(events, backlog, queue).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
