"""States of jobs from their events, as a stateful stream and as a batch: the same rows.

Events: ``job, event, kind, at, said``; ``kind`` is submitted, started, succeeded or failed. A repeated event (same job
and id) counts once. Events may come late and in any order: what counts is their time, ties go to the greater id. A job
is pending until it starts, running from its last start on, and succeeded or failed by what came last after that; each
start is an attempt. The error is that of the last failure, if nothing started or succeeded after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KINDS = ("submitted", "started", "succeeded", "failed")
OUT = "job long, state string, attempts int, started_at timestamp, finished_at timestamp, last_error string, events int"
#: Event ids that a job's state remembers singly are as many as its events; events later than this are not awaited.
LATE = "7 days"


def states(events: DataFrame) -> DataFrame:
    """The state of each job, from a batch of its events. Null jobs, ids, times and kinds, and unknown kinds, are left out."""
    known = events.where(F.col("job").isNotNull() & F.col("event").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(*KINDS))
    # of rows that repeat an id, the first by all they say
    once = known.groupBy("job", "event").agg(F.min(F.struct("at", "kind", "said")).alias("e")).select("job", "event", "e.*")
    last = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.struct("at", "event", "kind", "said")))
    rows = once.groupBy("job").agg(last("started").alias("start"), last("succeeded", "failed").alias("end"), F.count_if(F.col("kind") == "started").cast("int").alias("attempts"), F.count("*").cast("int").alias("events"))
    after = F.col("end").isNotNull() & (F.col("start").isNull() | (F.struct("end.at", "end.event") > F.struct("start.at", "start.event")))
    told: Column = F.when(after, F.col("end.kind")).when(F.col("start").isNotNull(), "running").otherwise("pending")
    return rows.select("job", told.alias("state"), "attempts", F.col("start.at").alias("started_at"), F.when(after, F.col("end.at")).alias("finished_at"), F.when(after & (F.col("end.kind") == "failed"), F.col("end.said")).alias("last_error"), "events")


class _Job(StatefulProcessor):
    """Keeps the events seen, the last start and the last end of a job."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "event long", "at timestamp, kind string, said string")
        self.sums = handle.getValueState("sums", "attempts int, events int, start_at timestamp, start_event long, end_at timestamp, end_event long, end_kind string, end_said string")

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Any]:  # noqa: N802, N803
        import pandas as pd

        sums = list(self.sums.get() or (0, 0, None, None, None, None, None, None))
        for pdf in rows:
            for r in pdf.sort_values(["at", "kind", "said"], na_position="first").itertuples(index=False):
                event = int(r.event)
                if self.seen.containsKey((event,)):
                    continue
                at, said = r.at.to_pydatetime(), None if r.said is None or r.said != r.said else str(r.said)
                self.seen.updateValue((event,), (at, r.kind, said))
                sums[1] += 1
                if r.kind == "started":
                    sums[0] += 1
                    if sums[2] is None or (at, event) > (sums[2], sums[3]):
                        sums[2:4] = [at, event]
                elif r.kind != "submitted" and (sums[4] is None or (at, event) > (sums[4], sums[5])):
                    sums[4:8] = [at, event, r.kind, said]
        self.sums.update(tuple(sums))
        after = sums[4] is not None and (sums[2] is None or (sums[4], sums[5]) > (sums[2], sums[3]))
        state = sums[6] if after else "running" if sums[2] is not None else "pending"
        row = {"job": [int(key[0])], "state": [state], "attempts": [sums[0]], "started_at": [sums[2]], "finished_at": [sums[4] if after else None], "last_error": [sums[7] if state == "failed" else None], "events": [sums[1]]}
        yield pd.DataFrame(row).astype({"attempts": "int32", "events": "int32", "started_at": "datetime64[ns]", "finished_at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def stream(events: DataFrame) -> DataFrame:
    """``events`` as a stream: the new state of each job that had events in a batch; ``upsert_batches`` keeps the newest.

    A repeated id that says something else is ignored once the first has been seen. Needs a state store with several
    states for each key: ``spark.sql.streaming.stateStore.providerClass`` set to that of RocksDB.
    """
    known = events.where(F.col("job").isNotNull() & F.col("event").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(*KINDS))
    return known.groupBy("job").transformWithStateInPandas(_Job(), OUT, "Update", "None")
