"""Admission, transitions and rate limits as keyed state that is changed in place.

A call reads and writes only the entries that it concerns: the last state of
an execution, or of a sliding log the oldest entry and the new one. Admission,
whose keys are many with few rows each, has a call for a bucket of keys: it
reads the bucket's first digests and adds those of new keys. State is kept by RocksDB (``keyed_by_rocksdb``), on the tasks'
disks and in the checkpoint. What no longer counts goes by timer in event time
(rate limits) or, where asked for, after a time to live since it was last
written (admission, transitions). Of a key's rows in a micro-batch only the
columns that decide are held; bound a micro-batch at the source.
"""

from __future__ import annotations

import contextlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quorumlake.streaming.admission import BUCKETS, bucketed, judged

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that a task gives out at a time.
SLAB = 10_000
#: What may follow a state (ST-04); null is before the first.
NEXT = {None: ("Accepted",), "Accepted": ("Executing", "Failed"), "Executing": ("Completed", "Failed")}


@contextlib.contextmanager
def keyed_by_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within keep their state in RocksDB, which this kind of state needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def finished(stream: DataFrame, folder: str) -> DataFrame:
    """All that the stream gives for the input there is, written to ``folder`` with its checkpoint; run again, it goes on from there."""
    with keyed_by_rocksdb(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def _clock(ttl_ms: int | None) -> str:
    """A time to live needs the clock, and with it a query that runs on: its batches never end by themselves."""
    return "None" if ttl_ms is None else "ProcessingTime"


class Admission(StatefulProcessor):
    """The first digest of a key decides: NEW, then REPLAY or CONFLICT. The state is a list of a bucket's keys with theirs, which is only added to."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getListState("first", "k string, digest string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known, added = dict(self.first.get()), {}
        for frame, status in judged(rows, known, added):
            yield pd.DataFrame({"request_id": frame["id"], "status": status})
        if added:
            self.first.appendList(list(added.items()))

    def close(self) -> None:
        pass


def admitted(requests: DataFrame, key: str, order: str, digest: str, request_id: str, *, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """request_id, status of a stream of requests (ST-01); a key that was not written for ``ttl_ms`` is forgotten, by default never.

    Keys are dealt to ``buckets`` by hash, which a run that is taken up again must leave as they are.
    """
    shaped = bucketed(requests, key, order, digest, request_id, buckets)
    return shaped.groupBy("bucket").transformWithStateInPandas(Admission(ttl_ms), "request_id long, status string", "append", _clock(ttl_ms))


class Transitions(StatefulProcessor):
    """The last state of an execution; rows whose state can't follow it are given out."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "state string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known = self.last.get()
        before = known[0] if known else None
        frames = [f[["at", "state"]] for f in rows]
        out = []
        for at, state in sorted(((a, s) for f in frames for a, s in zip(f["at"].tolist(), f["state"].tolist(), strict=True)), key=lambda r: r[0]):
            if state not in NEXT.get(before, ()):
                out.append((key[0], at, before, state))
            before = state
        self.last.update((before,))
        yield pd.DataFrame(out, columns=["execution", "ordinal", "before", "state"])

    def close(self) -> None:
        pass


def illegal_transitions(states: DataFrame, key: str, order: str, state: str, *, ttl_ms: int | None = None) -> DataFrame:
    """execution, ordinal, before, state: rows of a stream whose state can't follow the one before (ST-04).

    Rows of an execution come in order from one micro-batch to the next; within one they are sorted.
    """
    shaped = states.select(F.col(key).cast("string").alias("k"), F.col(order).cast("long").alias("at"), F.col(state).alias("state"))
    return shaped.groupBy("k").transformWithStateInPandas(Transitions(ttl_ms), "execution string, ordinal long, before string, state string", "append", _clock(ttl_ms))


class Limiter(StatefulProcessor):
    """A sliding log as a map from places to times; ``ends`` holds the first place, the one after the last, and the last time."""

    def __init__(self, limit: int, micros: int) -> None:
        self.limit, self.micros = limit, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getMapState("log", "place long", "at long")
        self.ends = handle.getValueState("ends", "head long, tail long, last long")

    def _oldest(self, head: int, stored: int, new: deque) -> int:
        return self.log.getValue((head,))[0] if head < stored else new[0]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        calls = np.concatenate([f[["at", "id"]].to_numpy() for f in rows])
        calls = calls[np.lexsort((calls[:, 1], calls[:, 0]))]
        head, tail, last = self.ends.get() or (0, 0, 0)
        first, stored, new = head, tail, deque()
        oldest = self._oldest(head, stored, new) if head < tail else None
        for at in range(0, len(calls), SLAB):
            part, admitted = calls[at : at + SLAB], []
            for now in part[:, 0].tolist():
                while head < tail and oldest <= now - self.micros:
                    if head >= stored:
                        new.popleft()
                    head += 1
                    oldest = self._oldest(head, stored, new) if head < tail else None
                admitted.append(tail - head < self.limit)
                if admitted[-1]:
                    new.append(now)
                    tail, last = tail + 1, now
                    oldest = now if tail - head == 1 else oldest
            yield pd.DataFrame({"key": key[0], "call_id": part[:, 1], "admitted": admitted})
        for place in range(first, min(head, stored)):
            self.log.removeKey((place,))
        for place, now in zip(range(tail - len(new), tail), new, strict=True):
            self.log.updateValue((place,), (now,))
        self.ends.update((head, tail, last))
        self.handle.registerTimer((last + self.micros) // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        ends = self.ends.get()
        # a later call has a later timer
        if ends and (ends[2] + self.micros) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.log.clear()
            self.ends.clear()
        yield pd.DataFrame({"key": [], "call_id": [], "admitted": []}).astype({"key": str, "call_id": "int64", "admitted": bool})

    def close(self) -> None:
        pass


def limited(calls: DataFrame, key: str, ts: str, call_id: str, *, limit: int = 60, seconds: int = 60, late: str = "1 day") -> DataFrame:
    """key, call_id, admitted of a stream of calls (ST-09), as ``rate_limit.limited`` has it of a table.

    A key's log goes once event time has passed its last admitted call by ``seconds``. Calls later than ``late`` behind the latest are dropped.
    """
    timed = calls.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    shaped = timed.select(F.col(key).cast("string").alias("k"), F.unix_micros("_ts").alias("at"), F.col(call_id).cast("long").alias("id"), "_ts")
    return shaped.groupBy("k").transformWithStateInPandas(Limiter(limit, seconds * 1_000_000), "key string, call_id long, admitted boolean", "append", "EventTime")
