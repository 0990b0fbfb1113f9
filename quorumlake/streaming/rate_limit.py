"""Sliding-log rate limiter: sequential per key, with a log of at most ``limit`` times as state.

A call is admitted if fewer than ``limit`` admitted calls lie within the last
``seconds``; rejected calls are not logged, and a call exactly ``seconds`` old
has left the log.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Calls that a task gives out at a time.
SLAB = 10_000


def _admit(log: deque, now: int, limit: int, micros: int) -> bool:
    while log and log[0] <= now - micros:
        log.popleft()
    if len(log) >= limit:
        return False
    log.append(now)
    return True


def limited(calls: DataFrame, key: str, ts: str, call_id: str, *, limit: int = 60, seconds: int = 60) -> DataFrame:
    """key, call id, admitted of a finished table of calls (ST-09).

    Calls are dealt by key and sorted on disk; a task streams through them and
    keeps one key's log at a time, so a key with very many calls needs no more memory.
    """
    micros = seconds * 1_000_000
    ordered = (
        calls.select(F.col(key).cast("string").alias("_k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), F.col(call_id).cast("long").alias("_id"))
        .repartition("_k")
        .sortWithinPartitions("_k", "_at", "_id")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, deque()
        for frame in frames:
            out = []
            for k, at in zip(frame["_k"], frame["_at"], strict=True):
                if k != current:
                    current, log = k, deque()
                out.append(_admit(log, at, limit, micros))
            yield pd.DataFrame({"key": frame["_k"], "call_id": frame["_id"], "admitted": out})

    return ordered.mapInPandas(run, "key string, call_id long, admitted boolean")


def limited_stream(calls: DataFrame, key: str, ts: str, call_id: str, *, limit: int = 60, seconds: int = 60, late: str = "1 day") -> DataFrame:
    """The same over a stream: the log is the key's state, and goes once event time has passed its last call by ``seconds``.

    Calls later than ``late`` behind the latest one are dropped by the watermark. Of a key's calls in a micro-batch only
    times and ids are held; bound a micro-batch at the source (``maxFilesPerTrigger``, files in order of time).
    """
    micros = seconds * 1_000_000

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0] if state.exists else [])
        held = [f[["_at", "_id"]].to_numpy() for f in frames]
        calls_now = np.concatenate(held)
        calls_now = calls_now[np.lexsort((calls_now[:, 1], calls_now[:, 0]))]
        for at in range(0, len(calls_now), SLAB):
            part = calls_now[at : at + SLAB]
            yield pd.DataFrame({"key": group[0], "call_id": part[:, 1], "admitted": [_admit(log, int(t), limit, micros) for t in part[:, 0]]})
        state.update((list(log),))
        state.setTimeoutTimestamp(max((int(calls_now[-1, 0]) + micros) // 1000, state.getCurrentWatermarkMs()) + 1)

    timed = calls.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    shaped = timed.select(F.col(key).cast("string").alias("_k"), F.unix_micros("_ts").alias("_at"), F.col(call_id).cast("long").alias("_id"), "_ts")
    return shaped.groupBy("_k").applyInPandasWithState(run, "key string, call_id long, admitted boolean", "log array<long>", "append", GroupStateTimeout.EventTimeTimeout)
