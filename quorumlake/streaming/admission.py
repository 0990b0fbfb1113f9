"""Idempotent admission over a stream of requests: the first payload digest of a key is its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Keys are dealt to so many buckets, each of which is a group with a state.
BUCKETS = 4096


def bucketed(requests: DataFrame, key: str, order: str, digest: str, request_id: str, buckets: int) -> DataFrame:
    """bucket, k, at, digest, id of requests; all of a key are in one bucket."""
    shaped = requests.select(F.col(key).cast("string").alias("k"), F.unix_micros(F.col(order).cast("timestamp")).alias("at"), F.col(digest).cast("string").alias("digest"), F.col(request_id).cast("long").alias("id"))
    return shaped.select(F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int").alias("bucket"), "*")


def judged(frames: Iterator[pd.DataFrame], known: dict[str | None, str | None], added: dict[str | None, str | None]) -> Iterator[tuple[pd.DataFrame, list[str]]]:
    """Each frame of a bucket's requests with their statuses; ``added`` takes the first digests of keys that ``known`` lacks.

    Frames without such keys are judged as they come; the others wait for the last.
    """
    held, first = [], {}
    for frame in frames:
        rows = frame[["k", "at", "id", "digest"]].to_numpy(dtype=object).tolist()
        if all(row[0] in known for row in rows):
            yield frame, ["REPLAY" if row[3] == known[row[0]] else "CONFLICT" for row in rows]
            continue
        held.append((frame, rows))
        for k, at, i, digest in rows:
            if k not in known and (k not in first or (at, i) < first[k][:2]):
                first[k] = (at, i, digest)
    added |= {k: digest for k, (_, _, digest) in first.items()}
    decides, new = known | added, {k: i for k, (_, i, _) in first.items()}
    for frame, rows in held:
        status = []
        for k, _, i, digest in rows:
            if k in new and new[k] == i:
                status.append("NEW")
                del new[k]
            else:
                status.append("REPLAY" if digest == decides[k] else "CONFLICT")
        yield frame, status


def admitted_stream(requests: DataFrame, key: str, order: str, digest: str, request_id: str, buckets: int = BUCKETS) -> DataFrame:
    """request_id, status NEW, REPLAY or CONFLICT (ST-01).

    A key's first request of all decides; of it only the digest is kept. Keys are many with few rows each, so a group is
    a bucket of keys, and its state their first digests; a micro-batch with a new key writes its bucket's anew. Rows are
    held only beside those of new keys, for the micro-batch they come in: bound that at the source
    (``maxFilesPerTrigger``, files in order of time). A key never expires, since a replay may come at any time; null digests are equal. A run that is taken up again
    must leave ``buckets`` as they are.
    """

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, added = dict(zip(*state.get, strict=True)) if state.exists else {}, {}
        for frame, status in judged(frames, known, added):
            yield pd.DataFrame({"request_id": frame["id"], "status": status})
        if added:
            known |= added
            state.update((list(known), list(known.values())))

    shaped = bucketed(requests, key, order, digest, request_id, buckets)
    return shaped.groupBy("bucket").applyInPandasWithState(run, "request_id long, status string", "ks array<string>, digests array<string>", "append", GroupStateTimeout.NoTimeout)


def per_window(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events of each kind by window of event time; rows later than ``late`` behind are dropped by the watermark.

    In append mode a window is given once the watermark has passed its end, so windows that are open when the input ends are not given.
    """
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def finished(stream: DataFrame, folder: str) -> DataFrame:
    """All that the stream gives for the input there is, written to ``folder`` with its checkpoint."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
