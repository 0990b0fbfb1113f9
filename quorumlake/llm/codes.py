"""Codes of vectors by parts: exact integer Lloyd rounds that move only what changed.

A component x becomes floor(scale * x). A vector is cut into ``parts``
consecutive parts, each with a codebook of its own. Every round assigns each
part to its nearest entry and stores the assignment beside the vector with the
one before. Only parts whose assignment changed give a contribution, minus to
the entry they leave and plus to the one they come to; tasks add these up
before they are shuffled, and they are added to the running integer sums, which
are a table too. Codebooks are ``entries`` times the length of a vector, so they
are sent to the tasks; the driver sees nothing that grows with the rows.

Defined cases: vectors that are null or hold null or non-finite components are
dropped, and so are those of another length than that of the smallest vec_id,
which have no place in the codebooks; a null vec_id comes after all others; of
a vec_id that repeats the least vector makes an entry, and each of its rows has
a code; with fewer vec_ids than ``entries`` there are fewer entries; parts of a
length that ``parts`` doesn't divide differ by one at most; empty vectors have
code 0 everywhere and no error; null labels are one label; components above
2**18 in size are an error, as their squared distances don't fit; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
MOST = 1 << 26
ASSIGNED = "vec_id long, label int, v array<long>, before array<int>, now array<int>"
DELTAS = "part int, entry int, place int, total long, n long"


def finite(vector: Column) -> Column:
    """Whether ``vector`` is not null and has finite components only."""
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def bounds(length: int, parts: int) -> list[tuple[int, int]]:
    return [(j * length // parts, (j + 1) * length // parts) for j in range(parts)]


class Codebooks:
    """Integer entries of every part, ``(entries, length)``, and the parts' bounds."""

    def __init__(self, entries: np.ndarray, parts: int) -> None:
        self.entries, self.bounds = entries, bounds(entries.shape[1], parts)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part of each row of ``x``, ties to the lower one, and the rows' squared distances."""
        codes, error = np.zeros((len(x), len(self.bounds)), dtype=np.int32), np.zeros(len(x), dtype=np.int64)
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        if most > MOST:
            raise ValueError("components are too large for squared distances in 64 bits")
        for j, (low, high) in enumerate(self.bounds):
            if low == high or not len(x):
                continue
            own, entries = x[:, low:high], self.entries[:, low:high]
            # whole numbers below 2**53 are exact as floats, whose matrix product is the faster one
            kind = np.float64 if 4 * (high - low) * most * most < 1 << 53 else np.int64
            a, b = own.astype(kind), entries.astype(kind)
            codes[:, j] = np.argmin((b * b).sum(axis=1) - 2 * (a @ b.T), axis=1)
            error += ((own - entries[codes[:, j]]) ** 2).sum(axis=1)
        return codes, error

    def sha256(self) -> str:
        parts = (self.entries[:, low:high].reshape(-1) for low, high in self.bounds)
        return hashlib.sha256(",".join(str(v) for p in parts for v in p.tolist()).encode()).hexdigest()


def _matrix(batch: pa.RecordBatch, name: str, length: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, length)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, length = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * length, pa.int32()), pa.array(values.reshape(-1), kind))


def assigned(vectors: DataFrame, books: Codebooks, length: int, parts: int) -> DataFrame:
    """``vectors`` with their last assignment as ``before`` and the one to ``books`` as ``now``."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, _ = sent.value.assign(_matrix(batch, "v", length))
            columns = [batch.column("vec_id"), batch.column("label"), batch.column("v"), batch.column("now"), _lists(codes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "v", "before", "now"])

    return vectors.select("vec_id", "label", "v", "now").mapInArrow(run, ASSIGNED)


def deltas(rows: DataFrame, entries: int, length: int, parts: int) -> DataFrame:
    """part, entry, place in the part, total and n: what the changed parts of ``rows`` add to the running sums, a row per task and place at most.

    A part that no entry held before (``before`` is null) only adds.
    """
    names = ["part", "entry", "place", "total", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((entries, length), dtype=np.int64), np.zeros((entries, parts), dtype=np.int64)
        for batch in batches:
            x, now = _matrix(batch, "v", length), _matrix(batch, "now", parts)
            known = batch.column("before").is_valid().to_numpy(zero_copy_only=False)
            before = np.full_like(now, -1)
            before[known] = batch.column("before").drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
            for j, (low, high) in enumerate(bounds(length, parts)):
                moved = np.flatnonzero(before[:, j] != now[:, j])
                left = moved[before[moved, j] >= 0]
                np.add.at(total[:, low:high], now[moved, j], x[moved, low:high])
                np.subtract.at(total[:, low:high], before[left, j], x[left, low:high])
                n[:, j] += np.bincount(now[moved, j], minlength=entries) - np.bincount(before[left, j], minlength=entries)
        for j, (low, high) in enumerate(bounds(length, parts)):
            # place -1 carries the number of parts
            block = np.concatenate([n[:, j : j + 1], total[:, low:high]], axis=1)
            entry, place = np.nonzero(block)
            amount = block[entry, place]
            count = np.where(place == 0, amount, 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), j), pa.int32()), pa.array(entry, pa.int32()), pa.array(place - 1, pa.int32()), pa.array(amount - count, pa.int64()), pa.array(count, pa.int64())], names=names)

    return rows.select("v", "before", "now").mapInArrow(run, DELTAS)


def updated(books: Codebooks, sums: DataFrame) -> Codebooks:
    """Each entry the floor of its sum by its number, unused ones as they are; ``sums`` has a row per component of an entry."""
    entries = books.entries.copy()
    rows = sums.collect()  # entries times (length + parts) rows at most
    n = {(r["part"], r["entry"]): r["n"] for r in rows if r["place"] < 0}
    for (part, entry), count in n.items():
        if count:
            low, high = books.bounds[part]
            entries[entry, low:high] = 0
    for r in rows:
        if r["place"] >= 0 and n.get((r["part"], r["entry"])):
            entries[r["entry"], books.bounds[r["part"]][0] + r["place"]] = r["total"] // n[r["part"], r["entry"]]
    return Codebooks(entries, len(books.bounds))


def first_entries(vectors: DataFrame, entries: int) -> list[list[int]]:
    """The vectors of the ``entries`` smallest vec_ids, ascending; of each vec_id the least."""
    ids = [r["vec_id"] for r in vectors.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    known = [i for i in ids if i is not None]
    chosen = F.col("vec_id").isin(known) if len(known) == len(ids) else F.col("vec_id").isin(known) | F.col("vec_id").isNull()
    rows = vectors.filter(chosen).groupBy("vec_id").agg(F.min("v").alias("v")).collect() if ids else []
    by_id = {r["vec_id"]: list(r["v"]) for r in rows}
    return [by_id[i] for i in ids]


def trained(rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """The stored vectors (vec_id, label, v, before, now) after the last round, and the codebooks to assign them to."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding").filter(finite(F.col("embedding")))
    state = written(kept.select("vec_id", "label", whole.alias("v"), F.lit(None).cast("array<int>").alias("now")))
    first = first_entries(state, entries)
    if not first:
        return state, None
    length = len(first[0])
    state = state.filter(F.size("v") == length)
    own = [v for v in first if len(v) == length]
    books = Codebooks(np.array(own, dtype=np.int64).reshape(len(own), length), parts)
    sums = state.sparkSession.createDataFrame([], DELTAS)
    for _ in range(rounds):
        state = written(assigned(state, books, length, parts))
        every = sums.unionByName(deltas(state, len(books.entries), length, parts))
        sums = written(every.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
        books = updated(books, sums)
    return state, books


def coded(rows: DataFrame, **options: int) -> DataFrame:
    """vec_id, label, code, error and codebooks_sha256 of every vector that is kept."""
    state, books = trained(rows, **options)
    kind = "vec_id long, label int, code string, error long, codebooks_sha256 string"
    if books is None:
        return state.sparkSession.createDataFrame([], kind)
    length, digest = books.entries.shape[1], books.sha256()
    sent = state.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = sent.value.assign(_matrix(batch, "v", length))
            raw, width = codes.astype(np.uint8).tobytes(), codes.shape[1]
            text = [raw[i * width : (i + 1) * width].hex() for i in range(len(codes))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error, pa.int64()), pa.array([digest] * len(text), pa.string())], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    return state.select("vec_id", "label", "v").mapInArrow(run, kind)


def with_label_errors(rows: DataFrame, *, most_broadcast: int = 50_000, salts: int = 16) -> DataFrame:
    """``rows`` (of ``coded``) with the errors summed over equal labels.

    Up to ``most_broadcast`` labels their sums are broadcast; beyond that rows of one label are dealt to ``salts`` tasks.
    """
    rows = written(rows)
    totals = written(rows.groupBy("label").agg(F.sum("error").alias("label_error")))
    if totals.count() <= most_broadcast:
        out = rows.alias("r").join(F.broadcast(totals.alias("t")), F.col("r.label").eqNullSafe(F.col("t.label")))
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)))
        each = totals.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        out = salted.alias("r").join(each.alias("t"), F.col("r.label").eqNullSafe(F.col("t.label")) & (F.col("r.salt") == F.col("t.salt")))
    return out.select("r.vec_id", "r.code", "r.error", "t.label_error", "r.codebooks_sha256")
