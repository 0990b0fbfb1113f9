"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted and optimised jointly. A shard's pieces
go longest first into the open bin that they leave least room in. A piece that
fits no open bin opens one of the size of least cost: of each permitted length,
the price per word of a bin filled with it and the longest pieces still to come
that fit. In the end each bin is cut down to the smallest permitted length that
holds its contents. The shard is also packed with the lengths up to each limit
alone, by this rule and by opening the longest, and the cheapest packing is
kept.

Defined cases: null and empty texts and other documents without words get one
row with no bin; documents longer than the largest length are cut into pieces
of it; equal rows are packed separately; pieces of one length go by doc_id,
copy and piece; of sizes of equal cost the smallest is opened, of equally cheap
packings the first is kept; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import numbered_copies, shards_for, word_count, written

#: Permitted sequence lengths, in words.
LENGTHS = (512, 1024, 2048, 4096)
#: Price of a bin besides its length: what each sequence costs on its own.
PER_BIN = 16


def price(length: int, per_bin: int = PER_BIN) -> int:
    return length + per_bin


def fill(size: int, length: int, left: Counter[int], mask: int) -> int:
    """Words of a bin of ``length`` with a piece of ``size`` and the longest pieces ``left`` that fit; ``mask`` has their sizes as bits."""
    room = length - size
    while mask := mask & ((2 << room) - 1):
        next_size = mask.bit_length() - 1
        room -= next_size * min(left[next_size], room // next_size)
        mask ^= 1 << next_size
    return length - room


def packing(sizes: Sequence[int], lengths: Sequence[int], limit: int, joint: bool, per_bin: int) -> tuple[int, list[int], list[int]]:
    """Cost, bin of each size and length of each bin, with bins of up to ``limit`` where a piece needs no longer one.

    ``joint`` opens the size of least cost, otherwise it is the longest.
    """
    left, coming = Counter(sizes), 0
    for size in left:
        coming |= 1 << size
    cut = dict(zip(range(1, lengths[-1] + 1), np.repeat(lengths, np.diff([0, *lengths])).tolist(), strict=True))
    room: dict[int, list[int]] = {}
    mask, where, filled = 0, [], []
    for size in sizes:
        left[size] -= 1
        if not left[size]:
            coming ^= 1 << size
        fits = mask >> size
        if fits:
            spare = size + (fits & -fits).bit_length() - 1
            bins = room[spare]
            b = bins.pop()
            if not bins:
                mask ^= 1 << spare
            filled[b] += size
            spare -= size
        else:
            allowed = [c for c in lengths if size <= c <= limit] or [cut[size]]
            if joint:
                words = [fill(size, c, left, coming) for c in allowed]
                spare = min(zip(allowed, words, strict=True), key=lambda x: (price(cut[x[1]], per_bin) / x[1], x[0]))[0] - size
            else:
                spare = allowed[-1] - size
            b = len(filled)
            filled.append(size)
        where.append(b)
        if spare:
            room.setdefault(spare, []).append(b)
            mask |= 1 << spare
    out = [cut[n] for n in filled]
    return sum(price(c, per_bin) for c in out), where, out


def best_fit(sizes: Sequence[int], lengths: Sequence[int], per_bin: int = PER_BIN) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each size, and the length of each bin. ``sizes`` are 1 to max(lengths), longest first."""
    lengths = sorted(lengths)
    tried = [packing(sizes, lengths, limit, joint, per_bin) for joint in (True, False) for limit in reversed(lengths)]
    _, where, cut = min(tried, key=lambda x: x[0])
    return np.array(where, dtype=np.int64), np.array(cut, dtype=np.int64)


def pack(docs: DataFrame, *, size: Column | None = None, lengths: Sequence[int] = LENGTHS, per_bin: int = PER_BIN, shard_pieces: int = 8192) -> DataFrame:
    """A row per piece: doc_id, copy, piece, start, n_words, bin_id, bin_length, bin_used, bin_start.

    ``size`` is the length of a document (its words by default); ``copy`` tells equal rows apart.
    """
    lengths, longest = sorted(int(x) for x in lengths), max(lengths)
    size = word_count(F.col("text")) if size is None else size
    ids = [F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("no_id")]  # pandas has no null integers
    sized = written(numbered_copies(docs.select(*ids, size.cast("long").alias("size")), "doc_id", "no_id", "size"))
    row = sized.agg(F.coalesce(F.sum(F.greatest(F.lit(1), F.ceil(F.col("size") / longest))), F.lit(0)).alias("n")).first()
    n_shards = shards_for(int(row["n"]), shard_pieces)
    pieces = (
        sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.expr(f"(size - 1) div {longest}")))))
        .withColumn("start", F.col("piece") * longest)
        .withColumn("n_words", F.least(F.lit(longest), F.col("size") - F.col("start")))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "copy"), F.lit(n_shards)).cast("int"))
        .drop("size")
    )

    def pack_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "doc_id", "no_id", "copy", "piece"], ascending=[False, True, True, True, True], ignore_index=True)
        real = int((rows["n_words"] > 0).sum())
        where, cut = best_fit(rows["n_words"].to_numpy()[:real].tolist(), lengths, per_bin)
        out = rows.assign(bin=-1, bin_length=0, bin_used=0, bin_start=0)
        if real:
            words = rows["n_words"].iloc[:real]
            by = words.groupby(where)
            out.loc[: real - 1, "bin"] = where
            out.loc[: real - 1, "bin_length"] = cut[where]
            out.loc[: real - 1, "bin_used"] = by.transform("sum").to_numpy()
            out.loc[: real - 1, "bin_start"] = (by.cumsum() - words).to_numpy()
        return out

    packed = pieces.groupBy("shard").applyInPandas(
        pack_shard,
        "doc_id long, no_id boolean, copy long, piece long, start long, n_words long, shard int, bin long, bin_length long, bin_used long, bin_start long",
    )
    some = F.col("bin") >= 0
    return packed.select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "copy", "piece", "start", "n_words",
        F.when(some, F.format_string("%d-%d", "shard", "bin")).alias("bin_id"),
        *[F.when(some, F.col(c)).alias(c) for c in ("bin_length", "bin_used", "bin_start")],
    )
