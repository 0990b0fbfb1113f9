"""Mixing sources to target weights by Sainte-Laguë apportionment.

Equal-token blocks are apportioned by highest quotients: over the sources by
their targets, then, within a source, over its shards by their words, so that
each shard has an integer quota. The divisor that the quotients must reach is
bisected, for up to ``WHOLE`` parties in a task and for more by sums over a
table; the quotas are the same. What whole blocks leave of a quota is handed
out as part blocks, the parties that are farthest below first. A shard, of one
source and sized by the source's own documents, then takes its quota: stretches
of ``STRETCH`` blocks in seeded order, of the last one as many as are left.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; sources without words get target 0; equal rows are separate
documents; equal quotients go to the party that is first in order, of sources
by code point; very long texts are cut by blocks like all others; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlake.llm.common import numbered_copies, running, word_count, written

#: No source is repeated more often than this.
MAX_EPOCHS = 3
#: Weights by rank of the source, repeating.
WEIGHTS = (1, 2, 3)
#: Words of a block, the unit of quotas, and neighbouring blocks that are chosen together.
BLOCK, STRETCH = 8, 32
#: Parties that one task apportions; divisors that a pass over a table of more tries, and passes.
WHOLE, TRIED, PASSES = 4096, 64, 11
#: Divisors that differ by less than this part are not told apart: what lies between them goes by exact quotients.
CLOSE = 1e-9


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients votes/1, votes/3, votes/5, ..., at most ``caps`` each.

    The divisor below which the quotients win is bisected; ties go to the earlier party.
    """
    votes, caps = np.asarray(votes, dtype=float), np.asarray(caps, dtype=np.int64)
    seats = int(min(seats, caps[votes > 0].sum()))
    if seats <= 0:
        return np.zeros(len(votes), dtype=np.int64)
    won = lambda d: np.where(votes > 0, np.minimum(np.floor(votes / d + 0.5), caps), 0).astype(np.int64)
    low, high = votes[votes > 0].min() / (2.0 * seats + 2), 2.0 * votes.max() + 1
    while high > low * (1 + CLOSE / 8):
        middle = float(np.sqrt(low) * np.sqrt(high))
        if not low < middle < high:
            break
        low, high = (middle, high) if won(middle).sum() > seats else (low, middle)
    out = won(high * (1 + CLOSE))
    while (rest := seats - int(out.sum())) > 0:
        quotient = np.where((out < caps) & (votes > 0), votes / (2 * out + 1), -1.0)
        best = np.argsort(-quotient, kind="stable")[:rest]
        near = best[quotient[best] >= low / 2 * (1 - CLOSE)]
        out[near if len(near) else best[quotient[best] > 0][:1]] += 1
    return out


def part_blocks(goal: np.ndarray, given: np.ndarray, caps: np.ndarray, total: int) -> np.ndarray:
    """Words, in all ``total`` less those ``given``, by how far each party is below its ``goal``; at most ``caps`` with those given."""
    left = max(0, int(total) - int(given.sum()))
    out = np.zeros(len(given), dtype=np.int64)
    for room in (np.clip(np.floor(goal).astype(np.int64), given, caps) - given, caps - given):
        room = np.maximum(room - out, 0)
        order = np.argsort(-room, kind="stable")
        part = np.zeros(len(given), dtype=np.int64)
        part[order] = np.clip(left - (np.cumsum(room[order]) - room[order]), 0, room[order])
        out += part
        left -= int(part.sum())
    return out


def quotas(total: int, goal: np.ndarray, most: np.ndarray, block: int) -> np.ndarray:
    """``total`` words by blocks and part blocks, by the parties' ``goal``, at most ``most`` words each."""
    blocks = block * sainte_lague(goal, total // block, most // block)
    return blocks + part_blocks(goal, blocks, most, total)


class Taken(NamedTuple):
    """What a shard takes of its documents: all of them ``passes`` times, and further runs of words of each."""

    passes: int
    starts: list[list[int]]
    ends: list[list[int]]


def take_blocks(sizes: np.ndarray, quota: int, block: int, seed: int) -> Taken:
    """``quota`` words of a stream of documents cut into stretches of ``block`` words.

    Whole passes come first; the rest of the quota is stretches in seeded order,
    the last one in part.
    """
    sizes = sizes.astype(np.int64)
    words, n = int(sizes.sum()), len(sizes)
    none = [[] for _ in range(n)]
    if not words or not quota:
        return Taken(0, none, none)
    passes, rest = divmod(quota, words)
    if not rest:
        return Taken(passes, none, none)
    starts = np.arange(0, words, block, dtype=np.int64)
    lengths = np.minimum(block, words - starts)
    order = np.random.Generator(np.random.PCG64(seed)).permutation(len(starts))
    before = np.cumsum(lengths[order]) - lengths[order]
    used = np.zeros(len(starts), dtype=np.int64)
    used[order] = np.clip(rest - before, 0, lengths[order])
    # runs of the stream that are used, neighbouring stretches as one
    some = np.flatnonzero(used)
    low, high = starts[some], starts[some] + used[some]
    joined = low[1:] == high[:-1]
    low, high = low[np.concatenate(([True], ~joined))], high[np.concatenate((~joined, [True]))]
    points = np.concatenate(([0], np.cumsum(sizes)))
    first, last = np.searchsorted(high, points[:-1], side="right"), np.searchsorted(low, points[1:], side="left")
    of = lambda i: slice(first[i], last[i])
    own = [i for i in range(n) if sizes[i] and first[i] < last[i]]
    begin, end = [[] for _ in range(n)], [[] for _ in range(n)]
    for i in own:
        begin[i] = np.maximum(low[of(i)] - points[i], 0).tolist()
        end[i] = np.minimum(high[of(i)] - points[i], sizes[i]).tolist()
    return Taken(passes, begin, end)


def _seed(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "big")


def ranked_sources(sized: DataFrame, weights: tuple[int, ...], per_range: int = 100_000) -> DataFrame:
    """source, source_size, n, rank, weight: the sources by code point, null last, in ranges that are counted and then numbered."""
    order = F.col("source").isNull(), F.col("source")
    per = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    ranges = max(1, -(-per.count() // per_range))
    laid = written(per.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    counts = sorted((r["range"], r["count"]) for r in laid.groupBy("range").count().collect())  # a row per range
    before = {range_: sum(n for r, n in counts if r < range_) for range_, _ in counts}
    offset = F.coalesce(F.get(F.lit([before.get(k, 0) for k in range(max(before, default=-1) + 1)] or [0]), F.col("range")), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1 + offset
    weight = F.get(F.lit(list(weights)), (F.col("rank") % len(weights)).cast("int"))
    return written(laid.withColumn("rank", rank.cast("long")).withColumn("weight", weight.cast("long")).drop("range"))


def with_targets(sources: DataFrame, total: int, most: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` with target: shares of ``total`` by weight, each at most ``most`` times its size, the excess shared again by weight.

    The share of a unit of weight rises until no further source reaches its cap below it; each round is one sum over the sources.
    """
    cap = F.lit(most) * F.col("source_size")
    reaches = cap / F.col("weight")  # the share at which a source stands at its cap
    share, capped, left, weights = 0.0, -1, total, 0
    while True:
        row = sources.agg(
            F.count_if(reaches <= share).alias("capped"),
            F.coalesce(F.sum(F.when(reaches <= share, cap)), F.lit(0)).alias("given"),
            F.coalesce(F.sum(F.when(reaches > share, F.col("weight"))), F.lit(0)).alias("weights"),
        ).first()
        if row["capped"] == capped:
            break
        capped, left, weights = row["capped"], total - row["given"], row["weights"]
        if not weights:
            break
        share = max(share, left / weights)
    return sources.withColumn("target", F.when(reaches <= share, cap.cast("double")).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(float(max(1, weights)))))


def apportioned(parties: DataFrame, groups: list[str], block: int) -> DataFrame:
    """``parties`` (of a group with its words to give, ``total``; ``party``, ``goal``, ``most``) with each one's ``quota``."""

    def share(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("party")
        goal, most = rows["goal"].to_numpy(), rows["most"].to_numpy()
        return rows.assign(quota=quotas(int(rows["total"].iloc[0]), goal, most, block))[[*groups, "party", "quota"]]

    kinds = ", ".join(f"{c} {parties.schema[c].dataType.simpleString()}" for c in [*groups, "party"])
    return parties.select(*groups, "total", "party", "goal", "most").groupBy(*groups).applyInPandas(share, f"{kinds}, quota long")


def _won(votes: Column, divisor: Column, cap: Column) -> Column:
    return F.least(F.floor(votes / divisor + F.lit(0.5)), cap)


def seats_by_sums(parties: DataFrame, group: str) -> DataFrame:
    """``parties`` (``group``, party, votes, cap, seats of the group) with each one's blocks, as ``sainte_lague`` gives them.

    Every pass tries ``TRIED`` divisors of every group at once, a partial aggregate, and keeps the two between which the
    seats run out. Quotients that lie closer together than that are ranked in sorted ranges.
    """
    some = parties.filter("votes > 0")
    per = some.groupBy(group).agg(F.first("seats").alias("seats"), F.sum("cap").alias("caps"), F.min("votes").alias("least"), F.max("votes").alias("largest"))
    count = F.greatest(F.lit(0).cast("long"), F.least("seats", "caps"))
    bounds = written(per.select(group, count.alias("blocks_in_all"), (F.col("least") / (2.0 * count + 2)).alias("low"), (2.0 * F.col("largest") + 1).alias("high")))
    for _ in range(PASSES):
        step = F.pow(F.col("high") / F.col("low"), F.lit(1.0 / TRIED))
        tried = [F.col("low") * F.pow(step, F.lit(float(i))) for i in range(1, TRIED)]
        sums = some.join(bounds, group).groupBy(group, "blocks_in_all", "low", "high").agg(*[F.sum(_won(F.col("votes"), d, F.col("cap"))).alias(f"won_{i}") for i, d in enumerate(tried, 1)])
        # the last divisor that gives too many seats, and the one after it
        last = sum((F.when(F.col(f"won_{i}") > F.col("blocks_in_all"), 1).otherwise(0) for i in range(1, TRIED)), F.lit(0))
        at = lambda i: F.when(i == 0, F.col("low")).when(i == TRIED, F.col("high")).otherwise(F.col("low") * F.pow(step, i.cast("double")))
        bounds = written(sums.withColumn("last", last).select(group, "blocks_in_all", at(F.col("last")).alias("low"), at(F.col("last") + 1).alias("high")))
    sure = _won(F.col("votes"), F.col("high") * (1 + CLOSE), F.col("cap"))
    given = parties.join(bounds, group, "left").withColumn("blocks", F.when((F.col("votes") > 0) & (F.col("blocks_in_all") > 0), sure).otherwise(0).cast("long"))
    while True:
        given = written(given)
        short = given.groupBy(group).agg((F.first("blocks_in_all", ignorenulls=True) - F.sum("blocks")).alias("rest")).filter("rest > 0")
        quotient = F.col("votes") / (2 * F.col("blocks") + 1)
        near = given.filter((F.col("votes") > 0) & (F.col("blocks") < F.col("cap")) & (quotient >= F.col("low") / 2 * (1 - CLOSE)))
        ranked = running(near.join(short, group).select(group, "party", "rest", quotient.alias("quotient"), F.lit(1).cast("long").alias("one")), group, [F.col("quotient").desc(), F.col("party")], "one")
        more = written(ranked.filter("before < rest").select(group, "party", F.lit(1).cast("long").alias("more")))
        if more.isEmpty():
            return given.select(*parties.columns, "blocks")
        given = given.join(more, [group, "party"], "left").withColumn("blocks", F.col("blocks") + F.coalesce("more", F.lit(0))).drop("more")


def quotas_by_sums(parties: DataFrame, group: str, block: int) -> DataFrame:
    """``group``, party, quota as ``apportioned`` has them, for groups of any number of parties."""
    shaped = parties.withColumns({"votes": F.col("goal"), "cap": F.expr(f"most div {block}"), "seats": F.expr(f"total div {block}")})
    rows = seats_by_sums(shaped, group).withColumn("given", F.col("blocks") * block)
    left = rows.groupBy(group).agg(F.greatest(F.lit(0).cast("long"), F.first("total") - F.sum("given")).alias("left"))
    rows = rows.join(left, group).withColumn("extra", F.lit(0).cast("long"))
    # first up to the goal, then up to the most, where a party has the most room
    target = F.least(F.greatest(F.floor("goal"), F.col("given")), F.col("most"))
    for upto in (target, F.col("most")):
        room = F.greatest(F.lit(0).cast("long"), upto - F.col("given") - F.col("extra")).cast("long")
        ranked = running(rows.withColumn("room", room), group, [F.col("room").desc(), F.col("party")], "room")
        part = F.least(F.greatest(F.col("left") - F.col("before"), F.lit(0)), F.col("room")).cast("long")
        rows = written(ranked.withColumn("part", part).withColumn("extra", F.col("extra") + F.col("part")).drop("room", "before"))
        spent = rows.groupBy(group).agg(F.sum("part").alias("spent"))
        rows = rows.join(spent, group).withColumn("left", F.col("left") - F.col("spent")).drop("part", "spent")
    return rows.select(group, "party", (F.col("given") + F.col("extra")).alias("quota"))


def all_quotas(parties: DataFrame, group: str, block: int) -> DataFrame:
    """``group``, party, quota: groups of up to ``WHOLE`` parties in a task each, larger ones by sums; one rule for both."""
    parties = written(parties.select(group, "total", "party", "goal", "most"))
    sizes = parties.groupBy(group).agg((F.count(F.lit(1)) > WHOLE).alias("large"))
    if sizes.filter("large").isEmpty():
        return apportioned(parties, [group], block)
    sized = written(parties.join(sizes, group))
    return apportioned(sized.filter("not large").drop("large"), [group], block).unionByName(quotas_by_sums(sized.filter("large").drop("large"), group, block))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 17, shard_docs: int = 2000, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, passes, starts, ends and tie, a hash of the text, of every row of ``docs``.

    A row is taken ``passes`` times, and its words from each of ``starts`` to before each of ``ends`` once more: ``taken`` words in all.
    Sources, shards of about ``shard_docs`` documents of a source, and their quotas stay in tables; the driver sees sums.
    """
    ids = [F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("no_id")]  # pandas has no null integers
    sized = written(numbered_copies(docs.select(*ids, "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "doc_id", "no_id", "source", "size", "tie"))
    sources = ranked_sources(sized, weights)
    words = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    sources = with_targets(sources, words, max_epochs)
    most = F.lit(max_epochs) * F.col("source_size")
    parties = sources.select(F.lit(0).alias("all"), F.lit(words).cast("long").alias("total"), F.col("rank").alias("party"), F.col("target").alias("goal"), most.alias("most"))
    source_quotas = all_quotas(parties, "all", block).select(F.col("party").alias("rank"), F.col("quota").alias("total"))
    sources = sources.withColumn("n_shards", F.ceil(F.col("n") / shard_docs)).select(F.col("source").alias("_source"), "source_size", "target", "rank", "n_shards")
    ranked = (
        sized.join(sources, sized["source"].eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tie", "copy"), "n_shards"))
    )
    shards = ranked.groupBy("rank", "shard").agg(F.sum("size").alias("words")).join(source_quotas, "rank")
    goal = F.col("words").cast("double")
    parties = shards.select("rank", "total", F.col("shard").alias("party"), goal.alias("goal"), (F.lit(max_epochs) * F.col("words")).alias("most"))
    shard_quotas = all_quotas(parties, "rank", block).select("rank", F.col("party").alias("shard"), "quota")

    def choose(key: tuple, rows: pd.DataFrame, quota: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "doc_id", "tie", "copy"], na_position="last")
        size = rows["size"].to_numpy()
        got = take_blocks(size, int(quota["quota"].sum()), block * stretch, _seed(seed, *map(int, key)))
        parts = np.array([sum(b) - sum(a) for a, b in zip(got.starts, got.ends, strict=True)], dtype=np.int64)
        return rows.assign(taken=size * got.passes + parts, passes=got.passes, starts=got.starts, ends=got.ends).drop(columns=["rank", "shard", "copy", "place"])

    return (
        ranked.withColumn("place", F.xxhash64(F.lit(seed + 1), "doc_id", "tie", "copy"))
        .select("doc_id", "no_id", "source", "size", "source_size", "target", "tie", "rank", "shard", "copy", "place")
        .groupBy("rank", "shard")
        .cogroup(shard_quotas.groupBy("rank", "shard"))
        .applyInPandas(choose, "doc_id long, no_id boolean, source string, size long, source_size long, target double, tie long, taken long, passes long, starts array<long>, ends array<long>")
        .withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id")))
        .drop("no_id")
    )


_word = re.compile(r"[^\x20\x09-\x0D]+")


def run_of_words(text: str, start: int, end: int) -> str:
    """``text`` from its word ``start`` to before its word ``end``, as it stands there; all of it if these are all its words."""
    low, high, more = 0, len(text), False
    for k, m in enumerate(_word.finditer(text)):
        if k == start:
            low = m.start()
        if k == end - 1:
            high = m.end()
        if k >= end:
            more = True
            break
    return text[low:high] if start or more else text


def mixed_documents(docs: DataFrame, **options: int) -> DataFrame:
    """The mix as documents: each row of ``docs`` as often as the mix takes it whole, then each run of its words that the chosen blocks hold.

    Equal rows of which the same is taken are worked on once; n_chars, where there is one, is that of the text.
    """
    keys, what = ["doc_id", "source", "tie"], ["passes", "starts", "ends"]
    plan = mix(docs, **options).filter("taken > 0").groupBy(*keys, *what).agg(F.count(F.lit(1)).alias("rows"))
    plan = plan.withColumnsRenamed({c: f"plan_{c}" for c in (*keys, *what, "rows")})
    names, schema, at = docs.columns, docs.schema, docs.columns.index("text")
    once = docs.withColumn("plan_key", F.xxhash64("text")).dropDuplicates(["doc_id", "source", "plan_key"])
    joined = once.join(plan, [once[c].eqNullSafe(plan[f"plan_{k}"]) for c, k in zip(("doc_id", "source", "plan_key"), keys, strict=True)])
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passes, starts, ends = (batch.column(n + k).to_pylist() for k in range(3))
            for i in range(len(batch)):
                text = batch.column(at)[i].as_py()
                texts = ([text] if passes[i] else []) + [run_of_words(text, a, b) for a, b in zip(starts[i], ends[i], strict=True)]
                times = ([passes[i]] if passes[i] else []) + [1] * len(starts[i])
                again = pa.array([i] * len(texts), pa.int64())
                columns = [pa.array(texts, pa.string()) if k == at else batch.column(k).take(again) for k in range(n)]
                yield pa.RecordBatch.from_arrays([*columns, batch.column(n + 3).take(again), pa.array(times, pa.int64())], names=[*names, "plan_rows", "plan_times"])

    out = joined.select(*[once[c] for c in names], *[f"plan_{c}" for c in (*what, "rows")])
    wide = T.StructType([*schema, T.StructField("plan_rows", T.LongType()), T.StructField("plan_times", T.LongType())])
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("plan_rows") * F.col("plan_times")))
    out = out.mapInArrow(run, wide).withColumn("plan_rows", copies).drop("plan_rows", "plan_times")
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out
