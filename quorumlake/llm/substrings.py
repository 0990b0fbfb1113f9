"""Substring dedup over prefix-partitioned suffix trees.

A window of 50 words is anchored where the least hash of its 10-word runs
stands first, so equal windows are anchored alike. About 20 neighbouring
windows share an anchor, and only anchors give suffixes: a suffix has the words
from its anchor on, and the words before it that its windows reach.

1. Only anchors that stand in several documents can repeat; others are left
   out. Later copies of a whole text are settled by the text's digest.
2. Suffixes are dealt to groups by prefixes of variable length. The windows of
   a suffix begin 0 to 40 words before its anchor, so all of them have 10 words
   in common, its first prefix. Where one holds more suffixes than fit in
   memory its windows are halved by where they begin: each half has more words
   in common, at last all 50. A prefix of 50 words that doesn't fit even then is
   a window repeated very often: its node is formed by partial aggregation.
3. A group's subtree is built from its suffixes in order of their words and the
   number of words that each two neighbours have in common: a node of depth d is
   a run of suffixes with d words in common. A window that begins o words before
   the prefix repeats below a node of depth 50 - o, among the suffixes that have
   the o words before in common too. So every depth is cut once, deep nodes give
   the repeats, and each is as long as it can be to the left: windows of a suffix
   that repeat in a document of a smaller doc_id are joined into the longest
   stretches of words, which are removed as intervals.

Defined cases: a null text has no words; documents of fewer than 50 words lose
none; rows of one doc_id remove nothing from each other; a null doc_id counts
as larger than all others; equal rows are worked on once; very long texts are
worked on whole; of windows in documents of one smallest doc_id all stay; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm import words
from quorumlake.llm.common import written

WINDOW, SEED_WORDS = 50, 10
#: Tasks to which a hot window's suffixes are spread.
SALTS = 32
#: Suffixes that a group may hold, about.
GROUP = 20_000
NO_ID = (1 << 63) - 1
SUFFIX = "id long, tie long, place int, low int, high int, key long, words binary"
UPPER, INDEX = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def anchored(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each window is anchored, and the hash of the short run there.

    Runs are compared by 32 bits of their hashes and then by place, which equal windows do alike.
    """
    seed = min(SEED_WORDS, window)
    runs = words.mixed(words.rolling(hashes, seed))
    least = words.sliding_min((runs & UPPER) | np.arange(len(runs), dtype=np.uint64), window - seed + 1)
    at = (least & INDEX).astype(np.int64)
    return at, runs[at]


def _runs(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where a run of equal values of one text begins."""
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero((values[1:] != values[:-1]) | (text[1:] != text[:-1])) + 1))


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, tie, anchors: the distinct anchors of each document's windows; documents without windows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, value = [], []
            for first, data, offsets in words.slabs(batch.column(2)):
                hashes, counts = words.word_hashes(data, offsets)
                start, text = words.windows_within(counts, window)
                found = anchored(hashes, window)[1][start] if len(start) else hashes[:0]
                at = _runs(found, text)
                row.append(text[at] + first)
                value.append(found[at])
            rows, values = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (row, value))
            order = np.lexsort((values, rows))
            rows, values = rows[order], values[order]
            at = _runs(values, rows)
            rows, values = rows[at], values[at]
            kept, starts = np.unique(rows, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(_signed(values)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), batch.column(1).take(pa.array(kept)), lists], names=["id", "tie", "anchors"])

    return docs.select("id", "tie", "text").mapInArrow(run, "id long, tie long, anchors array<long>")


def _stretches(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """``size`` values from each ``start``, as bytes."""
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
    bounds = pa.py_buffer(np.concatenate(([0], ends * 8)).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, bounds, pa.py_buffer(np.ascontiguousarray(values[at]).tobytes())])


def suffixes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, tie, place, low, high, key, words of the anchors of ``docs`` that are of the row's ``shared``.

    The suffix's windows begin ``low`` to ``high`` words before its anchor, which stands at ``place``; ``words`` has the hashes
    of all words that they reach, and ``key`` says what they have in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column(3)
            flat = shared.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owner = np.repeat(np.arange(len(shared)), np.asarray(shared.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64))
            scramble = lambda value, row: words.mixed(value + row.astype(np.uint64) * words.OTHER_BASE)
            known = np.sort(scramble(flat, owner))
            for first, data, offsets in words.slabs(batch.column(2)):
                hashes, counts = words.word_hashes(data, offsets)
                start, text = words.windows_within(counts, window)
                if not len(start) or not len(known):
                    continue
                place, value = anchored(hashes, window)
                place, value = place[start], value[start]
                at = _runs(place, text)  # a suffix: the windows of one text that have one anchor
                last = np.append(at[1:], len(start)) - 1
                key = scramble(value[at], text[at] + first)
                found = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                at, last = at[found], last[found]
                if not len(at):
                    continue
                anchor, high, low = place[at], place[at] - start[at], place[last] - start[last]
                rows = pa.array(text[at] + first)
                stretch = _stretches(hashes, anchor - high, window - low + high)
                own = (anchor - counts[text[at]]).astype(np.int32)
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(own), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(_signed(value[at])), stretch]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "tie", "place", "low", "high", "key", "words"])

    return docs.select("id", "tie", "text", "shared").mapInArrow(run, SUFFIX)


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of ``words``, and where each row's begin."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint64, count=int(bounds[-1]) // 8)
    return data, bounds // 8


def _folded(values: np.ndarray, base: np.uint64) -> np.ndarray:
    """A polynomial hash of each row of ``values``."""
    out = np.zeros(len(values), dtype=np.uint64)
    for column in values.T:
        out = out * base + column
    return words.mixed(out)


def halved(suffix: DataFrame, parts: list[tuple[int, int]], window: int) -> DataFrame:
    """``suffix`` with its windows dealt to ``parts``, ranges of where they begin before the anchor, each with what its windows have in common as key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, low, high = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3, 4))
            data, begin = _values(batch.column(6))
            for number, (a, b) in enumerate(parts):
                own = np.flatnonzero((low <= b) & (high >= a))
                if not len(own):
                    continue
                new_low, new_high = np.maximum(low[own], a), np.minimum(high[own], b)
                anchor = begin[own] + high[own]
                common = data[(anchor - a)[:, None] + np.arange(window - b + a)]
                rows = pa.array(own)
                stretch = _stretches(data, anchor - new_high, window - new_low + new_high)
                columns = [*(batch.column(c).take(rows) for c in range(3)), pa.array(new_low.astype(np.int32)), pa.array(new_high.astype(np.int32)), pa.array(_signed(_folded(common, words.BASE))), stretch, pa.array(np.full(len(own), number, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "tie", "place", "low", "high", "key", "words", "half"])

    return suffix.select("id", "tie", "place", "low", "high", "key", "words").mapInArrow(run, SUFFIX + ", half int")


class Tree(NamedTuple):
    """Suffixes in order of their words, and how many words each has in common with the one before it."""

    order: np.ndarray
    common: np.ndarray

    def node(self, depth: int) -> np.ndarray:
        """The number of the node of ``depth`` below which each suffix, in order, stands; a suffix alone has its own."""
        return np.concatenate(([0], np.cumsum(self.common < depth))) if len(self.order) else np.zeros(0, dtype=np.int64)


def suffix_tree(prefixes: np.ndarray) -> Tree:
    """The tree of the rows of ``prefixes``, the words of a suffix each."""
    order = np.lexsort(prefixes.T[::-1])
    same = prefixes[order[1:]] == prefixes[order[:-1]]
    return Tree(order, np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64))


def repeating(ids: np.ndarray, low: np.ndarray, high: np.ndarray, after: np.ndarray, before: np.ndarray, first: int) -> np.ndarray:
    """For each suffix, and each beginning ``first``, ``first`` + 1, ... words before its anchor, whether the window there is also one of a smaller id.

    ``after`` has the words from ``first`` before the anchor on, ``before`` those further before it, the nearest first.
    """
    window, reach = after.shape[1], before.shape[1]
    tree = suffix_tree(after)
    ids, low, high = ids[tree.order], low[tree.order], high[tree.order]
    context = np.zeros(len(ids), dtype=np.uint64)
    out = np.zeros((len(ids), reach + 1), dtype=bool)
    for o in range(reach + 1):
        if o:
            context = words.mixed(context * words.BASE + before[tree.order, o - 1])
        own = np.flatnonzero((low <= first + o) & (high >= first + o))
        if not len(own):
            continue
        node, left = tree.node(window - o)[own], context[own]
        by = np.lexsort((left, node))
        edge = np.concatenate(([True], (node[by][1:] != node[by][:-1]) | (left[by][1:] != left[by][:-1])))
        at = np.flatnonzero(edge)
        least = np.minimum.reduceat(ids[own[by]], at)
        later = ids[own[by]] > np.repeat(least, np.diff(np.append(at, len(by))))
        out[tree.order[own[by[later]]], o] = True
    return out


def _repeats(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """id, tie, start, end: the longest stretches of words of a group's suffixes that are made of repeated windows."""
    first, last = int(rows["first"].iloc[0]), int(rows["last"].iloc[0])
    ids, place, low, high = (rows[c].to_numpy().astype(np.int64) for c in ("id", "place", "low", "high"))
    data, begin = _values(pa.array(rows["words"], pa.large_binary()))
    base, alone = begin[:-1] + high - first, np.uint64(1 << 63) + np.arange(len(rows), dtype=np.uint64)

    def taken(step: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The words at ``step`` from the prefix's first; beyond what a suffix has, a word that no other has."""
        at = base[:, None] + step
        there = np.arange(len(step)) < size[:, None]
        return np.where(there, data[np.clip(at, 0, len(data) - 1)], alone[:, None])

    found = repeating(ids, low, high, taken(np.arange(window), window - low + first), taken(-1 - np.arange(last - first), high - first), first)
    padded = np.zeros((len(rows), found.shape[1] + 2), dtype=np.int8)
    padded[:, 1:-1] = found
    step = np.diff(padded, axis=1)
    row, opens = np.nonzero(step == 1)
    _, closes = np.nonzero(step == -1)
    # a run of beginnings, the farthest before the anchor of which starts the stretch
    start, end = place[row] - (first + closes - 1), place[row] - (first + opens) + window
    return pd.DataFrame({"id": ids[row], "tie": rows["tie"].to_numpy()[row], "start": start.astype(np.int32), "end": end.astype(np.int32)})


SPANS = "id long, tie long, start int, end int"


def dealt(suffix: DataFrame, group: int, window: int = WINDOW) -> tuple[DataFrame, DataFrame | None]:
    """``suffix`` with its group (first, last, part), and the suffixes of windows that are too many for a group, if there are any.

    ``first`` to ``last`` is where the windows begin before the anchor. Prefixes that hold too many suffixes, of which there are
    at most rows / ``group`` in a round, are the only ones that go on to the next.
    """
    ranges, out = [(0, window - min(SEED_WORDS, window))], []
    rows = suffix.withColumn("half", F.lit(0))
    while True:
        of = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in ranges]), F.col("half") + 1)  # noqa: B023, E731
        rows = rows.withColumns({"first": of(0), "last": of(1)}).drop("half")
        per = rows.groupBy("first", "last", "key").agg(F.count(F.lit(1)).alias("n"))
        full = written(per.filter(F.col("n") > group))
        parts = rows.groupBy("first", "last").agg(F.ceil(F.count(F.lit(1)) / group).alias("parts"))
        some = not full.isEmpty()
        here = rows.join(full.select("first", "last", "key"), ["first", "last", "key"], "left_anti") if some else rows
        out.append(here.join(F.broadcast(parts), ["first", "last"]).withColumn("part", F.pmod(F.xxhash64("key"), "parts")).drop("parts"))  # a row a range
        if not some:
            return functools.reduce(DataFrame.unionByName, out), None
        hot = rows.join(full.select("first", "last", "key"), ["first", "last", "key"], "left_semi")
        if all(a == b for a, b in ranges):
            return functools.reduce(DataFrame.unionByName, out), hot
        ranges = [r for a, b in ranges for r in ([(a, (a + b) // 2), ((a + b) // 2 + 1, b)] if a < b else [(a, b)])]
        rows = written(halved(hot, ranges, window))


def hot_windows(suffix: DataFrame, window: int) -> DataFrame:
    """id, tie, start, h1, h2 of suffixes that have one window each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin = _values(batch.column(4))
            own = data[begin[:-1, None] + np.arange(window)]
            start = (batch.column(2).to_numpy(zero_copy_only=False) - batch.column(3).to_numpy(zero_copy_only=False)).astype(np.int32)
            columns = [batch.column(0), batch.column(1), pa.array(start), pa.array(_signed(_folded(own, words.BASE))), pa.array(_signed(_folded(own, words.OTHER_BASE)))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "tie", "start", "h1", "h2"])

    return suffix.select("id", "tie", "place", "high", "words").mapInArrow(run, "id long, tie long, start int, h1 long, h2 long")


def repeated(suffix: DataFrame, group: int = GROUP, window: int = WINDOW) -> DataFrame:
    """id, tie, start, end: stretches of words made of windows that also start in a document of a smaller id."""
    rows, hot = dealt(suffix, group, window)
    small = (
        rows.select("id", "tie", "place", "low", "high", "words", "first", "last", "part")
        .groupBy("first", "last", "part")
        .applyInPandas(lambda frame: _repeats(frame, window), SPANS)
    )
    if hot is None:
        return small
    large = written(hot_windows(hot, window).withColumn("salt", F.pmod(F.xxhash64("id", "tie", "start"), F.lit(SALTS))))
    nodes = large.groupBy("h1", "h2").agg(F.min("id").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    late = large.join(nodes, ["h1", "h2", "salt"]).filter("id > least")
    return small.unionByName(late.select("id", "tie", "start", (F.col("start") + window).alias("end")))


def dedup(docs: DataFrame, *, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = own.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("tie"), "doc_id", "text")
    # equal rows become one before a join, so that none is a key of very many
    once = keyed.groupBy("id", "tie").agg(F.max("doc_id").alias("doc_id"), F.max("text").alias("text"), F.count(F.lit(1)).alias("rows"))

    digests = keyed.select("id", "tie", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min(F.struct("id", "tie")).alias("first")).select("first.*")
    found = written(anchors(keyed, window).join(firsts, ["id", "tie"], "left_semi").select("id", "tie", F.explode("anchors").alias("anchor")).distinct())
    common = found.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("anchor")
    shared = found.join(common, "anchor", "left_semi").groupBy("id", "tie").agg(F.collect_list("anchor").alias("shared"))
    suffix = written(suffixes(once.join(shared, ["id", "tie"]), window))
    spans = repeated(suffix, group, window).groupBy("id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    copies = digests.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    copied = digests.join(copies, "digest").filter("id > first").select("id", "tie", F.lit(True).alias("copied")).distinct()
    marks = spans.join(copied, ["id", "tie"], "full")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest = [], [], []
            for text, start, end, copy in zip(batch.column(1), batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                own_words = text.as_py().encode().split()
                n = len(own_words)
                if copy and n >= window:
                    kept: list[bytes] = []
                elif start.is_valid:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, start.values.to_numpy(), 1)
                    np.add.at(edge, end.values.to_numpy(), -1)
                    kept = [own_words[k] for k in np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()]
                else:
                    kept = own_words
                n_words.append(n)
                n_removed.append(n - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), batch.column(5)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "rows"])

    return (
        once.join(marks, ["id", "tie"], "left")
        .select("doc_id", "text", "spans.start", "spans.end", "copied", "rows")
        .mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, rows long")
        .withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
        .drop("rows", "row")
    )
