"""Near-duplicate detection by Order MinHash, verified by banded alignment.

1. Equal texts are one class, by digest; all further work is on classes.
2. A class's five-word k-mers get their occurrence numbers. Each of
   ``SKETCHES`` hash functions selects the ``LEAST`` minimal ones and hashes
   them in text order: classes that share such a tuple meet in a bucket.
   Tuples say little of short texts, so classes of at most ``SHORT`` k-mers
   also meet by their rarest ones: of n k-mers, similar texts share one of the
   n - 0.8 n + 1 that come first in a common order. None of their pairs is missed.
3. A bucket has two centres: the member that meets most others over all
   buckets, and one drawn by hash; they are compared with the other members. A link stands if a banded alignment
   of the k-mers finds a similarity of ``SIMILARITY`` or more: aligned k-mers
   in order over all k-mers of both. Links make groups.
4. Members of a bucket that are in different groups after that are compared
   across groups, so that no candidate is left out; buckets of one group, as
   those of many near copies are, need no pairs.

Before texts are fetched, a pair's overlap is bounded from the ``BOTTOM`` least
hashes of each text's numbered k-mers and their number, inside the join that
finds the pair: pairs that can't reach the threshold go no further. For texts
of more k-mers than that the overlap is also estimated, and pairs more than
``ERRORS`` standard errors below the threshold go no further either; with
``errors=None`` only the bound counts, which loses no pair.

A group is labelled by its smallest doc_id. Defined cases: a null text is near
nothing; texts of fewer than five words are one k-mer; a text without words is
near its equal copies only; very long texts are hashed and aligned whole; a
null doc_id is never a label if its group has another; equal rows share a
group; centres and buckets of equal rank are told apart by digest; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm import words
from quorumlake.llm.common import discard, written

K, SIMILARITY = 5, 0.8
#: Tuples of a text, and k-mers in each: at 0.8 a pair of long texts is missed once in about a thousand times.
SKETCHES, LEAST = 40, 8
#: K-mers of the texts that also meet by their rarest k-mers, so that their pairs are found exactly.
SHORT = 75
SEED = 0x51ED270B
#: Least hashes kept of a text, and the standard errors below the threshold at which an estimated overlap rules a pair out.
BOTTOM, ERRORS = 400, 4.0


def ratio(least: float) -> Fraction:
    """A threshold as the fraction that it is written as: 0.8 is 4/5."""
    return Fraction(str(least))


def kmer_hashes(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of a text's k-mers in order; a shorter text is one k-mer."""
    if len(hashes) < k:
        return words.rolling(hashes, len(hashes)) if len(hashes) else hashes
    return words.rolling(hashes, k)


def numbered(kmers: np.ndarray) -> np.ndarray:
    """K-mers with their occurrence numbers, as scrambled hashes in text order."""
    order = np.argsort(kmers, kind="stable")
    s = kmers[order]
    at = np.arange(len(s))
    opens = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, dtype=bool)
    number = np.empty(len(s), dtype=np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(opens, at, 0))
    return words.mixed(kmers + number * words.OTHER_BASE)


def sketch(kmers: np.ndarray, salts: np.ndarray, least: int = LEAST, slab: int = 4096) -> np.ndarray:
    """A tuple hash for each salt: the ``least`` minimal numbered k-mers in text order."""
    x = numbered(kmers)
    out = np.empty(len(salts), dtype=np.uint64)
    step = max(1, min(len(salts), slab * 64 // max(1, len(x))))
    for at in range(0, len(salts), step):
        scored = (x[None, :] ^ salts[at : at + step, None]) * words.BASE
        scored ^= scored >> np.uint64(32)
        scored *= words.OTHER_BASE
        if len(x) > least:
            place = np.sort(np.argpartition(scored, least, axis=1)[:, :least], axis=1)
            chosen = x[place]
        else:
            chosen = np.broadcast_to(x, scored.shape)
        total = salts[at : at + step].copy()
        for j in range(chosen.shape[1]):
            total = words.mixed(total * words.BASE + chosen[:, j])
        out[at : at + step] = total
    return out


def aligned(a: list[int], b: list[int], most: int) -> int:
    """Length of the longest common subsequence if at most ``most`` elements of both lie outside it, else -1.

    Diagonals within the band are followed as far as they reach, for 0, 1, 2, ... elements left out.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return -1
    reach = {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or k != d and reach[k - 1] < reach[k + 1] else reach[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            reach[k] = x
            if x >= n and y >= m:
                return (n + m - d) // 2
    return -1


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the k-mers aligned in order are ``least`` of all k-mers of both, or more."""
    n, m = len(a), len(b)
    share = ratio(least)
    part, whole = share.numerator, share.denominator
    need = -(-part * (n + m) // (part + whole)) if n and m else 1  # common k-mers: c / (n + m - c) >= least, in whole numbers
    if min(n, m) < need:
        return False
    a, b = a.tolist(), b.tolist()
    if sum((Counter(a) & Counter(b)).values()) < need:  # not even in any order
        return False
    common = aligned(a, b, n + m - 2 * need)
    return common >= 0 and common * whole >= part * (n + m - common)


def bottom(kmers: np.ndarray, count: int = BOTTOM) -> np.ndarray:
    """The least different hashes, of 31 bits, of the numbered k-mers, ascending."""
    return np.unique((numbered(kmers) >> np.uint64(33)).astype(np.int32))[:count]


def sketches(texts: DataFrame, k: int = K, count: int = SKETCHES, least: int = LEAST) -> DataFrame:
    """doc_id, digest, buckets, sample, short of each text that has words.

    These are its tuples, its number of k-mers and their least hashes, and all numbered k-mers of a short text.
    """
    salts = words.mixed(np.arange(SEED, SEED + count, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, buckets, bottoms, sizes, shorts = [], [], [], [], []
            for first, data, offsets in words.slabs(batch.column(2)):
                hashes, counts = words.word_hashes(data, offsets)
                for i in range(len(counts) - 1):
                    if counts[i + 1] > counts[i]:
                        kmers = kmer_hashes(hashes[counts[i] : counts[i + 1]], k)
                        rows.append(first + i)
                        buckets.append(sketch(kmers, salts, least))
                        bottoms.append(bottom(kmers))
                        sizes.append(len(kmers))
                        shorts.append(numbered(kmers).view(np.int64) if len(kmers) <= SHORT else None)
            values = np.concatenate(buckets).view(np.int64) if buckets else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * count, pa.int32()), pa.array(values))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in bottoms], dtype=np.int64)))
            lows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bottoms) if bottoms else np.zeros(0, dtype=np.int32)))
            sample = pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), lows], names=["kmers", "bottom"])
            kept = pa.array(rows, pa.int64())
            columns = [batch.column(0).take(kept), batch.column(1).take(kept), lists, sample, pa.array(shorts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "buckets", "sample", "short"])

    return texts.select("doc_id", "digest", "text").mapInArrow(run, "doc_id long, digest binary, buckets array<long>, sample struct<kmers: int, bottom: array<int>>, short array<long>")


def rarest(sketched: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """digest, rare: the k-mers of each short text by which it meets all similar short texts.

    The common order is by the number of short texts that hold a k-mer, so that the buckets are small.
    """
    share = ratio(least)
    each = sketched.filter("short is not null").select("digest", F.explode("short").alias("kmer"))
    held = each.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(held, "kmer").groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("n", "kmer"))).alias("all"))
    # of n k-mers, similar texts have ceil(least * n) in common
    first = F.size("all") - F.expr(f"(size(all) * {share.numerator}L + {share.denominator - 1}L) div {share.denominator}L").cast("int") + 1
    met = F.filter(F.slice("all", F.lit(1), first), lambda x: x["n"] > 1)
    return ordered.select("digest", F.transform(met, lambda x: x["kmer"]).alias("rare"))


def of_firsts(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """One of the rows of each class: that of its first document.

    Joined by document and digest together, so that a text with very many copies is not one key.
    """
    own = firsts.select(F.col("first").alias("_first"), F.col("digest").alias("_digest"))
    return rows.join(own, rows["doc_id"].eqNullSafe(own["_first"]) & (rows["digest"] == own["_digest"]), "left_semi").dropDuplicates(["doc_id", "digest"])


def may_be_similar(a: Column, b: Column, least: float = SIMILARITY, errors: float | None = ERRORS) -> Column:
    """Whether two texts can be similar by their samples; without ``errors``, false for no pair that is.

    Up to the lesser of both last hashes, what two texts have in common stands in both samples. Of what
    is not in the sample that ends there they can have all in common, and no more. With ``errors``, of the
    larger text's least hashes those that the other text has too are also taken as a hypergeometric draw.
    """
    share = ratio(least)
    part, whole = share.numerator, share.denominator
    reaches = lambda common: F.lit(part) * (a["kmers"] + b["kmers"]) <= F.lit(part + whole) * common
    last = lambda x: F.when(F.size(x["bottom"]) >= BOTTOM, F.element_at(x["bottom"], -1).cast("long")).otherwise(F.lit(1 << 31))
    rest = lambda x: x["kmers"] - F.size(x["bottom"])
    unseen = F.when(last(a) < last(b), rest(a)).when(last(b) < last(a), rest(b)).otherwise(F.least(rest(a), rest(b)))
    common = F.size(F.array_intersect(a["bottom"], b["bottom"]))
    possible = reaches(F.least(a["kmers"], b["kmers"])) & reaches(common + unseen)
    if errors is None:
        return possible
    most = F.greatest(a["kmers"], b["kmers"])
    drawn, needed = F.least(most, F.lit(BOTTOM)), (a["kmers"] + b["kmers"]) * (least / (1 + least)) / most
    error = F.sqrt(drawn * needed * F.greatest(1 - needed, F.lit(0.0)) * (1 - drawn / most))
    return possible & ((most <= BOTTOM) | (common >= drawn * needed - errors * error - 1))


def verified(pairs: DataFrame, texts: DataFrame, firsts: DataFrame, k: int = K, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of digests whose texts are similar; only the texts of pairs are fetched."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            of: dict[bytes, np.ndarray] = {}

            def kmers(digest: bytes, text: str) -> np.ndarray:
                if digest not in of:
                    data = np.frombuffer(text.encode(), dtype=np.uint8)
                    of[digest] = kmer_hashes(words.word_hashes(data, np.array([0, len(data)]))[0], k)
                return of[digest]

            keep = [similar(kmers(a, s), kmers(b, t), least) for a, b, s, t in zip(frame["a"], frame["b"], frame["text_a"], frame["text_b"], strict=True)]
            yield frame.loc[keep, ["a", "b"]]

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    texts = written(of_firsts(texts, firsts.join(wanted, "digest", "left_semi")).select("digest", "text"))
    both = pairs.join(texts.withColumnsRenamed({"digest": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"digest": "b", "text": "text_b"}), "b")
    out = written(both.select("a", "b", "text_a", "text_b").mapInPandas(run, "a binary, b binary"))
    discard(texts)
    return out


def contracted(edges: DataFrame, label: DataFrame) -> DataFrame:
    """The edges (a, b) between the labels of their ends, each once, without those inside a label."""
    ends = edges
    for end in ("a", "b"):
        of = label.select(F.col("node").alias(end), F.col("label").alias("_label"))
        ends = ends.join(of, end, "left").withColumn(end, F.coalesce("_label", end)).drop("_label")
    return written(ends.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def relabelled(label: DataFrame, further: DataFrame) -> DataFrame:
    """``label`` with its labels replaced by the labels that these have in ``further``."""
    onward = further.select(F.col("node").alias("label"), F.col("label").alias("_onward"))
    return label.join(onward, "label", "left").withColumn("label", F.coalesce("_onward", "label")).drop("_onward")


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node that each node of ``links`` (a, b) is connected to.

    Each round a node points to its least neighbour, if that is less than itself; the paths
    are halved until all point to their ends, and the edges left between ends go on: each
    round has far fewer.
    """
    edges, labels = written(links.select("a", "b").distinct()), None
    while True:
        near = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("least"))
        points, moved = written(near.select(F.col("a").alias("node"), F.least("a", "least").alias("label"))), True
        while moved:
            jumped = written(relabelled(points.withColumn("old", F.col("label")), points))
            points, moved = jumped.select("node", "label"), not jumped.filter("old != label").isEmpty()
        labels = points if labels is None else written(relabelled(labels, points))
        edges = contracted(edges, points)
        if edges.isEmpty():
            return labels


def near_duplicates(docs: DataFrame, *, k: int = K, similarity: float = SIMILARITY, count: int = SKETCHES, least: int = LEAST, errors: float | None = ERRORS) -> DataFrame:
    """doc_id, digest, group_id of every row of ``docs``; equal texts have one digest, near ones one group."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    members = own.select("doc_id", digest.alias("digest"))
    firsts = members.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"))
    texts = own.filter("text is not null").select("doc_id", digest.alias("digest"), "text")
    firsts = written(firsts)

    drawn = written(of_firsts(sketches(texts, k, count, least), firsts))
    buckets = F.when(F.col("rare").isNull(), F.col("buckets")).otherwise(F.array_union("buckets", "rare"))
    sketched = written(drawn.join(rarest(drawn, similarity), "digest", "left").select("digest", "sample", buckets.alias("buckets")))
    discard(drawn)
    samples = sketched.select("digest", "sample")
    found = sketched.select("digest", F.explode("buckets").alias("bucket"))
    shared = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = written(found.join(shared, "bucket"))
    degree = met.groupBy("digest").agg(F.sum("n").alias("degree"))
    best, drawn = F.max(F.struct("degree", "digest")), F.min(F.struct(F.xxhash64("bucket", "digest").alias("draw"), "digest"))
    two = met.join(degree, "digest").groupBy("bucket").agg(best.alias("best"), drawn.alias("drawn"))
    centres = two.select("bucket", F.explode(F.array_distinct(F.array("best.digest", "drawn.digest"))).alias("a"))
    pairs = met.join(centres, "bucket").filter("a != digest").select(F.least("a", "digest").alias("a"), F.greatest("a", "digest").alias("b")).distinct()
    with_a = pairs.join(samples.withColumnsRenamed({"digest": "a", "sample": "sample_a"}), "a")
    with_b = with_a.join(samples.withColumnsRenamed({"digest": "b", "sample": "sample_b"}), "b")
    stars = written(with_b.filter(may_be_similar(F.col("sample_a"), F.col("sample_b"), similarity, errors)).select("a", "b"))
    links = verified(stars, texts, firsts, k, similarity)

    # buckets that hold more than one group still: the pairs across groups that the stars didn't compare
    label = components(links)
    grouped = met.join(label.withColumnRenamed("node", "digest"), "digest", "left").select("bucket", "digest", F.coalesce("label", "digest").alias("label"))
    split = grouped.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("bucket")
    left = grouped.join(split, "bucket", "left_semi").join(sketched.select("digest", "sample", "buckets"), "digest")
    largest = left.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    left = written(left.join(largest, "bucket").withColumn("minor", F.expr("label != largest")).drop("largest"))
    discard(met, sketched)
    minor = left.filter("minor").select(*(F.col(c).alias(f"{c}_x") for c in ("bucket", "digest", "label", "sample", "buckets")))
    # a pair is taken in the first bucket that both are in, and once where both are outside the largest group
    once = (F.col("bucket") == F.array_min(F.array_intersect("buckets", "buckets_x"))) & (~F.col("minor") | (F.col("digest") < F.col("digest_x")))
    differ = (F.col("bucket") == F.col("bucket_x")) & (F.col("label") != F.col("label_x")) & once & may_be_similar(F.col("sample"), F.col("sample_x"), similarity, errors)
    across = minor.join(left, differ).select(F.least("digest_x", "digest").alias("a"), F.greatest("digest_x", "digest").alias("b"))
    rest = written(across.distinct().join(stars, ["a", "b"], "left_anti"))
    discard(left, stars)
    more = verified(rest, texts, firsts, k, similarity)

    further = components(contracted(more, label))
    nodes = firsts.join(label.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    nodes = relabelled(nodes, further)
    groups = nodes.groupBy("label").agg(F.min("first").alias("group_id"))
    by_class = nodes.join(groups, "label").select("digest", "group_id")
    group = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("group_id"))
    return members.join(by_class, "digest", "left").select("doc_id", F.lower(F.hex("digest")).alias("digest"), group.alias("group_id"))


def representatives(docs: DataFrame, **options: float) -> DataFrame:
    """The rows of ``docs`` of which each near-duplicate group keeps one: its first document.

    A null text, and a group without doc_id, keep their rows; rows that repeat the kept doc_id and text count once.
    """
    digest = F.lower(F.md5(F.col("text").cast("binary")))
    found = near_duplicates(docs, **options).filter("digest is not null and (doc_id <=> group_id)").select(F.col("digest").alias("kept_digest"), F.col("doc_id").alias("kept_id")).distinct()
    keyed = docs.withColumns({"kept_digest": digest})
    kept = keyed.join(found.withColumnRenamed("kept_digest", "kd"), (F.col("kept_digest") == F.col("kd")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    once = kept.dropDuplicates(["kept_digest", "doc_id"]).drop("kept_digest")
    return once.unionByName(docs.filter("text is null"))
