"""Document fingerprints by Order MinHash, in Spark's own functions throughout.

A text's five-word k-mers get the number of their occurrence, so that a
repeated k-mer counts as often as it stands. The hashes of the numbered k-mers
fall into 64 bins; each bin selects its two minimal ones, keeps them in text
order and hashes the tuple. Two fingerprints agree in a bin if the same two
k-mers stand there in the same order: likeness is the part of the filled bins
that agree, and follows edit similarity rather than the bare set of k-mers.

Defined cases: a null text counts as empty; a text of fewer than five words is
one k-mer; a text without words has an empty fingerprint, like only another
empty one (1.0); very long texts, of up to 2**30 words, are read whole; ties of doc_id are
ordered by a hash of the text, and equal rows by their place in the input, so
that a range can end among them; a null doc_id comes last; a single document is its own next; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.llm.common import WORD

K = 5
#: A numbered k-mer is one long: 33 bits of hash, of which the upper 6 are its bin, then 30 bits of word position.
HASH_BITS, PLACE_BITS, BIN_SHIFT = 0x7FFFFFFFC0000000, 0x3FFFFFFF, 57
#: A bin's entry in a fingerprint: 6 bits of bin, 26 bits of the tuple's hash.
TUPLE_BITS, TUPLE_MASK = 26, 0x3FFFFFF


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def kmers(text: Column, k: int = K) -> Column:
    """Hashes of the k-mers of words, by position."""

    def of(h: Column) -> Column:
        many = F.transform(F.slice(h, F.lit(1), F.greatest(F.lit(0), F.size(h) - (k - 1))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))
        return F.when(F.size(h) >= k, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    return let(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)), of)


def numbered(hashes: Column) -> Column:
    """Hash and position of each k-mer with its occurrence number, as longs in no order."""
    label = lambda x, n, place: F.xxhash64(x.bitwiseAND(F.lit(HASH_BITS)), n).bitwiseAND(F.lit(HASH_BITS)).bitwiseOR(place.cast("long"))

    def of(h: Column) -> Column:
        once = F.transform(h, lambda x, i: label(x, F.lit(0).cast("long"), i))
        placed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(HASH_BITS)).bitwiseOR(i.cast("long"))))
        steps = F.filter(F.array(*[F.lit(1 << j) for j in range(29, -1, -1)]), lambda j: j < F.size(h))
        same = lambda a, b: F.shiftright(a, 30) == F.shiftright(b, 30)

        def count(s: Column, st: Column) -> Column:
            # equal k-mers stand together, in text order: how many of them stand before, by halving steps
            def before(v: Column, i: Column) -> Column:
                back = F.aggregate(st, F.lit(0), lambda t, j: F.when(same(F.get(s, i - t - j), v), t + j).otherwise(t))
                return F.when(same(F.get(s, i - 1), v), back).otherwise(F.lit(0)).cast("long")

            return F.transform(s, lambda v, i: label(v, before(v, i), v.bitwiseAND(F.lit(PLACE_BITS))))

        return F.when(F.size(F.array_distinct(F.transform(h, lambda x: x.bitwiseAND(F.lit(HASH_BITS))))) == F.size(h), once).otherwise(let(placed, lambda s: let(steps, lambda st: count(s, st))))

    return let(hashes, of)


def entries(text: Column, k: int = K) -> Column:
    """The filled bins of a text's fingerprint in order, as longs."""
    bin_of = lambda v: F.shiftright(v, BIN_SHIFT)

    def tuples(s: Column) -> Column:
        def of(v: Column, i: Column) -> Column:
            other = F.get(s, i + 1)
            first, second = v.bitwiseAND(F.lit(HASH_BITS)), other.bitwiseAND(F.lit(HASH_BITS))
            alone = F.coalesce(bin_of(other) != bin_of(v), F.lit(True))
            ordered = v.bitwiseAND(F.lit(PLACE_BITS)) <= other.bitwiseAND(F.lit(PLACE_BITS))
            digest = F.when(alone, F.xxhash64(first)).when(ordered, F.xxhash64(first, second)).otherwise(F.xxhash64(second, first))
            opens = (i == 0) | (bin_of(F.get(s, i - 1)) != bin_of(v))
            return F.when(opens, F.shiftleft(bin_of(v), TUPLE_BITS).bitwiseOR(digest.bitwiseAND(F.lit(TUPLE_MASK))))

        return F.array_compact(F.transform(s, of))

    least = lambda s: F.filter(s, lambda v, i: (i < 2) | (bin_of(F.get(s, i - 2)) != bin_of(v)))
    return let(F.sort_array(numbered(kmers(text, k))), lambda s: let(least(s), tuples))


def shown(bins: Column) -> Column:
    return F.array_join(F.transform(bins, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    filled = lambda x: F.transform(x, lambda v: F.shiftright(v, TUPLE_BITS))
    either = F.size(F.array_union(filled(a), filled(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def with_next(docs: DataFrame, order: list[str], carried: list[str]) -> DataFrame:
    """``docs`` with next_<c> of the following row by ``order``, of the first after the last.

    Rows are dealt by ranges of ``order``, which has no ties, twice as many as
    there are shuffle partitions; a range's last row gets the next range's
    first. The driver sees a key a range, however many rows there are.
    """
    key = F.struct(*order)
    ranges = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = docs.select(*order).repartitionByRange(ranges, *order).groupBy(F.spark_partition_id()).agg(F.min(key).alias("low")).select("low.*")
    bounds = sorted(tuple(r) for r in firsts.collect())  # a key per range
    if not bounds:
        return docs.withColumns({f"next_{c}": F.col(c) for c in carried})
    kinds = [docs.schema[c].dataType for c in order]
    lows = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(b, kinds, order, strict=True)]) for b in bounds])
    top = len(bounds)
    steps = F.array(*[F.lit(1 << j) for j in range(top.bit_length() - 1, -1, -1)])
    # how many lows are at most the key
    found = let(lows, lambda a: F.aggregate(steps, F.lit(0), lambda t, j: F.when(F.get(a, t + j - 1) <= key, t + j).otherwise(t)))
    dealt = docs.withColumn("range", found)
    heads = (
        dealt.filter(F.get(lows, F.col("range") - 1) == key)
        .select(F.when(F.col("range") == 1, F.lit(top)).otherwise(F.col("range") - 1).alias("range"), F.struct(*carried).alias("head"))
        .dropDuplicates(["range"])
    )
    window = Window.partitionBy("range").orderBy(*order)
    led = dealt.withColumn("led", F.lead(F.struct(*carried)).over(window)).join(heads, "range", "left")
    return led.withColumns({f"next_{c}": F.when(F.col("led").isNotNull(), F.col(f"led.{c}")).otherwise(F.col(f"head.{c}")) for c in carried}).drop("range", "led", "head")


def fingerprints(docs: DataFrame, *, k: int = K) -> DataFrame:
    """doc_id, fingerprint of every row of ``docs``."""
    return docs.select("doc_id", shown(entries(F.col("text"), k)).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, *, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the next document's beginning."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = text.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"), "doc_id", "text", entries(F.col("text"), k).alias("bins"))
    printed = with_next(keyed, ["no_id", "id", "tie", "place"], ["text", "bins"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = printed.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    return edited.withColumn("edited_bins", entries(F.col("edited"), k)).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("bins")).alias("fingerprint"),
        shown(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
