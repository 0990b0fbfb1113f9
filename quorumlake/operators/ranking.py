"""First, best, latest and paged rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeats_of_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows after their key's first by ``order``, with the first's place (WIN-01)."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({"place": F.row_number().over(w), "first_place": F.first(order).over(w)}).filter("place > 1")


def best(df: DataFrame, key: Sequence[str], score: str, item: str) -> DataFrame:
    """Each key's item of the highest score, ties to the smaller item (WIN-02)."""
    top = F.min(F.struct((-F.col(score)).alias("s"), F.col(item).alias("i"))).alias("_top")
    return df.groupBy(*key).agg(top).select(*key, F.col("_top.i").alias(item), (-F.col("_top.s")).alias(score))


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page in a total order (WIN-07, SRC-06); ask for ``limit`` + 1 to learn whether there is a next one."""
    return df.orderBy(*order).offset(offset).limit(limit)


def places(df: DataFrame, order: Sequence[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with each row's place, from 1, in the ascending order of the columns ``order``; nulls come first (WIN-05).

    Rows are dealt to sorted ranges once and stored by ``keep``. A row's number in its range is shifted by the rows of the
    ranges before, a row a range, so neither a task nor the driver orders the whole table.
    """
    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    laid = keep(numbered).withColumn("_range", F.shiftright("_row", 33).cast("int"))
    ranges = laid.groupBy("_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    shifts = ranges.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    place = F.col("_row") - F.col("_first") + F.col("_before") + 1
    return laid.join(F.broadcast(shifts), "_range").withColumn("place", place).drop("_row", "_range", "_first", "_before")


def last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Each key's ``n`` last rows by ``order`` (WIN-08)."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def next_ordinal(checkpoints: DataFrame, key: str, ordinal: str, good: Column) -> DataFrame:
    """The ordinal to resume at: the first that is missing or not good; valid is false where ordinals have gaps (WIN-11, ST-06)."""
    w = Window.partitionBy(key).orderBy(ordinal)
    placed = checkpoints.withColumns({"_at": (F.row_number().over(w) - 1).cast("long"), "_good": good})
    contiguous = F.col("_at") == F.col(ordinal).cast("long")
    return placed.groupBy(key).agg(
        F.bool_and(contiguous).alias("valid"),
        F.least(F.min(F.when(~F.coalesce(F.col("_good"), F.lit(False)), F.col("_at"))), F.count(F.lit(1))).alias("resume_at"),
    )


def names_by_id(df: DataFrame, key: str, id_column: str, name: str) -> DataFrame:
    """Each key's names, one per id, sorted (WIN-10)."""
    once = df.groupBy(key, id_column).agg(F.min(name).alias("_name"))
    return once.groupBy(key).agg(F.array_sort(F.collect_list("_name")).alias("names"))
