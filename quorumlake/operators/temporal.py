"""Append-only records: what is current, what came before, what may go.

Records of a key are ordered by effective start, then production time, then
id, all descending; nothing here stores currentness.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_as_of(records: DataFrame, key: Sequence[str], as_of: Column | None, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The columns of each key's last record by ``order``, of those in effect by ``as_of``.

    A partial aggregate: no sort of a key's records (TMP-02, WIN-04, WIN-06, JN-21).
    """
    seen = records if as_of is None else records.filter(F.col(order[0]) <= as_of)
    return seen.groupBy(*key).agg(F.max(F.struct(*order, *columns)).alias("_last")).select(*key, *[F.col(f"_last.{c}").alias(c) for c in columns])


def history(records: DataFrame, key: Sequence[str], order: Sequence[str], item: str) -> DataFrame:
    """Each key's items, the latest first (TMP-01)."""
    newest_first = F.reverse(F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item")))))
    return records.groupBy(*key).agg(F.transform(newest_first, lambda x: x["_item"]).alias("history"))


def with_prior(records: DataFrame, key: Sequence[str], order: Sequence[str], item: str) -> DataFrame:
    """Records with the item before theirs, the number of priors and whether they are current (TMP-03, SNK-02)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return records.withColumns(
        {
            "prior": F.lag(item).over(w),
            "n_prior": (F.row_number().over(w) - 1).cast("int"),
            "is_current": F.lead(F.lit(1)).over(w).isNull(),
        }
    )


def policy_trace(records: DataFrame, reference: str, version: str, item: str) -> DataFrame:
    """Number and least and last item of the records made under each policy version (TMP-04)."""
    return records.groupBy(reference, version).agg(F.count(F.lit(1)).alias("records"), F.min(item).alias("first"), F.max(item).alias("last"))


def policy_records(records: DataFrame, reference: str, version: str, item: str) -> DataFrame:
    """The items of the records made under each policy version, in order (TMP-04): a row's list is as long as its version has records."""
    return records.groupBy(reference, version).agg(F.array_sort(F.collect_list(item)).alias("records"))


def in_force(now: Column, issued: Column, expires: Column) -> Column:
    """TMP-06."""
    return (issued <= now) & (now < expires)


def hold_state(events: DataFrame, target: str, order: Sequence[str], hold: str) -> DataFrame:
    """Whether each target is on hold: its last hold event decides (TMP-07)."""
    return events.groupBy(target).agg(F.max_by(hold, F.struct(*order)).alias(hold))


def disposable(rows: DataFrame, holds: DataFrame, target: str, hold: str, deadline: Column, now: Column) -> DataFrame:
    """Rows past their deadline that no hold keeps (FLT-07, TMP-08, SNK-08)."""
    return rows.filter(deadline < now).join(holds.filter(F.col(hold)).select(target), target, "left_anti")
