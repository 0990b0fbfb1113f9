"""Writes: appends that check references, and what an append would change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def split_by_reference(rows: DataFrame, targets: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that may be appended, and rows whose reference is unknown (SNK-01)."""
    known = targets.select(*on).distinct()
    return rows.join(known, list(on), "left_semi"), rows.join(known, list(on), "left_anti")


def append(rows: DataFrame, path: str, partition: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def compare_and_append(decisions: DataFrame, current: DataFrame, key: str, based_on: str, head: str, order: Sequence[str]) -> DataFrame:
    """Decisions with OK, STALE, SUPERSEDED or NOT_FOUND: a key's first current decision wins (SNK-03)."""
    j = decisions.join(current.select(key, head), key, "left")
    fresh = F.col(based_on) == F.col(head)
    winner = j.filter(fresh).groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    same = F.struct(*[F.col(c) for c in order]) == F.col("_first")
    status = F.when(F.col(head).isNull(), "NOT_FOUND").when(~fresh, "STALE").when(same, "OK").otherwise("SUPERSEDED")
    return j.join(winner, key, "left").withColumn("status", status).drop("_first")


def get_or_create(rows: DataFrame, existing: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows with CREATE, EXISTS or CONFLICT by a deterministic id (SNK-04)."""
    there = existing.select(key, F.col(payload).alias("_old"), F.lit(True).alias("_there"))
    j = rows.join(there, key, "left")
    status = F.when(F.col("_there").isNull(), "CREATE").when(F.col(payload).eqNullSafe(F.col("_old")), "EXISTS").otherwise("CONFLICT")
    return j.withColumn("status", status).drop("_old", "_there")


def without_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """What stays after rows of a prefix are deleted (SNK-05)."""
    return rows.filter(~F.coalesce(F.col(column).startswith(prefix), F.lit(False)))


def back_filled(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """A column that old rows lack (SNK-10)."""
    return rows.withColumn(column, F.coalesce(F.col(column), value) if column in rows.columns else value)


def linked_nodes(concepts: DataFrame, relations: DataFrame, prefix: str) -> DataFrame:
    """node: a JSON-LD node per concept (name, definition, status) and per relation (name, source, target), ids below ``prefix`` (SNK-06)."""
    of = lambda kind, name: F.concat(F.lit(f"{prefix}:{kind}:"), F.col(name))
    c = F.struct(of("concept", "name").alias("@id"), F.lit("Concept").alias("@type"), "name", "definition", F.col("status").alias("governanceStatus"))
    r = F.struct(of("relationship", "name").alias("@id"), F.lit("Relationship").alias("@type"), "name", of("concept", "source").alias("source"), of("concept", "target").alias("target"))
    return concepts.select(F.to_json(c).alias("node")).unionByName(relations.select(F.to_json(r).alias("node")))


def append_batch(rows: DataFrame, path: str, batch: int) -> None:
    """An append whose rows carry its number, so the log keeps the order of appends whatever files Spark writes (SNK-02)."""
    append(rows.withColumn("batch", F.lit(batch)), path)


def key_of(keys: DataFrame, key_id: str) -> Column:
    """A key as a scalar subquery over a table of keys (key_id, key): plans and logs name the table, not the key (SNK-09).

    Keep that table where only those may read it who may open what it seals.
    """
    return keys.filter(F.col("key_id") == key_id).agg(F.max("key").alias("key")).scalar()


def sealed(payload: Column, key: Column, version: Column, key_id: str) -> Column:
    """Authenticated encryption, bound to the key's id and a version (SNK-09)."""
    bound = F.concat(F.lit(key_id), F.lit(":"), version)
    return F.aes_encrypt(payload, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), bound)


def opened(cipher: Column, key: Column, version: Column, key_id: str) -> Column:
    return F.aes_decrypt(cipher, key, F.lit("GCM"), F.lit("DEFAULT"), F.concat(F.lit(key_id), F.lit(":"), version))
