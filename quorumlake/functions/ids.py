"""Deterministic identifiers and digests, as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "quorumlake")


def uuid5(value: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """Name-based UUID, version 5, of a string (SCL-13)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(value, "UTF-8")))
    variant = F.lit("89ab")
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        F.substring(variant, nibble + 1, F.lit(1)), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def stable_id(kind: str, value: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    return uuid5(F.concat(F.lit(kind + ":"), value), namespace)


def iso_time(ts: Column) -> Column:
    """ISO 8601 with offset; microseconds only where there are any."""
    whole = F.unix_micros(ts.cast("timestamp")) % 1_000_000 == 0
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def length_prefixed(*parts: Column) -> Column:
    """Parts joined so that no two lists of parts are encoded alike (SCL-14)."""
    return F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts])


def key_of(*ids: Column) -> Column:
    """SHA-256 over the sorted ids: the key that groups a record's history (SCL-15)."""
    return members_key(F.array(*ids))


def members_key(ids: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(ids), ","), 256)


def decision_key(knowledge: Column, recommendation: Column, context: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.array_join(F.array_sort(knowledge), ","), recommendation, context), 256)


def payload_digest(payload: Column) -> Column:
    """SCL-16."""
    return F.sha2(payload, 256)
