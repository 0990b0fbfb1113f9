"""The gated assessment pipeline as columns over a table of requests.

A stage computes its value for every request that no earlier stage has gated;
a gated request passes later stages unchanged. Stages are plain column
expressions, so the whole pipeline is one projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    name: str
    value: Column
    gate: Column  # a code, or null to go on
    recorded: Column  # whether the stage leaves a record once it is reached
    failed: Column | None = None  # a technical failure, which ends the request without a gate


# Stages in order, and what gates each.
GATES = {
    "erm": "IDENTITY_NOT_RESOLVED",
    "srm": "SEMANTICS_NOT_RESOLVED",
    "asm": "ASSERTION_NOT_ESTABLISHED",
    "krm": "KNOWLEDGE_NOT_INSTITUTIONALIZED",
    "drm": "DECISION_NOT_VALID",
    "grm": "GOVERNANCE_NON_ACTIONABLE",
}


def opened(requests: DataFrame) -> DataFrame:
    """``requests`` before their first stage."""
    return requests.withColumns({"gate_code": F.lit(None).cast("string"), "failed_stage": F.lit(None).cast("string"), "n_records": F.lit(0)})


def run_stage(requests: DataFrame, stage: Stage) -> DataFrame:
    """One stage over requests that are ``opened`` or come from the stage before; a gated or failed request passes unchanged."""
    open_ = F.col("gate_code").isNull() & F.col("failed_stage").isNull()
    failed = F.lit(False) if stage.failed is None else F.coalesce(stage.failed, F.lit(False))
    return requests.withColumns(
        {
            f"{stage.name}_value": F.when(open_ & ~failed, stage.value),
            "failed_stage": F.when(open_ & failed, stage.name).otherwise(F.col("failed_stage")),
            "gate_code": F.when(open_ & ~failed, stage.gate).otherwise(F.col("gate_code")),
            "n_records": F.col("n_records") + F.when(open_ & ~failed & stage.recorded, 1).otherwise(0),
        }
    )


def run_stages(requests: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """``requests`` with <stage>_value, gate_code, failed_stage and n_records (ST-02, ST-03)."""
    out = opened(requests)
    for stage in stages:
        out = run_stage(out, stage)
    return out


def illegal_transitions(states: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Rows whose state can't follow the one before (ST-04)."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(order))
    legal = (
        F.when(before.isNull(), F.col(state) == "Accepted")
        .when(before == "Accepted", F.col(state).isin("Executing", "Failed"))
        .when(before == "Executing", F.col(state).isin("Completed", "Failed"))
        .otherwise(False)
    )
    return states.withColumns({"before": before, "legal": legal}).filter(~F.col("legal")).drop("legal")


def broken_chain(checkpoints: DataFrame, key: str, ordinal: str, taken: str, left: str) -> DataFrame:
    """Checkpoints whose input isn't the output of the one before (ST-05)."""
    before = F.lag(left).over(Window.partitionBy(key).orderBy(ordinal))
    return checkpoints.withColumn("expected", before).filter(F.col("expected").isNotNull() & (F.col("expected") != F.col(taken)))


def admit(requests: DataFrame, key: Sequence[str], order: Sequence[str], payload_digest: str) -> DataFrame:
    """``requests`` with status NEW, REPLAY or CONFLICT: a key's first request is new, later ones repeat it or differ (ST-01, ST-07)."""
    first = requests.groupBy(*key).agg(F.min(F.struct(*order, payload_digest)).alias("_first"))
    j = requests.join(first, list(key))
    is_first = F.lit(True)
    for c in order:
        is_first = is_first & F.col(c).eqNullSafe(F.col(f"_first.{c}"))
    status = F.when(is_first, "NEW").when(F.col(payload_digest).eqNullSafe(F.col(f"_first.{payload_digest}")), "REPLAY").otherwise("CONFLICT")
    return j.withColumn("status", status).drop("_first")


def work_queue(attempts: DataFrame, logical: str, order: Sequence[str], state: Column | None, offset: int, limit: int) -> DataFrame:
    """A page of logical executions by their latest attempt; duplicates go before paging (ST-08, WIN-07).

    ``state`` filters on the latest attempt.
    """
    others = [c for c in attempts.columns if c != logical]
    latest = attempts.groupBy(logical).agg(F.max(F.struct(*order, *[c for c in others if c not in order])).alias("_last")).select(logical, "_last.*")
    kept = latest if state is None else latest.filter(state)
    return kept.orderBy(*[F.col(c).desc() for c in order], logical).offset(offset).limit(limit)


def audit_events(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` with a digest of their canonical JSON (ST-10)."""
    return rows.withColumn("integrity_digest", F.sha2(F.to_json(F.struct(*sorted(columns))), 256))
