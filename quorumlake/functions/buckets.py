"""Small decisions over scores, states and flags, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH, MEDIUM = 0.9, 0.65


def confidence(score: Column, high: float = HIGH, medium: float = MEDIUM) -> Column:
    """High, Medium or Low; null outside 0 to 1 (SCL-17)."""
    return F.when(score.between(0, 1), F.when(score >= high, "High").when(score >= medium, "Medium").otherwise("Low"))


def outcome(score: Column, upper: float, lower: float, names: tuple[str, str, str] = ("Established", "Candidate", "Rejected")) -> Column:
    """SCL-18."""
    return F.when(score >= upper, names[0]).when(score >= lower, names[1]).otherwise(names[2])


# Result codes that are classes of their own, and those that leave the result open.
OWN_CODES = ("APPROVED", "CONDITIONALLY_APPROVED", "REJECTED", "INDETERMINATE")
OPEN_CODES = ("EVIDENCE_INDETERMINATE", "IDENTITY_NOT_RESOLVED", "SEMANTICS_NOT_RESOLVED")


def terminal_class(state: Column, has_result: Column, code: Column, actionable: Column) -> Column:
    """Class of an execution as the store gives it: null until it ends (SCL-19)."""
    return (
        F.when(~state.isin("Completed", "Failed"), F.lit(None))
        .when(state == "Failed", "TECHNICAL_FAILURE")
        .when(~has_result, "BUSINESS_GATED")
        .when(code.isin(*OWN_CODES), code)
        .when(code.isin(*OPEN_CODES), "INDETERMINATE")
        .when(~actionable, "BUSINESS_GATED")
        .otherwise("APPROVED")
    )


def api_class(state: Column, code: Column) -> Column:
    """Class of an execution as the interface gives it: a missing code counts as gated (SCL-19)."""
    return (
        F.when(~state.isin("Completed", "Failed"), "IN_PROGRESS")
        .when(state == "Failed", "TECHNICAL_FAILURE")
        .when(code.isin(*OWN_CODES), code)
        .when(code.isin(*OPEN_CODES), "INDETERMINATE")
        .otherwise("BUSINESS_GATED")
    )


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def corroboration(base: float, trust: Column, systems: Column) -> Column:
    """Contribution of independent source systems (SCL-25)."""
    return F.least(F.lit(1.0), F.lit(base) * trust * (systems - 1))


def eligible(*flags: Column) -> Column:
    """All four eligibility flags (SCL-26)."""
    out = flags[0]
    for f in flags[1:]:
        out = out & f
    return out


def retention_deadline(terminal: Column, days: int = 365 * 7) -> Column:
    """SCL-27; audit events keep two days more."""
    return terminal + F.make_dt_interval(F.lit(days))


def poll_delay_ms(attempt: Column) -> Column:
    """SCL-28."""
    return F.least(F.lit(30_000), F.lit(5_000) * F.greatest(F.lit(1), attempt))


def millions_label(x: Column) -> Column:
    """SCL-30."""
    return F.concat(F.lit("$"), F.round(x / 1_000_000).cast("long").cast("string"), F.lit("M"))
