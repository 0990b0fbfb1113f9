"""Policies: evidence to outcome, facts to recommendation, checks to standing.

A nullable boolean is a tri-state: null is unknown, and unknown is neither true
nor false until a rule says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.operators.filters import errors
from quorumlake.operators.intervals import interval_join

# Evidence types in order, their weights, and the three preset policies.
WEIGHTS = {
    "STRONG_IDENTIFIER_LEI": 0.95,
    "STRONG_IDENTIFIER_EXTERNAL_ID": 0.9,
    "STRONG_IDENTIFIER_TAX_REGISTRATION": 0.9,
    "SOURCE_SYSTEM_CROSSWALK": 0.85,
    "DOMAIN_VERIFIED": 0.35,
    "EMAIL_DOMAIN_VERIFIED": 0.25,
    "COUNTRY_MATCH": 0.15,
    "REGISTERED_ADDRESS_MATCH": 0.2,
    "POSTAL_CODE_MATCH": 0.1,
    "LEGAL_NAME_MATCH": 0.1,
    "TRADING_NAME_MATCH": 0.1,
    "ALIAS_MATCH": 0.1,
    "ACRONYM_MATCH": 0.05,
    "SOURCE_SYSTEM_PROVENANCE": 0.05,
}
STRONG = ("STRONG_IDENTIFIER_LEI", "STRONG_IDENTIFIER_EXTERNAL_ID", "STRONG_IDENTIFIER_TAX_REGISTRATION", "SOURCE_SYSTEM_CROSSWALK")
NAME_ONLY = ("LEGAL_NAME_MATCH", "TRADING_NAME_MATCH", "ALIAS_MATCH", "LEGAL_SUFFIX_NORMALIZED", "ACRONYM_MATCH")
REVIEW_FORCING = ("COUNTRY_MATCH", "PARENT_SUBSIDIARY_DISTINCTION")
PRESETS = (
    # name, resolved, possible, high, medium, min corroborating, strong identifier mandatory, country conflict, parent conflict
    ("Conservative", 0.92, 0.55, 0.92, 0.6, 3, True, "veto", "veto"),
    ("Balanced", 0.85, 0.5, 0.85, 0.55, 2, False, "review", "veto"),
    ("Exploratory", 0.75, 0.4, 0.75, 0.45, 1, False, "review", "review"),
)
PRESET_SCHEMA = "policy string, resolved double, possible double, high double, medium double, min_corroborating int, strong_mandatory boolean, country_conflict string, parent_conflict string"


def presets(df: DataFrame) -> DataFrame:
    """ER-13: three rows."""
    return df.sparkSession.createDataFrame(list(PRESETS), PRESET_SCHEMA)


def policy_errors() -> Column:
    """Names of the bounds a policy row breaks (SET-03, §1.3)."""
    c = F.col
    return errors(
        bands=c("high") >= c("medium"),
        corroborating=c("min_corroborating") >= 1,
        order=c("resolved") > c("possible"),
        thresholds=c("resolved").between(0, 1) & c("possible").between(0, 1),
    )


# ---- supplier risk

def recommendation(severity: Column, sourcing: Column, ready: Column, exceptional: Column) -> Column:
    """POL-07: the first rule that holds."""
    return (
        F.when(exceptional | (sourcing == "INDETERMINATE"), "ESCALATE_FOR_HUMAN_REVIEW")
        .when((severity == "LOW") & sourcing.isin("SINGLE_SOURCE", "DUAL_SOURCE"), "CONTINUE_MONITORING")
        .when((severity == "MATERIAL") & (sourcing == "SINGLE_SOURCE"), "QUALIFY_SECOND_SOURCE")
        .when(severity.isin("HIGH", "CRITICAL") & ready, "ACTIVATE_APPROVED_SECOND_SOURCE")
        .otherwise("ESCALATE_FOR_HUMAN_REVIEW")
    )


def standing(compliant: Column, review: Column, conditions: Column, verified: Column) -> tuple[Column, Column]:
    """Governance standing and whether it may be acted on (POL-08)."""
    some = F.size(conditions) > 0
    state = F.when(review, "PENDING_REVIEW").when(~compliant, "REJECTED").when(some, "CONDITIONALLY_APPROVED").otherwise("APPROVED")
    return state, F.when(review | ~compliant, False).when(some, F.size(F.array_except(conditions, verified)) == 0).otherwise(True)


# ---- supply-chain impact

def number(text: Column) -> Column:
    """A plain decimal number, else null: stricter than a cast, which takes 12d or 1e3f (POL-11, POL-12)."""
    return F.when(F.trim(text).rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(text).try_cast("double"))


def is_material(revenue: Column, threshold: float) -> Column:
    """Strictly above the threshold; not a number counts as false, unknown stays unknown (POL-11)."""
    return F.when(F.isnan(revenue), False).otherwise(revenue > threshold)


def classify(severe: Column, single: Column, material: Column, has_candidate: Column, qualified: Column, capacity: Column) -> tuple[Column, Column]:
    """Outcome and reason of a unit; null where a condition is unknown and none is false (POL-13).

    The first false condition in order decides, then the lack of a candidate.
    """
    reason = (
        F.when(~severe, "not-severe")
        .when(~single, "not-single-sourced")
        .when(~material, "not-material")
        .when(~has_candidate, "no-candidate")
        .when(~qualified, "not-qualified")
        .when(~capacity, "no-capacity")
    )
    outcome = F.when(reason.isNotNull(), "REJECTED").when(severe & single & material & qualified & capacity, "RECOMMENDED")
    return outcome, reason


def references(*ids: Column) -> Column:
    """Knowledge references in order, without those that are unknown (POL-14)."""
    return F.array_compact(F.array(*ids))


# ---- evaluations and overrides

def with_override(value: Column, override: Column, authorised: Column) -> Column:
    """An authorised override wins (POL-01 to POL-04)."""
    return F.when(authorised & override.isNotNull(), override).otherwise(value)


def exception_granted(authority_known: Column, same_policy: Column, effective: Column, start: Column, end: Column) -> Column:
    """POL-05: half-open validity."""
    return F.coalesce(authority_known & same_policy & (start <= effective) & (effective < end), F.lit(False))


# Why an exception can't be granted, in the order in which it is checked.
EXCEPTION_ERRORS = (
    "Exception Authorization is allowed only for Exception Granted",
    "Exception Granted requires an Exception Authorization",
    "Exception Authority is not authorized",
    "Exception Authorization does not match the governing policy",
    "Exception Authorization is not effective for this evaluation",
)


def exception_errors(evaluations: DataFrame, authorizations: DataFrame, authorities: DataFrame) -> DataFrame:
    """evaluation_id, authorization_id, error: what is wrong with each evaluation's exception, null where nothing is (POL-05).

    ``evaluations`` has evaluation_id, outcome, policy, version, effective_from and the authorization_id that it names;
    ``authorizations`` authorization_id, policy, version, authority, effective_from, expiration; ``authorities`` authority.
    An authorization that isn't there is none; one without an end never expires.
    """
    known = authorizations.join(authorities.select("authority").distinct().withColumn("_known", F.lit(True)), "authority", "left")
    a = known.select("authorization_id", *[F.col(c).alias(f"_{c}") for c in ("policy", "version", "effective_from", "expiration")], "_known", F.lit(True).alias("_found"))
    j = evaluations.join(a, "authorization_id", "left")
    c = F.col
    some, granted = c("_found").isNotNull(), c("outcome") == "Exception Granted"
    same = (c("_policy") == c("policy")) & (c("_version") == c("version"))
    inside = (c("_effective_from") <= c("effective_from")) & (c("_expiration").isNull() | (c("effective_from") < c("_expiration")))
    holds = lambda check: F.coalesce(check, F.lit(False))
    checks = (holds(granted) | ~some, ~holds(granted) | some, ~some | c("_known").isNotNull(), ~some | holds(same), ~some | holds(inside))
    error = F.coalesce(*[F.when(~ok, F.lit(text)) for text, ok in zip(EXCEPTION_ERRORS, checks, strict=True)])
    return j.select("evaluation_id", "authorization_id", error.alias("error"))


def authorizations_in_force(evaluations: DataFrame, authorizations: DataFrame) -> DataFrame:
    """evaluation_id, authorization_id: every authorization of an evaluation's policy and version that is in force at it (POL-05, TMP-06)."""
    points = evaluations.select("evaluation_id", "policy", "version", F.col("effective_from").alias("_at_time"))
    spans = authorizations.select("authorization_id", "policy", "version", "effective_from", "expiration")
    return interval_join(points, spans, ["policy", "version"], "_at_time", "effective_from", "expiration").select("evaluation_id", "authorization_id")


def four_rules(severity: Column, sourcing_pct: Column, revenue: Column, threshold: float, capacity: Column, qualified: Column) -> tuple[Column, Column]:
    """Whether the four display rules pass, and the share that an alternate may take (POL-17)."""
    passed = (severity == "High") & (sourcing_pct == 100) & (revenue > threshold) & (capacity > 0) & (qualified == "Qualified")
    return passed, F.when(passed, F.least(capacity, F.lit(40.0)))
