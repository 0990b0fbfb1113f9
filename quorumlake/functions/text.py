"""Text normalisation for entity comparison, as column expressions.

All take and return columns and are null for null. Lower-casing maps the
German sharp s to ss, as full case folding does; other special foldings are
left to :func:`quorumlake.functions.similarity.fold_case`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The legal-form suffixes that name comparison ignores.
LEGAL_SUFFIXES = (
    "incorporated", "inc", "corporation", "corp", "company", "co", "limited", "ltd", "llc", "l l c", "plc", "gmbh",
    "s a", "sa", "s p a", "spa", "pte ltd", "pte", "ag", "nv", "bv", "kk", "co ltd",
)


def lower(s: Column) -> Column:
    return F.replace(F.lower(s), F.lit("ß"), F.lit("ss"))


def squeeze(s: Column) -> Column:
    """Trimmed lower case with single spaces (SCL-01)."""
    return F.regexp_replace(F.trim(lower(s)), r"\s+", " ")


def name_key(s: Column) -> Column:
    """Lower-case letters and digits, all else a single space (SCL-02)."""
    return F.trim(F.regexp_replace(lower(s), "[^a-z0-9]+", " "))


def without_suffix(name: Column) -> Column:
    """A name key without its last legal suffix; the longest suffix goes, and only one (SCL-03)."""
    longest_first = sorted(LEGAL_SUFFIXES, key=lambda x: (-len(x.split()), -len(x)))
    return F.regexp_replace(name, f"(?:^| )(?:{'|'.join(longest_first)})$", "")


def canonical_name(s: Column) -> Column:
    """SCL-04."""
    return without_suffix(name_key(s))


def derived_acronym(s: Column) -> Column:
    """First letters of the canonical name, upper case (SCL-05)."""
    return F.upper(F.array_join(F.transform(F.split(canonical_name(s), " "), lambda w: F.substring(w, 1, 1)), ""))


def letters_and_digits(s: Column) -> Column:
    """Upper-case letters and digits: acronyms and postal codes (SCL-06, SCL-10)."""
    return F.upper(F.regexp_replace(lower(s), "[^a-z0-9]+", ""))


def domain(s: Column) -> Column:
    """Host of a URL or bare domain, without one leading www. (SCL-07)."""
    bare = F.regexp_replace(F.trim(lower(s)), "^[a-z]+://", "")
    return F.regexp_replace(F.split(bare, "/")[0], r"^www\.", "")


def country(s: Column) -> Column:
    """Two-letter codes in upper case, names in lower case (SCL-08)."""
    c = squeeze(s)
    return F.when(F.length(c) == 2, F.upper(c)).otherwise(c)


def address(s: Column) -> Column:
    """Letters and digits with single spaces (SCL-09)."""
    return squeeze(F.trim(F.regexp_replace(squeeze(s), "[^a-z0-9]+", " ")))


def fingerprint(s: Column) -> Column:
    """A short digest that shows that two values are equal without showing them (SCL-11)."""
    return F.concat(F.lit("fp:"), F.substring(F.sha2(lower(F.trim(s)), 256), 1, 12))


def outcome_label(s: Column) -> Column:
    """SCL-29."""
    return F.replace(F.lower(s), F.lit("_"), F.lit(" "))


def claim_values(s: Column) -> Column:
    """Sorted distinct words of a scope claim (SCL-31)."""
    return F.array_sort(F.array_distinct(F.filter(F.split(s, r"\s+"), lambda x: x != "")))
