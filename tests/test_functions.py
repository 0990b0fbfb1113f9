"""Golden values of scalar functions, and the two UDFs against the standard library."""

import difflib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import buckets, ids, questions, similarity, text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "make, given, wanted",
    [
        (text.name_key, "O'Brien & Sons, LLC.", "o brien sons llc"),
        (text.canonical_name, "acme pte ltd", "acme"),
        (text.canonical_name, "Acme L.L.C.", "acme"),
        (text.canonical_name, "Inc", ""),
        (text.canonical_name, "Acme Co Inc", "acme co"),
        (text.name_key, "Straße 5", "strasse 5"),
        (text.derived_acronym, "Taiwan Semiconductor Manufacturing Co Ltd", "TSM"),
        (text.domain, "https://www.tsmc.com/investor", "tsmc.com"),
        (text.domain, " WWW.Example.org:80?x=1 ", "example.org:80?x=1"),
        (text.letters_and_digits, "300-78", "30078"),
        (text.country, " tw ", "TW"),
        (text.country, "South  Korea", "south korea"),
        (text.address, "12, Main St.  #4", "12 main st 4"),
        (text.outcome_label, "PENDING_REVIEW", "pending review"),
    ],
)
def test_text(spark, make, given, wanted):
    assert one(spark, given, make) == wanted
    assert one(spark, None, make) is None


def test_fingerprint_hides_case_and_space(spark):
    a, b = one(spark, " T-1 ", text.fingerprint), one(spark, "t-1", text.fingerprint)
    assert a == b and a.startswith("fp:") and len(a) == 15


def test_stable_ids_are_uuid5(spark):
    for value in ("", "x", "order:7", "ä漢"):
        assert one(spark, value, ids.uuid5) == str(uuid.uuid5(ids.NAMESPACE, value))


def test_similarity_is_difflib(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), ("a", ""), ("x" * 250 + "y", "y" + "x" * 250), (None, "a")]
    rows = spark.createDataFrame(pairs, "a string, b string").coalesce(1).select("a", "b", similarity.similarity("a", "b").alias("s")).collect()
    for r in rows:
        if r.a is None:
            assert r.s is None
        else:
            assert r.s == difflib.SequenceMatcher(None, r.a, r.b).ratio()


def test_matches_over_arrays_are_those_of_one_pair_at_a_time():
    """Short and long texts, few and many kinds of characters, repeats, beyond the basic plane, and texts long enough for popular ones."""
    rng = random.Random(11)
    made = lambda n, kinds: "".join(rng.choice(kinds) for _ in range(rng.randrange(n)))
    pairs = [(made(n, kinds), made(n, kinds)) for n, kinds in ((6, "ab"), (25, "abc "), (40, "abcdefghij é"), (30, "a𝄞漢"), (300, "ab"), (420, "abcdefghijklmnop")) for _ in range(60)]
    for n in (199, 200, 260):
        base = made(n + 1, "abcdefghijklmnopqrstuvwxyz" * 20 + "é").ljust(n, "x")[:n]
        pairs += [(base, base), (base[7:] + "zz", base), (base[: n // 2] + "q" * 9 + base[n // 2 :], base), (base, base[::-1])]
    pairs += [("", ""), ("", "a"), ("a", ""), ("x" * 250, "x" * 250)]
    expected = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert similarity.ratios([a for a, _ in pairs], [b for _, b in pairs]).tolist() == expected


def test_case_folding(spark):
    for value in ("STRASSE", "Straße", "İx", "plain"):
        assert one(spark, value, similarity.fold_case) == value.casefold()


@pytest.mark.parametrize("score, wanted", [(0.9, "High"), (0.65, "Medium"), (0.6499, "Low"), (1.1, None), (-0.1, None)])
def test_confidence_bounds(spark, score, wanted):
    assert one(spark, score, buckets.confidence, "double") == wanted


@pytest.mark.parametrize(
    "question, intent, entity",
    [
        ("Which products depend on TSMC?", "PRODUCTS_DEPENDING_ON_SUPPLIER", "TSMC"),
        ("  which PRODUCT   depends on  'Acme Ltd' ?!", "PRODUCTS_DEPENDING_ON_SUPPLIER", "Acme Ltd"),
        ("What is the evidence status of Legal Name in Supplier?", "INFORMATION_ELEMENT_CONTEXT_EXPLANATION", None),
        ("Tell me all", "UNSUPPORTED", None),
        ("", "UNSUPPORTED", None),
    ],
)
def test_questions(spark, question, intent, entity):
    row = one(spark, question, questions.parse_question)
    assert (row.intent, row.entity) == (intent, entity)


def test_two_classes_of_an_ended_execution(spark):
    df = spark.createDataFrame([("Completed", True, None, True), ("Completed", False, None, None), ("Failed", True, "APPROVED", True), ("Executing", False, None, None), ("Completed", True, "GOVERNANCE_NON_ACTIONABLE", False)], "s string, h boolean, c string, a boolean")
    rows = df.select(buckets.terminal_class(F.col("s"), F.col("h"), F.col("c"), F.col("a")).alias("t"), buckets.api_class(F.col("s"), F.col("c")).alias("i")).collect()
    assert [r.t for r in rows] == ["APPROVED", "BUSINESS_GATED", "TECHNICAL_FAILURE", None, "BUSINESS_GATED"]
    assert [r.i for r in rows] == ["BUSINESS_GATED", "BUSINESS_GATED", "TECHNICAL_FAILURE", "IN_PROGRESS", "BUSINESS_GATED"]
