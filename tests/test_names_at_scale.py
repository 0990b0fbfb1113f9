"""Names that are many, or much alike: what is compared, copied, sent to all tasks and grouped."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import joins, names, resolution

NUMBERED = [(i % 2, i, f"supplier {i * 37 % 5000:06d}{' int' if i % 3 == 0 else ''}", "forced" if i % 10 == 0 else None) for i in range(120)]


@pytest.fixture
def keep(spark, tmp_path):
    def stored(df):
        df.write.parquet(path := str(tmp_path / f"{len(list(tmp_path.iterdir()))}"))
        return spark.read.parquet(path)

    return stored


def test_sides_that_are_copied_are_not_broadcast(spark):
    """A side is small before it is copied to slices; no row is copied more often than a key may have slices."""
    left, right = (spark.range(600).select((F.col("id") % 2).alias("k"), F.col("id").alias(n)) for n in ("x", "y"))
    pairs = joins.in_slices(left, right, ["k"], "x", "y", 10)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [k" in plan and "_slice_a" in plan.split("SortMergeJoin [k")[1].split("\n")[0]
    tested = pairs._jdf.queryExecution().analyzed().children().apply(0).children()
    rows = [spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, tested.apply(0).children().apply(i)).count() for i in (0, 1)]
    assert pairs.count() == 2 * 300 * 300 and max(rows) <= 600 * joins.MOST_SLICES


def test_names_that_meet_by_several_characters_are_those_of_all_pairs(spark, keep, monkeypatch):
    rows = [(t, n) for t, _, n, _ in NUMBERED]
    a, b = spark.createDataFrame(rows, "tenant_id int, a string"), spark.createDataFrame([(t, n.removesuffix(" int")) for t, n in rows], "tenant_id int, b string")
    chosen = []
    real = names._together
    monkeypatch.setattr(names, "_together", lambda *x: chosen.append(real(*x)) or chosen[-1])
    got = [(r.tenant_id, r.a, r.b) for r in names.similar_names(a, b, 0.9, keep=keep).collect()]
    expected = {(t, x, y.removesuffix(" int")) for t, x in rows for u, y in rows if t == u and difflib.SequenceMatcher(None, x, y.removesuffix(" int")).ratio() >= 0.9}
    assert chosen[0] > 1 and len(got) == len(expected) and set(got) == expected


@pytest.mark.parametrize("keep_all", [False, True])
def test_needed_candidates_decide_as_all_do(spark, keep, keep_all):
    """Cases with several names, ties, names nobody is near, and overrides of some of a case's rows."""
    rng = random.Random(3)
    odd = [(0, 500 + i, "".join(rng.choice("abcx ") for _ in range(9)), rng.choice([None, None, "other"])) for i in range(40)] + [(0, 501, "supplier 000037", None), (1, 900, None, None)]
    cases = spark.createDataFrame(NUMBERED + odd, "tenant_id int, case_id int, name string, override_entity_id string")
    entities = spark.createDataFrame([(t, f"E{i % 50}", n.removesuffix(" int")) for t, i, n, _ in NUMBERED] + [(0, f"X{i}", n) for _, i, n, _ in odd[::3]], "tenant_id int, entity_id string, entity_name string")

    decide = lambda found: sorted(map(str, resolution.resolve_by_name(cases, found, resolved=0.97, high=0.9, medium=0.65, keep_all=keep_all).collect()))
    every = keep(resolution.candidates_by_name(cases, entities, 0.65, keep))
    needed = keep(resolution.needed_candidates(cases, entities, 0.65, 0.97, keep, keep_all))
    assert decide(needed) == decide(every) and needed.count() < every.count()


def test_candidates_of_cases_with_one_name_are_not_grouped(spark, keep):
    cases = spark.createDataFrame([(t, i, n) for t, i, n, _ in NUMBERED], "tenant_id int, case_id int, name string")
    entities = spark.createDataFrame([(t, f"E{i}", n) for t, i, n, _ in NUMBERED], "tenant_id int, entity_id string, entity_name string")
    plan = lambda c: resolution.candidates_by_name(c, entities, 0.9, keep)._jdf.queryExecution().executedPlan().toString()
    assert "max(score" not in plan(cases) and "max(score" in plan(cases.unionByName(cases.withColumn("name", F.lit("another"))))
