"""Joins by time, by path and by likeness, against plain versions: hot keys, endless intervals, cycles, ties and nulls."""

import datetime
import difflib
import random

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import similarity
from quorumlake.operators import graph, joins, names, policy, validation
from quorumlake.operators.intervals import interval_join, latest_fact
from quorumlake.plans import registry


@pytest.fixture
def keep(spark, tmp_path):
    """Stores a frame, and counts how many it has stored."""

    def stored(df):
        stored.calls += 1
        path = str(tmp_path / f"t{stored.calls}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    stored.calls = 0
    return stored


# ---- points in intervals


def in_intervals(points, intervals):
    return sorted((p, i) for k, p, t in points for h, i, s, e in intervals if k is not None and k == h and None not in (t, s) and s <= t and (e is None or t < e))


def joined(spark, points, intervals):
    p, i = spark.createDataFrame(points, "k string, p int, t long"), spark.createDataFrame(intervals, "k string, i int, s long, e long")
    return sorted((r.p, r.i) for r in interval_join(p, i, ["k"], "t", "s", "e").collect())


@pytest.mark.parametrize("seed", range(3))
def test_interval_join_is_the_inequality_join(spark, seed):
    """A hot key, lengths from nothing to most of the time, reversed and endless intervals, nulls and negative times."""
    rng = random.Random(seed)
    some = lambda value: None if rng.random() < 0.02 else value
    points = [(some(rng.choice("aaaaab")), i, some(rng.randrange(-(10**8), 10**9))) for i in range(300)]
    intervals = []
    for i in range(200):
        start = rng.randrange(-(2 * 10**8), 10**9)
        intervals.append((some(rng.choice("aab")), i, some(start), None if rng.random() < 0.1 else start + rng.choice([-5, 0, 1, 10, 10**6, 3 * 10**8])))
    points += [("a", 900, intervals[0][2]), ("a", 901, intervals[0][3])]
    assert joined(spark, points, intervals) == in_intervals(points, intervals)


def test_interval_join_without_rows(spark):
    points, intervals = [("a", 1, 5), ("a", 2, None)], [("a", 1, 0, None), ("a", 2, 9, 3), ("a", 3, None, None)]
    assert joined(spark, points, intervals) == [(1, 1)]
    assert joined(spark, points, []) == [] == joined(spark, [], intervals) == joined(spark, [("a", 1, None)], intervals)


def test_interval_join_meets_little_more_than_matches(spark):
    """Short intervals of one key among long ones: the join before the exact test makes rows in proportion to the matches."""
    points = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("p"), (F.col("id") * 1000).alias("t"))
    spans = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("i"), (F.col("id") * 1000).alias("s"))
    long = F.when(F.col("i") % 1000 == 0, 2_000_000).otherwise(3_000)
    pairs = interval_join(points, spans.withColumn("e", F.col("s") + long), ["k"], "t", "s", "e")
    matches = pairs.count()
    assert matches > 60_000
    plan = pairs._jdf.queryExecution().analyzed()
    tested = [plan.apply(i) for i in range(40) if plan.apply(i) is not None and plan.apply(i).nodeName() == "Join"]
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, tested[0]).count() if tested else 0
    assert matches <= rows <= 3 * matches


def test_interval_join_cuts_no_intervals_of_keys_without_points(spark):
    points = spark.range(100).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("p"), (F.col("id") * 10).alias("t"))
    spans = spark.range(1000).select((F.col("id") % 100).alias("k"), F.col("id").alias("i"), F.lit(None).cast("long").alias("e"), F.lit(0).cast("long").alias("s"))
    pairs = interval_join(points, spans, ["k"], "t", "s", "e")
    assert pairs.count() == 1000
    plan = pairs._jdf.queryExecution().analyzed()
    top = next(plan.apply(i) for i in range(40) if plan.apply(i) is not None and plan.apply(i).nodeName() == "Join")
    assert spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, top.children().apply(1)).count() <= 10 * 17


def test_pairs_of_small_inputs_are_spread(spark):
    """A point side of one partition and few intervals: their pairs, which are many, come in several tasks."""
    points = spark.range(0, 2000, 1, 1).select(F.lit("hot").alias("k"), F.col("id").alias("p"), F.col("id").alias("t"))
    spans = spark.range(0, 50, 1, 1).select(F.lit("hot").alias("k"), F.col("id").alias("i"), F.col("id").alias("s"), F.lit(None).cast("long").alias("e"))
    tasks = interval_join(points, spans, ["k"], "t", "s", "e").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == sum(2000 - s for s in range(50))
    assert len(tasks) >= 2


def test_interval_join_takes_dates_and_timestamps(spark):
    day = lambda d: datetime.date(2024, 3, d)
    spans = spark.createDataFrame([("a", 1, day(1), day(3)), ("a", 2, day(2), None)], "k string, i int, s date, e date")
    points = spark.createDataFrame([("a", d, day(d)) for d in range(1, 5)], "k string, p int, t date")
    expected = [(1, 1), (2, 1), (2, 2), (3, 2), (4, 2)]
    for kind in ("date", "timestamp", "timestamp_ntz"):
        cast = lambda df, *cs, kind=kind: df.withColumns({c: F.col(c).cast(kind) for c in cs})
        assert sorted((r.p, r.i) for r in interval_join(cast(points, "t"), cast(spans, "s", "e"), ["k"], "t", "s", "e").collect()) == expected


def test_exceptions_are_checked_in_order(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    given = spark.createDataFrame([(1, "P", "1", "board", at(2), at(4)), (2, "P", "1", "nobody", at(2), at(4)), (3, "P", "1", "board", at(2), None)], "authorization_id int, policy string, version string, authority string, effective_from timestamp_ntz, expiration timestamp_ntz")
    granted = "Exception Granted"
    asked = [
        (10, granted, "P", "1", at(2), 1, None), (11, granted, "P", "1", at(4), 1, 4), (12, granted, "P", "2", at(9), 1, 3), (13, granted, "Q", "1", at(9), 2, 2),
        (14, granted, "P", "1", at(3), None, 1), (15, granted, "P", "1", at(3), 99, 1), (16, "Compliant", "P", "1", at(3), 1, 0), (17, "Compliant", "P", "1", at(3), None, None),
        (18, granted, "P", "1", at(23), 3, None), (19, granted, None, "1", at(3), 1, 3), (20, None, "P", "1", at(3), 1, 0),
    ]
    evaluations = spark.createDataFrame([r[:6] for r in asked], "evaluation_id int, outcome string, policy string, version string, effective_from timestamp_ntz, authorization_id int")
    got = {r.evaluation_id: r.error for r in policy.exception_errors(evaluations, given, spark.createDataFrame([("board",), ("board",)], "authority string")).collect()}
    assert got == {r[0]: None if r[6] is None else policy.EXCEPTION_ERRORS[r[6]] for r in asked}
    force = {(r.evaluation_id, r.authorization_id) for r in policy.authorizations_in_force(evaluations, given).collect()}
    assert force == {(10, 1), (10, 2), (10, 3), (11, 3), *((i, a) for i in (14, 15, 16, 17, 20) for a in (1, 2, 3)), (18, 3)}


# ---- the latest fact


def plain_latest(rows, facts):
    out = {}
    for k, t, n in rows:
        seen = [f for f in facts if k is not None and t is not None and f[0] == k and f[1] is not None and f[1] <= t]
        best = max(seen, key=lambda f: f[1:3], default=None)
        out[n] = (best[2], best[3]) if best else (None, None)
    return out


@pytest.mark.parametrize("hot, times", [("aaaab", 300), ("a", 3), ("abcdefgh", 50)])
def test_latest_fact_as_of_each_row(spark, keep, hot, times):
    """One key with nearly all rows, one instant with a third of them, many keys; facts at the row's own time count."""
    rng = random.Random(times)
    some = lambda value: None if rng.random() < 0.03 else value
    rows = [(some(rng.choice(hot)), some(rng.randrange(times)), n) for n in range(600)]
    facts = [(some(rng.choice(hot)), some(rng.randrange(times)), n, f"f{n}") for n in range(40)]
    r, f = spark.createDataFrame(rows, "k string, t int, n int"), spark.createDataFrame(facts, "k string, t int, id int, said string")
    found = latest_fact(r, f, ["k"], "t", ["t", "id"], ["id", "said"], keep)
    assert found.columns == ["k", "t", "n", "id", "said"] and found.count() == len(rows)
    assert {x.n: (x.id, x.said) for x in found.collect()} == plain_latest(rows, facts)


def test_latest_fact_of_repeated_rows_and_none(spark, keep):
    r = spark.createDataFrame([("a", 5)] * 50 + [("b", 1)], "k string, t int")
    f = spark.createDataFrame([("a", 4, 1)], "k string, at int, id int")
    assert sorted((x.k, x.id) for x in latest_fact(r, f, ["k"], "t", ["at", "id"], ["id"], keep).collect()) == [("a", 1)] * 50 + [("b", None)]
    assert latest_fact(r, f.limit(0), ["k"], "t", ["at", "id"], ["id"], keep).filter("id IS NULL").count() == 51
    assert latest_fact(r.limit(0), f, ["k"], "t", ["at", "id"], ["id"], keep).count() == 0


# ---- paths

NODES, LINKS = "tenant_id string, entity_id string, entity_name string, entity_type_name string", "tenant_id string, relationship_name string, from_entity_id string, to_entity_id string"


def plain_paths(nodes, links, starts, target, depth):
    kind, out = {n: k for n, k in nodes}, []

    def walk(start, at, seen, steps):
        if len(steps) == depth:
            return
        for rel, a, b in links:
            if a == at and b in kind and b not in seen:
                if kind[b] == target:
                    out.append((start, b, (*steps, rel)))
                else:
                    walk(start, b, {*seen, b}, (*steps, rel))

    for s in starts:
        if s in kind:
            walk(s, s, {s}, ())
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_pruned_paths_are_all_paths(spark, keep, seed):
    rng = random.Random(seed)
    nodes = [(f"n{i}", rng.choice(["X", "X", "X", "End", "Y"])) for i in range(14)]
    links = [(f"r{j}", f"n{rng.randrange(14)}", f"n{rng.randrange(16)}") for j in range(24)]  # some ends are no entities
    e = spark.createDataFrame([("t", n, n.upper(), k) for n, k in nodes], NODES)
    g = spark.createDataFrame([("t", *x) for x in links], LINKS)
    starts = [n for n, _ in nodes] + ["gone"]
    s = spark.createDataFrame([("t", n) for n in starts], "tenant_id string, start_id string")
    for depth in (1, 4):
        got = graph.paths_to_type(s, e, g, "End", depth, keep).collect()
        assert sorted((r.start_id, r.target_id, tuple(x.relationship_name for x in r.steps)) for r in got) == plain_paths(nodes, links, starts, "End", depth)


def test_walks_end_when_nothing_is_new(spark, keep):
    """A cycle from which no target can be reached, and one that is walked round: depth adds no work."""
    e = spark.createDataFrame([("t", f"n{i}", f"N{i}", "X") for i in range(4)] + [("t", "z", "Z", "End")], NODES)
    g = spark.createDataFrame([("t", "r", f"n{i}", f"n{(i + 1) % 4}") for i in range(4)], LINKS)
    s = spark.createDataFrame([("t", "n0")], "tenant_id string, start_id string")
    work = []
    for depth in (6, 12, 40):
        before = keep.calls
        assert graph.paths_to_type(s, e, g, "End", depth, keep).isEmpty()
        assert {(r.node, r.depth) for r in graph.reachable(s, g, depth, keep).collect()} == {("n1", 1), ("n2", 2), ("n3", 3)}
        work.append(keep.calls - before)
    assert work[0] == work[1] == work[2]


def test_each_hop_is_joined_once(spark, keep):
    e = spark.createDataFrame([("t", f"n{i}", f"N{i}", "End" if i == 5 else "X") for i in range(6)], NODES)
    g = spark.createDataFrame([("t", "r", f"n{i}", f"n{i + 1}") for i in range(5)], LINKS)
    found = graph.paths_to_type(spark.createDataFrame([("t", "n0"), ("t", "n3")], "tenant_id string, start_id string"), e, g, "End", 6, keep)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 6  # the starts that are entities, then a front and the hops that arrive for each of five depths
    assert sorted((r.start_id, r.depth) for r in found.collect()) == [("n0", 5), ("n3", 2)]


# ---- names


def invented(rng, n):
    """Company-like names, some edited, some equal in letters only, some empty."""
    words = ["global", "nord", "pacific", "semi", "metal", "paper", "chip", "foods", "trans", "union", "delta", "quartz", "ö", "漢字"]
    out = ["", "a", "aa", "tide", "diet"]
    while len(out) < n:
        name = " ".join(rng.sample(words, rng.randrange(1, 4)))
        out.append(name)
        if rng.random() < 0.5:
            at = rng.randrange(len(name))
            out.append(name[:at] + rng.choice(["x", "", "qq"]) + name[at + 1 :])
    return out[:n]


@pytest.mark.parametrize("threshold, slice_size", [(0.65, 2000), (0.65, 7), (0.9, 2000), (0.3, 20), (1.0, 2000)])
def test_similar_names_are_those_of_all_pairs(spark, threshold, slice_size):
    rng = random.Random(int(threshold * 100))
    a, b = ([(rng.choice("tttu"), x) for x in invented(rng, 110)] + [(None, "tide"), ("t", None)] for _ in range(2))
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    expected = {(t, x, y): ratio(x, y) for t, x in set(a) for u, y in set(b) if t and t == u and x is not None and y is not None and ratio(x, y) >= threshold}
    got = names.similar_names(spark.createDataFrame(a, "tenant_id string, a string"), spark.createDataFrame(b, "tenant_id string, b string"), threshold, slice_size).collect()
    assert len(got) == len(expected) and {(r.tenant_id, r.a, r.b): r.score for r in got} == expected


def test_few_pairs_of_names_are_scored(spark):
    """The share of all pairs that the bounds leave to the measure, at the threshold of the candidates."""
    rng = random.Random(5)
    syllables = ["ka", "to", "mi", "ren", "sol", "ber", "lin", "dar", "vex", "pho", "gri", "num", "zal", "qui", "wex", "yor", "hub", "jen", "cra", "fet"]
    made = lambda: ("".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5))) + " " + "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 4)))).strip()
    a, b = sorted({made() for _ in range(400)}), sorted({made() for _ in range(400)})
    left, right = spark.createDataFrame([("t", x) for x in a], "tenant_id string, a string"), spark.createDataFrame([("t", x) for x in b], "tenant_id string, b string")
    share = names.pairs_to_score(left, right, 0.65).count() / (len(a) * len(b))
    assert share < 0.1
    with pytest.raises(ValueError):
        names.pairs_to_score(left, right, 0.0)


def test_names_much_alike_are_paired_once_without_characters(spark):
    """Numbered names share nearly all characters: their tenant's pairs are taken as they are, and come out the same as by characters."""
    rows = [(t, f"supplier {i:06d}") for t in (1, 2) for i in range(0, 9000, 300)] + [(3, n) for n in ("acme", "bolt works", "zenith", "quartz ltd")]
    a, b = spark.createDataFrame(rows, "tenant_id int, a string"), spark.createDataFrame(rows, "tenant_id int, b string")
    order = a.select(F.explode(similarity.letters(F.col("a"))).alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
    by_a, by_b = names.indexed(a, order, "a"), names.indexed(b, order, "b")
    plainly = names._better_without(by_a, by_b, names._prefixes(by_a, "a", "a", 0.65), names._prefixes(by_b, "b", "b", 0.65))
    assert {1, 2} <= {r.tenant_id for r in plainly.collect()}
    pairs = [tuple(r) for r in names.similar_names(a, b, 0.65, slice_size=20).select("tenant_id", "a", "b").collect()]
    expected = {(t, x, y) for t, x in rows for u, y in rows if t == u and difflib.SequenceMatcher(None, x, y).ratio() >= 0.65}
    assert len(pairs) == len(expected) and set(pairs) == expected


def test_pairs_of_slices_are_spread_over_tasks(spark):
    """The pairs of one key, read from a single small partition, are made in several tasks."""
    left = spark.range(400).coalesce(1).select(F.lit(1).alias("k"), F.col("id").alias("x"))
    right = spark.range(40).coalesce(1).select(F.lit(1).alias("k"), F.col("id").alias("y"))
    per = joins.in_slices(left, right, ["k"], "x", "y", 20).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in per) == 16_000 and len(per) > 1 and max(r["count"] for r in per) < 12_000


@pytest.mark.parametrize("seed", range(3))
def test_targets_reached_are_the_ends_of_paths(spark, keep, seed):
    """Cycles, loops, parallel edges, unknown nodes, targets as starts, and targets only beyond other targets."""
    rng = random.Random(seed)
    kinds = {f"n{i}": rng.choice("ABBC") for i in range(14)}
    entities = spark.createDataFrame([("t", n, f"name {n}", k) for n, k in kinds.items()], "tenant_id string, entity_id string, entity_name string, entity_type_name string")
    edges = spark.createDataFrame([("t", "r", f"n{rng.randrange(15)}", f"n{rng.randrange(15)}") for _ in range(24)], "tenant_id string, relationship_name string, from_entity_id string, to_entity_id string")
    starts = entities.select("tenant_id", F.col("entity_id").alias("start_id"))
    for depth in (1, 2, 4):
        paths = graph.paths_to_type(starts, entities, edges, "C", depth, keep).select("tenant_id", "start_id", "target_id", "target_name")
        reached = graph.targets_reached(starts, keep(graph.typed_hops(entities, edges)), "C", depth, keep)
        assert {tuple(r) for r in reached.collect()} == {tuple(r) for r in paths.collect()}


def test_suppliers_of_one_name_are_asked_about_once_each(spark, tmp_path):
    given = "/root/testdata/sf0.001"
    for name in ("part", "orders", "lineitem", "nation", "region"):
        spark.read.parquet(f"{given}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    suppliers = spark.read.parquet(f"{given}/supplier.parquet").withColumn("s_name", F.lit("Same Name"))
    suppliers.write.parquet(f"{tmp_path}/supplier.parquet")
    answers = registry.queries()["cvg_08_ask_products"](spark, str(tmp_path)).collect()
    assert sorted(r.start_id for r in answers) == sorted(f"S:{r.s_suppkey}" for r in suppliers.collect())


def test_inclusions_are_not_sets_in_memory(spark):
    """Bits of columns are added up, before the shuffle as well; more columns than a number has bits."""
    names = [f"c{i}" for i in range(70)]
    frame = spark.range(5).select(*[(F.col("id") + (i % 3)).alias(n) for i, n in enumerate(names)])
    found = validation.inclusions({"t": {n: F.col(n) for n in names}}, {"t": frame})
    rows = {(r.a, r.b): (r.n_values, r.n_broken) for r in found.collect()}
    assert rows == {(f"t.{a}", f"t.{b}"): (5, abs(i % 3 - j % 3)) for i, a in enumerate(names) for j, b in enumerate(names) if i != j}
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()


# ---- units of materials and alternates


def shuffled_rows(spark, run):
    """Rows that the stages of ``run`` write to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    run()
    return sum(n for stage, n in written().items() if stage not in before)


@pytest.fixture
def supply(spark, tmp_path):
    """A folder with ``n`` suppliers from ``first`` by ``step``, each with ``parts`` parts, two lines of one of them."""

    def made(n, parts, first=0, step=1):
        folder = str(tmp_path / f"{n}-{parts}-{first}-{step}")
        keys = spark.range(n).select((F.col("id") * step + first).alias("s_suppkey"))
        keys.select("s_suppkey", (F.col("s_suppkey") % 4).cast("int").alias("s_nationkey"), ((F.col("s_suppkey") * 37) % 3000).cast("double").alias("s_acctbal")).write.parquet(f"{folder}/supplier.parquet")
        spark.range(4).select(F.col("id").cast("int").alias("n_nationkey"), F.col("id").cast("int").alias("n_regionkey")).write.parquet(f"{folder}/nation.parquet")
        lines = keys.select(F.col("s_suppkey").alias("l_suppkey"), F.explode(F.sequence(F.lit(0), F.lit(parts))).alias("l")).select("l_suppkey", (F.greatest("l", F.lit(1))).cast("long").alias("l_partkey"))
        price = F.when(F.col("l_partkey") % 2 == 0, 2e6).otherwise(1.0)
        day = F.when(F.col("l_suppkey") % 3 == 0, F.lit("1995-01-01")).otherwise("1998-05-01").cast("timestamp_ntz")
        lines.select("*", price.alias("l_extendedprice"), F.lit("O").alias("l_linestatus"), F.lit("N").alias("l_returnflag"), day.alias("l_shipdate")).write.parquet(f"{folder}/lineitem.parquet")
        return folder

    return made


@pytest.fixture
def broadcasts(spark):
    """Sets the size up to which sides of joins are broadcast, for a test."""
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    yield lambda threshold: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_materials_are_not_shuffled_for_alternates(spark, supply, broadcasts):
    """Without broadcasts they are shuffled to be distinct, to meet suppliers and to be spread, and 40,000 valid ones are counted; none is copied."""
    broadcasts("-1")
    units = registry.queries()["pol_13_gate_f_units"](spark, supply(600, 100))
    rows = shuffled_rows(spark, lambda: units.write.format("noop").mode("overwrite").save())
    assert 220_000 <= rows <= 3.1 * 60_000 + 40_000
    per = units.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in per) == 60_000 * 120 and len(per) > 1


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
@pytest.mark.parametrize("first, step", [(0, 1), (1, 5)])
def test_units_of_few_and_no_alternates(spark, supply, broadcasts, threshold, first, step):
    """Against plain loops, with and without broadcasts; without alternates (no key is divisible by 5) materials stay."""
    folder = supply(40, 15, first, step)
    suppliers = [(i * step + first, (i * step + first) * 37 % 3000) for i in range(40)]
    others = [(k, None if k % 3 == 0 else b > 2000, b > 1000) for k, b in suppliers if k % 5 == 0] or [(None, None, None)]
    expected = set()
    for s, _ in suppliers:
        severe = {0: None, 1: False}.get(s % 4, True)
        for p in range(1, 16):
            single, material = s % 3 != 0 and p != 1, None if p % 7 == 0 else p % 2 == 0
            for a, qualified, capacity in others:
                facts = [(severe, "not-severe"), (single, "not-single-sourced"), (material, "not-material"), (a is not None, "no-candidate"), (qualified, "not-qualified"), (capacity, "no-capacity")]
                reason = next((why for fact, why in facts if fact is False), None)
                outcome = "REJECTED" if reason else "RECOMMENDED" if all(fact for fact, _ in facts) else None
                expected.add((s, p, a, outcome, reason))
    broadcasts(threshold)
    found = [tuple(r) for r in registry.queries()["pol_13_gate_f_units"](spark, folder).collect()]
    assert len(found) == len(expected) and set(found) == expected
