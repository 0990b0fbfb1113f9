"""Golden cases of the operators: graphs, evidence, policies, histories, state."""

import datetime
import random
import zipfile
from collections import deque

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import aggregates, coverage, graph, joins, pipeline, policy, ranking, resolution, temporal, validation
from quorumlake.sources import archives, sinks, text_formats
from quorumlake.streaming import admission, rate_limit

ENTITIES = "tenant_id string, entity_id string, entity_name string, entity_type_name string"
EDGES = "tenant_id string, relationship_name string, from_entity_id string, to_entity_id string"


def walk(spark, entities, edges, start, target, depth=6):
    e, g = spark.createDataFrame([("t", *x) for x in entities], ENTITIES), spark.createDataFrame([("t", *x) for x in edges], EDGES)
    rows = graph.paths_to_type(spark.createDataFrame([("t", start)], "tenant_id string, start_id string"), e, g, target, depth, lambda df: spark.createDataFrame(df.collect(), df.schema)).collect()
    return sorted((r.target_id, r.depth) for r in rows)


def test_paths(spark):
    nodes = [("s", "TSMC", "Supplier"), ("m1", "M1", "Material"), ("m2", "M2", "Material"), ("b1", "B1", "BOM"), ("b2", "B2", "BOM"), ("pa", "A", "Product"), ("pb", "B", "Product"), ("lone", "L", "Supplier")]
    edges = [("supplies", "s", "m1"), ("supplies", "s", "m2"), ("usedIn", "m1", "b1"), ("usedIn", "m2", "b2"), ("defines", "b1", "pa"), ("defines", "b2", "pb"), ("back", "b1", "s"), ("next", "pa", "pb")]
    assert walk(spark, nodes, edges, "s", "Product") == [("pa", 3), ("pb", 3)]
    assert walk(spark, nodes, edges[::-1], "s", "Product") == [("pa", 3), ("pb", 3)]
    assert walk(spark, nodes, [*edges, edges[0]], "s", "Product") == [("pa", 3), ("pa", 3), ("pb", 3)]  # parallel edges, parallel paths
    assert walk(spark, nodes, edges, "lone", "Product") == []
    assert walk(spark, nodes, edges, "s", "Supplier") == []  # no zero-hop, and no path back to the start
    chain = [(f"n{i}", f"N{i}", "X" if i < 9 else "End") for i in range(10)]
    links = [("r", f"n{i}", f"n{i + 1}") for i in range(9)]
    assert walk(spark, chain, links, "n0", "End", 3) == []
    assert walk(spark, chain, [*links, ("r", "n2", "gone")], "n4", "End", 5) == [("n9", 5)]


def test_reachable_nodes_are_those_of_a_plain_search(spark):
    """Cycles, loops and parallel edges, in two tenants that share ids."""
    links = {t: [(i, (i * k + 3) % 40) for i in range(40) for k in ks] + [(7, 7), (1, 4), (1, 4)] for t, ks in (("a", (2, 5)), ("b", (1,)))}
    edges = spark.createDataFrame([(t, f"n{a}", f"n{b}") for t, pairs in links.items() for a, b in pairs], "tenant_id string, from_entity_id string, to_entity_id string")
    starts = [(t, f"n{i}") for t in links for i in range(0, 40, 3)] + [("a", "n0"), ("a", "lone")]
    expected = set()
    for tenant, start in starts:
        depths, queue = {start: 0}, deque([start])
        while queue:
            at = queue.popleft()
            for a, b in links[tenant]:
                if f"n{a}" == at and f"n{b}" not in depths and depths[at] < 3:
                    depths[f"n{b}"] = depths[at] + 1
                    queue.append(f"n{b}")
        expected |= {(tenant, start, node, depth) for node, depth in depths.items() if depth}
    got = [tuple(r) for r in graph.reachable(spark.createDataFrame(starts, "tenant_id string, start_id string"), edges, 3, lambda df: spark.createDataFrame(df.collect(), df.schema)).collect()]
    assert len(got) == len(expected) and set(got) == expected


SOURCES = "case_id int, source_system_name string, display_name string, trading_name string, aliases array<string>, acronym string, website_domain string, email_domain string, country string, registered_address string, postal_code string, strong_identifiers array<struct<type:string,value:string>>, parent_entity_name string"
TARGETS = "case_id int, candidate_name string, candidate_country string, candidate_parent_entity_name string"
TAX = "STRONG_IDENTIFIER_TAX_REGISTRATION"


def decided(spark, taxes, parent=(None, None)):
    rows = []
    for case, tax in enumerate(taxes):
        named = [("CRM", "TSMC", "TSMC", "tsmc.com"), ("ERP", "TSMC Inc.", "TSMC", None), ("Registry", "Taiwan Semiconductor Manufacturing Company Limited", None, "tsmc.com")]
        for (system, name, acronym, site), t in zip(named, tax, strict=True):
            rows.append((case, system, name, None, [], acronym, site, None, "Taiwan", None, None, [(TAX, t)] if t else [], parent[0]))
    targets = [(c, "Taiwan Semiconductor Manufacturing Company Limited", "Taiwan", parent[1]) for c in range(len(taxes))]
    reps, cands = spark.createDataFrame(rows, SOURCES), spark.createDataFrame(targets, TARGETS)
    policies = policy.presets(reps).filter("policy = 'Conservative'")
    items = resolution.evidence(reps.repartition(3), cands, policies)
    return {r.case_id: r for r in resolution.decide(items, policies).collect()}, items


def test_evidence_goldens(spark):
    out, items = decided(spark, [(None, None, None), ("T1", " t1", "T1"), ("T1", "T2", None)])
    assert (out[0].outcome, out[0].confidence, out[0].score) == ("Possible Resolution", "Medium", 0.75)
    assert (out[1].outcome, out[1].confidence) == ("Resolved", "High")
    assert (out[2].outcome, out[2].confidence, out[2].score) == ("Blocked Conflict", "Low", 0.0)
    assert items.groupBy("case_id").count().filter("count <> 16").isEmpty()


def test_parent_conflict_vetoes(spark):
    out, _ = decided(spark, [("T1", "T1", "T1")], parent=("Hold Co", "Other"))
    assert out[0].outcome == "Blocked Conflict"
    out, _ = decided(spark, [("T1", "T1", "T1")], parent=("Hold Co", None))
    assert out[0].outcome == "Resolved"


def test_names_alone_never_resolve(spark):
    reps = spark.createDataFrame([(0, "A", "Acme Ltd", "Acme", ["ACME inc"], None, None, None, None, None, None, [], None)], SOURCES)
    cands = spark.createDataFrame([(0, "Acme", None, None)], TARGETS)
    policies = policy.presets(reps)
    assert {r.outcome for r in resolution.decide(resolution.evidence(reps, cands, policies), policies).collect()} <= {"Unresolved", "Possible Resolution"}


TRI = [True, False, None]


def test_classification_is_three_valued(spark):
    rows = [(a, b, c, has, q, k) for a in TRI for b in TRI for c in TRI for has in (True, False) for q in (TRI if has else [None]) for k in (TRI if has else [None])]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean, has boolean, q boolean, k boolean")
    outcome, reason = policy.classify(*[F.col(x) for x in ("a", "b", "c", "has", "q", "k")])
    for r in df.select("*", outcome.alias("o"), reason.alias("r")).collect():
        known = [("not-severe", r.a), ("not-single-sourced", r.b), ("not-material", r.c), ("no-candidate", r.has), ("not-qualified", r.q), ("no-capacity", r.k)]
        first = next((name for name, value in known if value is False), None)
        assert r.r == first and r.o == ("REJECTED" if first else "RECOMMENDED" if all(v for _, v in known) else None)


def test_materiality(spark):
    df = spark.createDataFrame([("10000000",), ("10000000.01",), ("1_000",), ("12d",), (None,), (" 2e7 ",)], "s string")
    assert [r.m for r in df.select(policy.is_material(policy.number(F.col("s")), 10_000_000.0).alias("m")).collect()] == [False, True, None, None, None, True]
    assert spark.range(1).select(policy.is_material(F.lit(float("nan")), 1.0).alias("m")).first().m is False


def test_risk_policy_matrix(spark):
    ask = lambda sev, src, ready, exc: spark.range(1).select(policy.recommendation(F.lit(sev), F.lit(src), F.lit(ready), F.lit(exc)).alias("r")).first().r
    assert ask("LOW", "SINGLE_SOURCE", False, False) == "CONTINUE_MONITORING"
    assert ask("MATERIAL", "SINGLE_SOURCE", False, False) == "QUALIFY_SECOND_SOURCE"
    assert ask("HIGH", "DUAL_SOURCE", True, False) == "ACTIVATE_APPROVED_SECOND_SOURCE"
    assert ask("HIGH", "DUAL_SOURCE", True, True) == ask("CRITICAL", "NO_QUALIFIED_SOURCE", False, False) == "ESCALATE_FOR_HUMAN_REVIEW"
    worst = spark.createDataFrame([(["HIGH", "LOW", "CRITICAL"],), ([],)], "s array<string>").select(aggregates.worst(F.col("s")).alias("t"), aggregates.worst(F.col("s"), "rank").alias("r")).collect()
    assert [tuple(r) for r in worst] == [("LOW", "CRITICAL"), ("LOW", "LOW")]


def test_quality_of_a_complete_ontology(spark):
    concepts = spark.createDataFrame([(c, "d", "Approved") for c in graph.CONCEPTS], "concept string, definition string, status string")
    relations = spark.createDataFrame([(*r, "Approved") for r in graph.RELATIONS], "relation string, source string, target string, status string")
    assert {r.score for r in coverage.ontology_quality(concepts, relations).collect()} == {1.0}
    part = {r.dimension: r.score for r in coverage.ontology_quality(concepts.filter("concept <> 'Contract'"), relations).collect()}
    assert part["concept_coverage"] == 0.9 and part["mapping_completeness"] == 0.8 and part["relationship_coverage"] == 1.0
    proposed = concepts.withColumn("status", F.when(F.col("concept") == "BOM", "Proposed").otherwise(F.col("status")))
    assert [r.dimension for r in coverage.ontology_quality(proposed, relations).collect() if not r.passed] == ["governance_status_completeness"]


def test_white_space_is_evidence(spark):
    fields = spark.createDataFrame([(1,), (2,), (3,)], "source_field_id int")
    seen = spark.createDataFrame([(1, ""), (1, ""), (2, ""), (2, " ")], "source_field_id int, representation string")
    assert {r.source_field_id: r.availability for r in coverage.evidence_availability(fields, seen).collect()} == {1: "EVIDENCE_EMPTY", 2: "EVIDENCE_PRESENT", 3: "NO_EVIDENCE"}


def test_record_order(spark):
    t = datetime.datetime
    log = spark.createDataFrame([("k", t(2024, 1, 1), t(2024, 1, 2), "a"), ("k", t(2024, 1, 1), t(2024, 1, 2), "b"), ("k", t(2024, 3, 1), t(2024, 1, 1), "c")], "k string, f timestamp, p timestamp, id string")
    order = ["f", "p", "id"]
    kept = log.withColumn("current", F.col("id"))
    assert temporal.current_as_of(kept, ["k"], F.lit(t(2024, 2, 1)), order, ["current"]).first().current == "b"
    assert temporal.current_as_of(kept, ["k"], F.lit(t(2024, 3, 1)), order, ["current"]).first().current == "c"
    assert temporal.history(log, ["k"], order, "id").first().history == ["c", "b", "a"]


def test_resume_ordinals(spark):
    rows = [(1, 0, True), (1, 1, True), (2, 0, True), (2, 1, False), (2, 2, True), (3, 0, True), (3, 2, True)]
    out = {r.k: (r.valid, r.resume_at) for r in ranking.next_ordinal(spark.createDataFrame(rows, "k int, o int, ok boolean"), "k", "o", F.col("ok")).collect()}
    assert out == {1: (True, 2), 2: (True, 1), 3: (False, 2)}


def test_audit_finds_both_sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (3, "a")], "k int, p string")
    right = spark.createDataFrame([(1, "b"), (4, "a"), (3, "a")], "k int, p string")
    assert {r.k: r.violation for r in joins.audit(left, right, ["k"], "p").collect()} == {1: "MISMATCH", 2: "MISSING", 3: "DUPLICATE", 4: "ORPHAN"}


def test_strict_joins_raise(spark):
    with pytest.raises(Exception, match="no partner"):
        joins.required(spark.range(2), spark.range(1), ["id"], strict=True).collect()


def calls(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [("k", i, start + datetime.timedelta(seconds=s)) for i, s in enumerate([0, 10, 59, 60, 61, 70, 119, 121, 122])] + [("j", 100, start)]
    return spark.createDataFrame(rows, "key string, id long, ts timestamp"), rows


def test_rate_limit_matches_a_log(spark):
    df, rows = calls(spark)
    expected, log = {100: True}, deque()
    for _, i, ts in rows[:-1]:
        while log and log[0] <= ts - datetime.timedelta(seconds=60):
            log.popleft()
        expected[i] = len(log) < 2
        if expected[i]:
            log.append(ts)
    got = {r.call_id: r.admitted for r in rate_limit.limited(df, "key", "ts", "id", limit=2).collect()}
    assert got == expected


def test_streams_equal_batches(spark, tmp_path):
    df, _ = calls(spark)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = admission.finished(rate_limit.limited_stream(stream(), "key", "ts", "id", limit=2), f"{tmp_path}/a")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in rate_limit.limited(df, "key", "ts", "id", limit=2).collect()}
    digest = lambda d: d.withColumn("digest", (F.col("id") % 2).cast("string"))
    admitted = admission.finished(admission.admitted_stream(digest(stream()), "key", "ts", "digest", "id"), f"{tmp_path}/b")
    batch = pipeline.admit(digest(df), ["key"], ["ts", "id"], "digest")
    assert {tuple(r) for r in admitted.collect()} == {(r.id, r.status) for r in batch.collect()}


def test_a_gated_request_stops(spark):
    yes = F.lit(True)
    stages = [pipeline.Stage("erm", F.lit("x"), F.when(F.col("id") == 1, "GATE"), yes), pipeline.Stage("srm", F.lit("y"), F.lit(None).cast("string"), yes, failed=F.col("id") == 2)]
    out = {r.id: (r.gate_code, r.failed_stage, r.n_records, r.srm_value) for r in pipeline.run_stages(spark.range(3), stages).collect()}
    assert out == {0: (None, None, 2, "y"), 1: ("GATE", None, 1, None), 2: (None, "srm", 1, None)}


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "rows.zip", "w") as z:
        z.writestr("b.csv", "﻿id,name\n1,x\n2,y\n")
        z.writestr("a.csv", "id\n7\n")
        z.writestr("note.txt", "no")
    rows = archives.zipped_csv(archives.files(spark, str(tmp_path / "rows.zip"))).orderBy("member", "row").collect()
    assert [(r.member, r.row, r.record) for r in rows] == [("a.csv", 0, '{"id": "7"}'), ("b.csv", 0, '{"id": "1", "name": "x"}'), ("b.csv", 1, '{"id": "2", "name": "y"}')]
    assert len({r.id for r in rows}) == 3 and all(len(r.name) == 24 for r in rows)
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="5"><c r="A5" t="inlineStr"><is><t>x</t></is></c><c r="C5"><v>3</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "m.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    assert [(r.row, r.cells) for r in archives.xlsx_rows(archives.files(spark, str(tmp_path / "m.xlsx")), 5).collect()] == [(5, ["x", "", "3"])]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", body)
    assert [r.text for r in archives.docx_blocks(archives.files(spark, str(tmp_path / "d.docx"))).orderBy("place").collect()] == ["One", "a | b"]
    assert archives.digests(spark, str(tmp_path / "d.docx")).first().length == (tmp_path / "d.docx").stat().st_size


def test_line_formats(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a , b,c,d\n1\n\n2,x,y,z,w\n")
    lines = text_formats.numbered_lines(spark, str(tmp_path / "t.csv")).filter("line > 0")
    rows = text_formats.simple_csv(lines, ["a", "b", "c"]).orderBy("line").collect()
    assert [(r.a, r.b, r.c) for r in rows] == [("1", "", ""), ("2", "x", "y")]
    (tmp_path / "s.csv").write_text("x,y\n1,2\n")
    assert text_formats.strict_csv(spark, str(tmp_path / "s.csv"), ["x", "y"]).count() == 1
    with pytest.raises(ValueError):
        text_formats.strict_csv(spark, str(tmp_path / "s.csv"), ["x", "z"])


def test_sinks(spark):
    key, version = F.lit("0123456789abcdef").cast("binary"), F.lit("1")
    sealed = spark.createDataFrame([("secret",)], "p string").select(sinks.sealed(F.col("p").cast("binary"), key, version, "k").alias("c"))
    assert sealed.select(sinks.opened(F.col("c"), key, version, "k").cast("string").alias("p")).first().p == "secret"
    with pytest.raises(Exception):
        sealed.select(sinks.opened(F.col("c"), key, F.lit("2"), "k")).collect()


def test_validation(spark):
    rows = spark.createDataFrame([("a", 0, "x"), ("a", 1, ""), ("b", 2, None), ("c", 3, "q")], "id string, row int, ref string")
    targets = spark.createDataFrame([("x",), ("",)], "k string")
    found = validation.issues([validation.repeated_keys(rows, "f", "id", "row"), validation.broken_references(rows, "f", "ref", "row", targets, "k")])
    assert sorted((r.row_index, r.problem) for r in found.collect()) == [(1, "BROKEN_REFERENCE"), (1, "DUPLICATE_KEY"), (2, "BROKEN_REFERENCE"), (3, "BROKEN_REFERENCE")]


def test_slices_give_the_whole_product(spark):
    """A key with most rows on both sides, keys of one side only, and slices smaller than either."""
    left = spark.createDataFrame([("a", i) for i in range(60)] + [("b", 1), ("only", 2), (None, 3)], "k string, x int")
    right = spark.createDataFrame([("a", i) for i in range(25)] + [("b", 1), ("b", 1), ("other", 2), (None, 3)], "k string, y int")
    expected = sorted(tuple(r) for r in left.join(right, "k").collect())
    for size in (7, 1000):
        assert sorted(tuple(r) for r in joins.in_slices(left, right, ["k"], "x", "y", size).collect()) == expected


def test_places_are_those_of_the_whole_table(spark, tmp_path):
    rows = [(k * 7919 % 13 if k % 10 else None, k) for k in range(500)] + [(5, 3), (5, 3)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    df = spark.createDataFrame(rows, "v long, k long")

    def keep(frame):
        path = str(tmp_path / f"n{len(list(tmp_path.iterdir()))}")
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    for coalesce in ("true", "false"):  # one range, and several
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        got = ranking.places(df, ["v", "k"], keep).orderBy("place").collect()
        assert [r["place"] for r in got] == list(range(1, len(rows) + 1)) and [(r["v"], r["k"]) for r in got] == order
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranking.places(df.limit(0), ["v", "k"], keep).isEmpty()


@pytest.mark.parametrize("threshold", [0.65, 0.9, 1.0])
def test_similar_names_are_those_of_all_pairs(spark, threshold):
    """Every pair of distinct names of a tenant by the plain measure: the native bounds lose none."""
    import difflib
    import random

    rng = random.Random(4)
    names = [(t, "".join(rng.choice("aab c1") for _ in range(rng.randrange(0, 9)))) for t in "xy" for _ in range(60)]
    names += [("x", "acme corp"), ("x", "acme corp"), ("y", "acme corp."), ("x", "acme co"), ("x", None)]
    rows = spark.createDataFrame(names, "tenant_id string, a string")
    out = resolution.similar_names(rows, rows.withColumnRenamed("a", "b"), threshold).collect()
    known = {n for n in names if n[1] is not None}
    expected = {(t, a, b): difflib.SequenceMatcher(None, a, b).ratio() for t, a in known for u, b in known if t == u}
    assert {(r.tenant_id, r.a, r.b): r.score for r in out} == {k: v for k, v in expected.items() if v >= threshold}
    assert len(out) == len({(r.tenant_id, r.a, r.b) for r in out})


def test_reasons_of_cases_without_rules_are_their_explanations(spark):
    schema = "case_id int, source_system_name string, display_name string, trading_name string, aliases array<string>, acronym string, website_domain string, email_domain string, country string, registered_address string, postal_code string, strong_identifiers array<struct<type: string, value: string>>, parent_entity_name string"
    lei = "STRONG_IDENTIFIER_LEI"
    rows = [
        (1, "CRM", "Acme Inc", None, None, None, None, None, None, None, None, [], None),
        (2, "CRM", "Acme", None, None, None, None, None, None, None, None, [(lei, "A")], None),
        (2, "ERP", "Acme", None, None, None, None, None, None, None, None, [(lei, "B"), (lei, " ")], None),
        (3, "CRM", "Zeta", None, None, None, None, None, "TW", None, None, [], None),
    ]
    candidates = spark.createDataFrame([(1, "Acme", None, None), (2, "Acme", None, None), (3, "Other Name", "US", None)], "case_id int, candidate_name string, candidate_country string, candidate_parent_entity_name string")
    policies = policy.presets(candidates)
    items = resolution.evidence(spark.createDataFrame(rows, schema), candidates, policies)
    masked = items.filter(f"case_id = 2 and policy = 'Balanced' and evidence_type = '{lei}'").first()
    assert (masked["values"], masked.provenance) == (["fp:conflict:0", "fp:conflict:1"], "CRM; ERP")
    got = {(r.case_id, r.policy): (r.triggered_veto, r.triggered_mandatory, r.reasons) for r in resolution.reasons(items, policies).collect()}
    assert got[1, "Balanced"] == ([], [], ["LEGAL_NAME_MATCH: Legal Name matches the candidate exactly for: CRM.", "ACRONYM_MATCH: Derived acronym 'A' matches: CRM.", "LEGAL_SUFFIX_NORMALIZED: A governed legal suffix was normalized for: CRM."])
    needed = "Policy requires one of: SOURCE_SYSTEM_CROSSWALK, STRONG_IDENTIFIER_EXTERNAL_ID, STRONG_IDENTIFIER_LEI, STRONG_IDENTIFIER_TAX_REGISTRATION"
    assert got[1, "Conservative"] == ([], [needed], [needed])
    veto = [f"Veto: {lei} conflicts (CRM; ERP)"]
    assert got[2, "Exploratory"] == (veto, [], veto)
    assert got[3, "Conservative"][0] == ["Veto: COUNTRY_MATCH conflicts (TW: CRM; US: candidate)"]
    assert got[3, "Balanced"][1] == ["Country or parent/subsidiary conflict forces steward review"]


def test_manifest_differences_and_dataset_issues_of_empty_and_null_rows(spark):
    listed = spark.createDataFrame([("a", "0" * 64), ("b", None), ("c", "1" * 64), ("c", "1" * 64), ("d", "2" * 64)], "path string, sha256 string")
    found = spark.createDataFrame([("a", "0" * 64), ("b", "3" * 64), ("c", "1" * 64), ("e", "4" * 64)], "path string, sha256 string")
    got = {r.path: r.problem for r in validation.manifest_differences(listed, found).collect()}
    assert got == {"b": "INVALID_DIGEST", "c": "DUPLICATE_ENTRY", "d": "MISSING", "e": "UNREGISTERED"}
    assert validation.manifest_differences(listed.limit(0), found.limit(0)).count() == 0
    fields = {f: "row_index long, " + ", ".join(sorted({c + " string" for g, c in validation.KEYS if g == f} | {c + " string" for g, c, _ in validation.REFERENCES if g == f})) for f, _ in validation.KEYS}
    files = {f: spark.createDataFrame([], schema) for f, schema in fields.items()}
    assert validation.dataset_issues(files).count() == 0
    files["suppliers.csv"] = spark.createDataFrame([(0, None), (1, None), (2, "s")], "row_index long, supplier_id string")
    files["materials.csv"] = spark.createDataFrame([(0, "m", "s"), (1, "n", "t"), (2, "o", None)], "row_index long, material_id string, supplier_id string")
    issues = {(r.file, r.row_index, r.message) for r in validation.dataset_issues(files).collect()}
    assert issues == {("suppliers.csv", 1, 'Duplicate supplier_id "" — first seen at row 1.'), ("materials.csv", 1, 'supplier_id "t" does not match any record in suppliers.csv.')}


def test_a_later_micro_batch_replays_conflicts_and_keeps_the_log(spark, tmp_path):
    """Two appended files, one a trigger: states live from one micro-batch to the next."""
    schema = "key string, ts timestamp, id long, digest string"
    at = datetime.datetime(2024, 1, 1)
    late = at + datetime.timedelta(seconds=30)
    parts = [[("a", at, 1, "x"), ("a", at, 2, "y"), ("b", at, 3, None), ("b", at, 4, None)], [("a", late, 5, "x"), ("a", late, 6, "z"), ("b", late, 7, "q"), ("c", late, 8, "x")]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p{i}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/p*")
    got = {r.request_id: r.status for r in admission.finished(admission.admitted_stream(stream(), "key", "ts", "digest", "id"), f"{tmp_path}/a").collect()}
    assert got == {1: "NEW", 2: "CONFLICT", 3: "NEW", 4: "REPLAY", 5: "REPLAY", 6: "CONFLICT", 7: "CONFLICT", 8: "NEW"}
    calls = {r.call_id: r.admitted for r in admission.finished(rate_limit.limited_stream(stream(), "key", "ts", "id", limit=3), f"{tmp_path}/b").collect()}
    assert calls == {1: True, 2: True, 3: True, 4: True, 5: True, 6: False, 7: True, 8: True}


def test_keys_stay_out_of_plans(spark):
    keys = spark.createDataFrame([("k1", bytearray(b"0123456789abcdef")), ("k2", bytearray(b"fedcba9876543210"))], "key_id string, key binary")
    rows = spark.createDataFrame([(1, "text"), (2, "")], "i int, payload string")
    seal = rows.select("i", sinks.sealed(F.col("payload").cast("binary"), sinks.key_of(keys, "k1"), F.lit("1"), "k1").alias("cipher"))
    back = seal.select("i", sinks.opened(F.col("cipher"), sinks.key_of(keys, "k1"), F.lit("1"), "k1").cast("string").alias("payload"))
    assert sorted(tuple(r) for r in back.collect()) == [(1, "text"), (2, "")]
    plan = seal.select("cipher")._jdf.queryExecution().executedPlan().toString()
    assert "0123456789abcdef" not in plan and b"0123456789abcdef".hex().upper() not in plan
    with pytest.raises(Exception):
        seal.select(sinks.opened(F.col("cipher"), sinks.key_of(keys, "k2"), F.lit("1"), "k1")).collect()


def test_scenario_amounts_are_rounded_by_their_exact_value(spark):
    """Halves go to the even number, and what only looks like a half is none."""
    rng = random.Random(7)
    amounts = [0.125, 0.375, 1.005, 2.675, 198.5, 0.5, 1.5, 2.5, 0.005, 0.015, 1e-20, 0.0, -0.0, -0.001, -2.675, 0.995, 1.995, 9.999, 99.995, 2.0**51 + 0.5, 2.0**53, 1e18, *[rng.randrange(10**7) / 1000 for _ in range(2000)], *[rng.randrange(10**5) + rng.randrange(1000) / 8 for _ in range(500)]]
    of = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    none, x = F.lit("x"), F.col("x")
    facts = spark.createDataFrame(list(enumerate(amounts)), "scenario_id int, x double").select(
        "scenario_id",
        *[of(id=none, name=none, status=none, unit_cost=x, region=none, severity=none, description=none, percent=none, terms=none, capacity=none, lead_days=none, annual=x * 1_000_000).alias(k) for k in "supplier region material product facility revenue event agreement candidate".split()],
    )
    said = {(r.scenario_id, r.kind): (r.label, r.details) for r in graph.scenario_nodes(facts).filter("kind IN ('material', 'revenue')").collect()}
    for i, amount in enumerate(amounts):
        assert said[i, "material"][1] == [f"Unit cost: ${amount:.2f}"]
        assert said[i, "revenue"][0] == f"${amount * 1_000_000 / 1_000_000:.0f}M Annual Revenue"
