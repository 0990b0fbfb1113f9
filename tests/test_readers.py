"""Readers with memory, closed documents, archives as a source and references found in data, against plain versions."""

import json
import random
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import validation
from quorumlake.sources import archives, documents, members, registries

# ---- registries


def plain_rows(text):
    section, header, out = "", [], []
    for i, line in enumerate(text):
        if line.startswith("## "):
            section, header = line[3:].strip(), []
        elif line.startswith("|"):
            cells = [c.strip() for c in line[1:-1].split("|")]
            if all(c and set(c.strip(":")) == {"-"} and c.count(":") <= 2 for c in cells):
                continue
            if not header:
                header = cells
            elif len(cells) == len(header):
                out.append((i, section, dict(zip(header, cells))))
    return out


def registry_lines(spark, files):
    return spark.createDataFrame([(f, i, v) for f, lines in files.items() for i, v in enumerate(lines)], "file string, line int, value string")


def test_registry_reader_remembers(spark):
    rng = random.Random(3)
    pool = ["## One", "## Two ", "# Title", "text", "", "| A | B |", "|---|:-:|", "| 1 | 2 |", "| 1 | 2 | 3 |", "| x |", "| A | B | A |", "|:--|", "| 4 | 5 | 6 |", None]
    files = {f"f{i}": [rng.choice(pool) for _ in range(rng.randrange(1, 25))] for i in range(25)}
    lines = registry_lines(spark, files).repartition(5)  # a file's lines come in any order
    got = sorted((r.file, r.line, r.section, tuple(sorted(r.cells.items()))) for r in registries.registry_rows(lines).collect())
    assert got == sorted((f, i, s, tuple(sorted(c.items()))) for f, text in files.items() for i, s, c in plain_rows([x or "" for x in text]))


HEAD = "| Document | Version | Status | Current | Authority | Superseded By | Location |"


def entry(name, version="1.0", status="FROZEN", current="YES", authority="AUTHORITATIVE", by="—", link="released/v1.1/a%20b.md"):
    return f"| {name} | {version} | {status} | {current} | {authority} | {by} | [x]({link}) |"


def test_governance_of_registries(spark):
    files = {
        "a.md": ["## Authoritative artifacts", HEAD, "|---|---|---|---|---|---|---|", entry("CDD-001 One"), entry("CDD-002 Two", status="Draft"), entry("CDD-001 Again", current=""), entry("CDD-003 Three", link="elsewhere.md")],
        "b.md": ["## Historical baseline", HEAD, entry("CDD-001 Old", status="SUPERSEDED", current="NO", authority="NON-AUTHORITATIVE"), entry("CDD-009", status="Superseded", current="NO", authority="NON-AUTHORITATIVE", by="CDD-010"), entry("", status="FROZEN"), entry("free", status="", current="YES")],
    }
    found = registries.entries(registries.registry_rows(registry_lines(spark, files)))
    one = found.filter("name = 'CDD-001 One'").first()
    assert (one.identifier, one.version, one.location, one.replacement) == ("CDD-001", "1.0", "released/v1.1/a b.md", "")
    titled = registries.entries(registries.registry_rows(registry_lines(spark, {"c.md": [HEAD, entry("House Rules (2024)"), entry("House Plan")]})), ["House Rules"])
    assert {(r.name, r.identifier) for r in titled.collect()} == {("House Rules (2024)", "House Rules"), ("House Plan", "House Plan")}
    got = {(r.file, r.line, r.error) for r in registries.governance_errors(found).collect()}
    assert got == {("a.md", 4, "INVALID_COMBINATION"), ("a.md", 5, "MISSING_GOVERNANCE"), ("a.md", None, "SEVERAL_AUTHORITIES"), ("b.md", 2, "NO_REPLACEMENT"), ("b.md", 4, "MISSING_GOVERNANCE")}


def test_dependency_matrix(spark):
    files = {"a.md": ["## Authoritative artifacts (v1)", HEAD, entry("CDD-001"), entry("CDD-002", "2.0"), entry("CDD-003", status="Frozen")]}
    found = registries.entries(registries.registry_rows(registry_lines(spark, files)))
    good = ("CDD-001", "1.0", "CDD-002", "2.0", "FROZEN", "uses", "Compatible", "A")
    change = lambda i, v: good[:i] + (v,) + good[i + 1 :]
    rows = [good, change(5, "  "), change(0, "CDD-9"), change(2, "CDD-9"), change(1, "1.1"), change(3, "1.0"), change(4, "DRAFT"), change(6, "Unknown"), ("CDD-003", "1.0", *good[2:])]
    matrix = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["row", *registries.MATRIX])
    got = {r.row: r.error for r in registries.dependency_errors(matrix, found).collect()}
    assert got == {1: "MISSING_VALUE", 2: "DEPENDENT_NOT_CURRENT", 3: "DEPENDENCY_NOT_CURRENT", 4: "DEPENDENT_VERSION", 5: "DEPENDENCY_VERSION", 6: "NOT_FROZEN", 7: "NOT_COMPATIBLE", 8: "NOT_FROZEN"}


# ---- closed documents

FORM = documents.Object(
    {
        "id": documents.Text(pattern=documents.UUID),
        "names": documents.List(documents.Text(0, 5, blank=False), 1, 3),
        "score": documents.Number(0, 1),
        "at": documents.Instant(),
        "inside": documents.Object({"flag": documents.Flag(), "pair": documents.Tuple((documents.Number(), documents.Text(2)))}, optional=("flag",)),
        "maybe": documents.Maybe(documents.Number()),
    },
    optional=("maybe",),
)


def good():
    return {"id": str(uuid.UUID(int=7)), "names": ["a", "bb"], "score": 0.5, "at": "2024-02-29T10:00:00Z", "inside": {"flag": True, "pair": [1, "xy"]}, "maybe": None}


def checked(spark, bodies):
    df = spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "i int, body string")
    out = {i: [] for i in range(len(bodies))}
    for r in documents.violations(df, "body", FORM, "i").collect():
        out[r.i].append((r.path, r.problem))
    return [sorted(out[i]) for i in range(len(bodies))]


CASES = [
    ({}, []),
    ({"extra": 1, "more": {}}, [("$.extra", "unknown key"), ("$.more", "unknown key")]),
    ({"id": "7"}, [("$.id", "malformed")]),
    ({"id": 7}, [("$.id", "not a string")]),
    ({"names": []}, [("$.names", "too few")]),
    ({"names": ["a", " \t", "toolong", 3]}, [("$.names", "too many"), ("$.names[1]", "blank"), ("$.names[2]", "too long"), ("$.names[3]", "not a string")]),
    ({"names": {"a": 1}}, [("$.names", "not a list")]),
    ({"names": None}, [("$.names", "not a list")]),
    ({"score": 1}, []),
    ({"score": 1.0000001}, [("$.score", "out of bounds")]),
    ({"score": -1}, [("$.score", "out of bounds")]),
    ({"score": "0.5"}, [("$.score", "not a number")]),
    ({"score": True}, [("$.score", "not a number")]),
    ({"at": "2024-02-29T10:00:00+02:00"}, [("$.at", "not in UTC")]),
    ({"at": "2024-02-29T10:00:00.123+00:00"}, []),
    ({"at": "2023-02-29T10:00:00Z"}, [("$.at", "not an instant")]),
    ({"at": "2024-02-29"}, [("$.at", "not an instant")]),
    ({"at": 5}, [("$.at", "not a string")]),
    ({"inside": {"pair": [1, "xy"]}}, []),
    ({"inside": {"flag": "yes", "pair": [1, "x"], "z": 0}}, [("$.inside.flag", "not a boolean"), ("$.inside.pair[1]", "too short"), ("$.inside.z", "unknown key")]),
    ({"inside": {"flag": False}}, [("$.inside.pair", "missing")]),
    ({"inside": {"pair": [1]}}, [("$.inside.pair", "wrong number of elements")]),
    ({"inside": [1]}, [("$.inside", "not an object")]),
    ({"maybe": 3}, []),
    ({"maybe": "3"}, [("$.maybe", "not a number")]),
]


def test_documents_against_a_closed_form(spark):
    bodies = [good() | change for change, _ in CASES]
    assert checked(spark, bodies) == [sorted(found) for _, found in CASES]


def test_documents_that_are_none(spark):
    whole = json.dumps(good())
    lacking = good()
    del lacking["score"], lacking["maybe"]
    nan = whole.replace("0.5", "NaN")
    twice = whole.replace('"score"', '"id"')
    large = whole.replace("0.5", "1e999")
    got = checked(spark, [None, "", "{", "[]", "null", '"text"', nan, twice, lacking, large])
    assert got[:8] == [[], [("$", "not JSON")], [("$", "not JSON")], [("$", "not an object")], [("$", "not an object")], [("$", "not an object")], [("$", "not JSON")], [("$", "not JSON")]]
    assert got[8] == [("$.score", "missing")] and got[9] and got[9][0][0] in ("$", "$.score")


def test_requests_of_the_interface(spark):
    one = str(uuid.UUID(int=1))
    observation = {"observation_id": one, "source_system_reference": one, "source_record_reference": "r", "subject_type": "s", "subject_id": one, "observation_type": "t", "value": "v", "severity": "LOW", "observed_at": "2024-01-01T00:00:00Z", "evidence_reference": "e"}
    eligible = {n: True for n in ("qualified", "approved", "contractually_eligible", "usable_capacity", "operationally_ready")} | {"supplier_entity_id": one}
    body = {"supplier_names": ["A"], "source_object_ids": [one], "enterprise_candidates": [[one, "A"]], "semantic_terms": [], "semantic_candidates": [], "context_id": one, "material_id": one, "facility_or_region_id": one, "effective_at": "2024-01-01T00:00:00Z", "observations": [observation], "supplier_eligibility": [eligible]}
    body |= {n: 0.5 for n in documents.SCORES} | {n: "1" for n in documents.VERSIONS} | {n: "p" for n in documents.NAMES}
    wrong = body | {"observations": [observation, observation | {"severity": "WORST", "schema_version": "2.0"}], "supplier_names": ["x"] * 101, "acceptance_evidence": {"evidence_id": one}}
    df = spark.createDataFrame([(0, json.dumps(body)), (1, json.dumps(wrong))], "i int, body string")
    got = sorted((r.i, r.path, r.problem) for r in documents.violations(df, "body", documents.ASSESSMENT, "i").collect())
    lacking = [f"$.acceptance_evidence.{n}" for n in ("accepted_at", "authority", "policy_reference", "policy_version")]
    assert got == sorted([*((1, p, "missing") for p in lacking), (1, "$.observations[1].schema_version", "malformed"), (1, "$.observations[1].severity", "malformed"), (1, "$.supplier_names", "too many")])


# ---- archives


def opened(spark, path, kind, schema=None):
    spark.dataSource.register(members.Members)
    reader = spark.read.format("zip_members").option("path", str(path)).option("kind", kind)
    return (reader.schema(schema) if schema else reader).load()


def test_members_of_archives(spark, tmp_path):
    for a in range(3):
        with zipfile.ZipFile(tmp_path / f"a{a}.zip", "w") as z:
            for m in range(a + 1):
                z.writestr(f"dir/m{m}.csv", "﻿id,name,note\n" + "".join(f'{i},"x, ""{a}{m}""\ny",\n' for i in range(m * 2)))
            z.writestr("readme.txt", "id\n1\n")
    df = opened(spark, tmp_path, "csv", "member string, name string, archive string, row int, gone string")
    assert df.rdd.getNumPartitions() == 6  # a member each
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted((f"dir/m{m}.csv", f'x, "{a}{m}"\ny', f"a{a}.zip", i, None) for a in range(3) for m in range(a + 1) for i in range(m * 2))
    same = archives.zipped_csv(archives.files(spark, str(tmp_path))).select("member", "row", F.get_json_object("record", "$.name").alias("name"))
    assert sorted(tuple(r) for r in df.select("member", "row", "name").collect()) == sorted(tuple(r) for r in same.collect())


def test_sheets_and_texts_of_archives(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(f'<row r="{i}"><c r="A{i}" t="s"><v>{i % 2}</v></c><c r="C{i}"><v>{i}</v></c></row>' for i in range(1, 30)) + "</sheetData></worksheet>"
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>even</t></si><si><r><t>o</t></r><r><t>dd</t></r></si></sst>'
    text = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", text)
    files = archives.files(spark, str(tmp_path))
    assert sorted(tuple(r) for r in opened(spark, tmp_path, "xlsx").select("row", "cells").collect()) == sorted((r.row, r.cells) for r in archives.xlsx_rows(files.filter("path LIKE '%xlsx'")).collect())
    assert [r.text for r in opened(spark, tmp_path, "docx").orderBy("row").collect()] == [r.text for r in archives.docx_blocks(files.filter("path LIKE '%docx'")).orderBy("place").collect()] == ["One", "a | b", "Two"]


def test_a_member_larger_than_its_reader_may_hold(tmp_path):
    """Half a million rows, some 60 MB, read with a few MB held at a time."""
    import tracemalloc

    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("big.csv", "w", force_zip64=True) as f:
        f.write(b"id,text\n")
        for i in range(500):
            f.write(b"".join(b"%d,%s\n" % (i * 1000 + k, b"word " * 20) for k in range(1000)))
    reader = members.MemberReader(str(tmp_path / "big.zip"), "csv", ["id"])
    (part,) = reader.partitions()
    tracemalloc.start()
    n = sum(1 for _ in reader.read(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 500_000 and peak < 8 << 20


def test_many_archives(spark, tmp_path):
    for i in range(2000):
        with zipfile.ZipFile(tmp_path / f"a{i:04}.zip", "w") as z:
            z.writestr("m.csv", f"id\n{i}\n")
    spark.dataSource.register(members.Members)
    assert len(members.MemberReader(str(tmp_path), "csv", ["id"]).partitions()) == 2000
    assert opened(spark, tmp_path / "a0007.zip", "csv", "id string").first().id == "7"


def test_archives_that_cannot_be_opened(spark, tmp_path):
    with pytest.raises(ValueError, match="mount"):
        members.MemberReader("s3://bucket/x", "csv", [])
    with pytest.raises(Exception, match="kind is one of"):
        opened(spark, tmp_path, "pdf").collect()


# ---- inclusions


def test_inclusions_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    columns = {"t.a": range(50), "t.b": [rng.randrange(50) for _ in range(80)], "u.c": [rng.randrange(60) for _ in range(40)] + [None] * 5, "u.d": [None] * 45, "v.e": range(100, 120), "v.f": [7] * 20}
    frames, exprs = {}, {}
    for name, values in columns.items():
        table, column = name.split(".")
        frames.setdefault(table, {})[column] = list(values)
        exprs.setdefault(table, {})[column] = F.col(column)
    made = {}
    for table, own in frames.items():
        n = max(map(len, own.values()))
        made[table] = spark.createDataFrame([tuple(v[i] if i < len(v) else None for v in own.values()) for i in range(n)], ", ".join(f"{c} int" for c in own))
    sets = {c: {str(x) for x in v if x is not None} for c, v in columns.items()}
    expected = {(a, b, len(sets[a]), len(sets[a] - sets[b])) for a in sets for b in sets if a != b and sets[a] & sets[b]}
    assert {tuple(r) for r in validation.inclusions(exprs, made).collect()} == expected


def test_checks_of_documents_grow_with_rows_and_not_with_the_form(spark):
    """A form's plan has a pass a level, and values are taken from a document once, however many fields a form has."""
    df = spark.createDataFrame([(1, '{"a": 1}')], "i int, body string")
    wide = documents.violations(df, "body", documents.ASSESSMENT, "i")
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 4 and plan.count("map<string,variant>") <= 16
    assert {r.problem for r in wide.collect()} == {"missing", "unknown key"}
