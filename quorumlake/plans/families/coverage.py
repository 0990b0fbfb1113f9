"""CVG and QLY: conformance, coverage and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import questions
from quorumlake.operators import coverage, graph, validation
from quorumlake.plans.registry import register
from quorumlake.plans.tables import read
from quorumlake.sources import text_formats

REQUIREMENTS = "SELECT n_nationkey AS requirement_id, n_regionkey AS contract, CASE n_nationkey % 3 WHEN 0 THEN 'CONCEPT' WHEN 1 THEN 'RELATIONSHIP' ELSE 'INFORMATION_ELEMENT' END AS kind, CASE WHEN n_nationkey % 4 = 0 THEN 'OPTIONAL' ELSE 'REQUIRED' END AS obligation FROM nation"
STATUSES = f"SELECT r.*, CASE WHEN kind = 'INFORMATION_ELEMENT' THEN 'NOT_EVALUATED' WHEN requirement_id IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) THEN 'SATISFIED' ELSE 'MISSING' END AS status FROM ({REQUIREMENTS}) r"


def _statuses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    wanted = n.select(k.alias("requirement_id"), F.when(k % 3 == 0, "CONCEPT").when(k % 3 == 1, "RELATIONSHIP").otherwise("INFORMATION_ELEMENT").alias("kind"), F.when(k % 4 == 0, "OPTIONAL").otherwise("REQUIRED").alias("obligation"))
    there = read(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("requirement_id"))
    return coverage.conformance(wanted, there), n.select(k.alias("requirement_id"), F.col("n_regionkey").alias("contract"))


@register("cvg_01_conformance", f"SELECT requirement_id, kind, obligation, status FROM ({STATUSES})")
def cvg_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir)[0]


@register("agg_09_conformant_contracts", f"SELECT contract, coalesce(bool_and(CASE WHEN obligation = 'REQUIRED' AND status <> 'NOT_EVALUATED' THEN status = 'SATISFIED' END), true) AS conformant FROM ({STATUSES}) GROUP BY 1")
def agg_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses, contracts = _statuses(spark, sf_dir)
    return coverage.is_conformant(statuses.join(contracts, "requirement_id"), "contract")


# documents are elements, labels their mappings, conversations the evidence seen for a field
MAPPED = "SELECT doc_id AS element_id, CASE WHEN n IS NULL THEN 'UNMAPPED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'MAPPED' END AS coverage, CASE WHEN n = 1 THEN f END AS source_field_id FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, min(doc_id % 97) AS f FROM (SELECT doc_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id FROM labels WHERE quality = 1 AND doc_id % 13 = 0) GROUP BY 1) USING (doc_id)"
SEEN = "SELECT f AS source_field_id, CASE WHEN n IS NULL THEN 'NO_EVIDENCE' WHEN e THEN 'EVIDENCE_EMPTY' ELSE 'EVIDENCE_PRESENT' END AS availability, coalesce(n, 0) AS n_evidence FROM (SELECT unnest(range(0, 97)) AS f) LEFT JOIN (SELECT conv_id % 97 AS f, count(*) AS n, bool_and(CASE WHEN conv_id % 3 = 0 THEN '' ELSE text END = '') AS e FROM conversations WHERE conv_id % 5 <> 0 GROUP BY 1) USING (f)"


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    approved = read(spark, sf_dir, "labels").withColumn("governance_status", F.when(F.col("quality") == 1, "Approved").otherwise("Proposed"))
    mappings = approved.unionByName(approved.filter("doc_id % 13 = 0")).select(F.col("doc_id").alias("element_id"), (F.col("doc_id") % 97).alias("source_field_id"), "governance_status")
    return coverage.mapping_coverage(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("element_id")), mappings)


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.col("text"))
    evidence = read(spark, sf_dir, "conversations").filter("conv_id % 5 <> 0").select((F.col("conv_id") % 97).alias("source_field_id"), text.alias("representation"))
    return coverage.evidence_availability(spark.range(97).withColumnRenamed("id", "source_field_id"), evidence)


@register("cvg_02_mapping_coverage", MAPPED)
def cvg_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir)


@register("cvg_03_evidence_availability", SEEN)
def cvg_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir)


IDS = """
    WITH e AS (SELECT event_id % 997 AS f, CASE WHEN event_id % 997 = 5 THEN event_id % 7 ELSE event_id END AS id, CASE WHEN event_id % 997 % 10 = 3 THEN '' ELSE event_type END AS observed FROM events WHERE event_id % 997 % 11 <> 0),
    g AS (SELECT f, bool_and(observed = '') AS empty, list_sort(list(DISTINCT id::VARCHAR)) AS ids, count(*) AS n FROM e GROUP BY 1)
    SELECT r AS source_field_id, CASE WHEN n > len(ids) THEN NULL WHEN n IS NULL THEN 'NO_EVIDENCE' WHEN empty THEN 'EVIDENCE_EMPTY' ELSE 'EVIDENCE_PRESENT' END AS availability,
        CASE WHEN n > len(ids) THEN NULL ELSE coalesce(array_to_string(ids, ','), '') END AS evidence_ids, CASE WHEN n > len(ids) THEN 'DUPLICATE_EVIDENCE_ID' END AS error
    FROM range(997) t(r) LEFT JOIN g ON f = r"""


@register("cvg_03_evidence_ids", IDS)
def cvg_03_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are evidence of fields; one field's ids repeat, some fields have none, some only empty values."""
    field = F.col("event_id") % 997
    evidence = read(spark, sf_dir, "events").filter(field % 11 != 0).select(
        field.alias("source_field_id"), F.when(field == 5, F.col("event_id") % 7).otherwise(F.col("event_id")).alias("evidence_id"), F.when(field % 10 == 3, "").otherwise(F.col("event_type")).alias("observed")
    )
    found = coverage.evidence_ids(spark.range(997).withColumnRenamed("id", "source_field_id"), evidence)
    return found.withColumn("evidence_ids", F.array_join("evidence_ids", ","))


CONTEXT = f"SELECT element_id, source_field_id, coverage, availability, CASE WHEN element_id IS NULL THEN 'ORPHAN_EVIDENCE' WHEN coverage = 'MAPPED' AND availability IS NULL THEN 'MISSING_EVIDENCE' WHEN coverage <> 'MAPPED' AND availability IS NOT NULL THEN 'UNEXPECTED_EVIDENCE' END AS problem FROM ({MAPPED}) FULL JOIN (SELECT * FROM ({SEEN}) WHERE source_field_id % 11 <> 0) USING (source_field_id)"


@register("cvg_04_context", CONTEXT)
def cvg_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.context(_mapped(spark, sf_dir), _seen(spark, sf_dir).filter("source_field_id % 11 <> 0").drop("n_evidence"))


RELATION_VALUES = ", ".join(f"('{r}', '{a}', '{b}')" for r, a, b in graph.RELATIONS)
CONCEPT_LIST = "[" + ", ".join(f"'{c}'" for c in graph.CONCEPTS) + "]"


@register("cvg_05_gaps", f"WITH r AS (SELECT * FROM (VALUES {RELATION_VALUES}) v(relation, source, target)) SELECT element_id, {CONCEPT_LIST}[element_id % 10 + 1] AS concept, (SELECT count(*) FROM r WHERE source = {CONCEPT_LIST}[element_id % 10 + 1]) AS n_out, (SELECT count(*) FROM r WHERE target = {CONCEPT_LIST}[element_id % 10 + 1]) AS n_in, CASE coverage WHEN 'UNMAPPED' THEN 'APPROVE_MAPPING' ELSE 'RESOLVE_AMBIGUITY' END AS remedy FROM ({MAPPED}) WHERE coverage <> 'MAPPED'")
def cvg_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    concept = F.get(F.array(*[F.lit(c) for c in graph.CONCEPTS]), (F.col("doc_id") % 10).cast("int"))
    elements = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("element_id"), concept.alias("concept"))
    return coverage.gaps(_mapped(spark, sf_dir), elements, spark.createDataFrame(list(graph.RELATIONS), "relation string, source string, target string"))


# one ontology per region: its nations' numbers say which concepts and relations are there, defined and approved
ONTOLOGIES = f"""
    WITH n AS (SELECT n_regionkey AS g, n_nationkey AS k FROM nation), want AS (SELECT * FROM (VALUES {RELATION_VALUES}) v(relation, source, target)),
    names AS (SELECT i, {CONCEPT_LIST}[i + 1] AS concept FROM range(10) t(i)),
    c AS (SELECT g, concept, bool_or(k % 2 = 0) AS defined, bool_or(k % 3 = 0) AS approved FROM n JOIN names ON i = k % 10 OR i = k % 7 GROUP BY 1, 2),
    r AS (SELECT g, relation, source, target, bool_or(k % 2 = 1) AS approved FROM n JOIN (SELECT *, row_number() OVER (ORDER BY relation, source, target) - 1 AS i FROM want) w ON i = k % 8 GROUP BY 1, 2, 3, 4)"""
BY_REGION = f"""{ONTOLOGIES},
    a AS (SELECT g, count(*) AS c_n, count(*) FILTER (WHERE defined) AS c_def, count(*) FILTER (WHERE approved) AS c_ok FROM c GROUP BY 1),
    b AS (SELECT g, count(*) AS r_n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM c x WHERE x.g = r.g AND x.concept = r.source) AND EXISTS (SELECT 1 FROM c x WHERE x.g = r.g AND x.concept = r.target)) AS r_map, count(*) FILTER (WHERE approved) AS r_ok FROM r GROUP BY 1),
    t AS (SELECT (SELECT count(*) FROM want) AS nr)
    SELECT a.g AS ontology, d.dimension, d.score, d.score = 1.0 AS passed FROM (SELECT a.g, unnest([{{'dimension': 'concept_coverage', 'score': c_n / 10}}, {{'dimension': 'relationship_coverage', 'score': r_n / nr}}, {{'dimension': 'definition_completeness', 'score': c_def / 10}}, {{'dimension': 'mapping_completeness', 'score': r_map / nr}},
        {{'dimension': 'provenance_completeness', 'score': (c_n + r_n) / (10 + nr)}}, {{'dimension': 'valid_relationship_endpoints', 'score': r_n / nr}}, {{'dimension': 'governance_status_completeness', 'score': (c_ok + r_ok) / (10 + nr)}}]) AS d FROM a JOIN b USING (g), t) a"""


def _ontologies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("ontology"), F.col("n_nationkey").alias("k"))
    at = lambda numbers, rows: F.get(F.array(*rows), numbers)
    names = [F.lit(c) for c in graph.CONCEPTS]
    relations = [F.struct(F.lit(r).alias("relation"), F.lit(a).alias("source"), F.lit(b).alias("target")) for r, a, b in sorted(graph.RELATIONS)]
    both = F.array(F.col("k") % 10, F.col("k") % 7)
    c = n.select("ontology", "k", F.explode(F.transform(both, lambda i: at(i.cast("int"), names))).alias("concept")).groupBy("ontology", "concept")
    status = lambda found: F.when(found, "Approved").otherwise("Proposed").alias("status")
    concepts = c.agg(F.when(F.bool_or(F.col("k") % 2 == 0), "defined").otherwise("").alias("definition"), status(F.bool_or(F.col("k") % 3 == 0)))
    r = n.select("ontology", "k", F.explode(F.array(at((F.col("k") % 8).cast("int"), relations))).alias("r")).filter("r IS NOT NULL").select("ontology", "k", "r.*")
    return concepts, r.groupBy("ontology", "relation", "source", "target").agg(status(F.bool_or(F.col("k") % 2 == 1)))


@register("cvg_06_quality_of_ontologies", BY_REGION)
def cvg_06_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.ontologies_quality(*_ontologies(spark, sf_dir))


@register("agg_10_quality_of_ontologies", f"SELECT ontology, round_even(avg(score), 4) AS overall, coalesce(string_agg(dimension, ',' ORDER BY dimension) FILTER (WHERE NOT passed), '') AS failed FROM ({BY_REGION}) GROUP BY 1")
def agg_10_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.overall(coverage.ontologies_quality(*_ontologies(spark, sf_dir)), "ontology")


RESOLVED = f"""{ONTOLOGIES}, ends AS (SELECT g, relation, source, target FROM r WHERE EXISTS (SELECT 1 FROM c x WHERE x.g = r.g AND x.concept = r.source) AND EXISTS (SELECT 1 FROM c x WHERE x.g = r.g AND x.concept = r.target)),
    resolved AS (SELECT e.*, (SELECT 10 + count(*) FROM want) - (SELECT count(*) FROM c WHERE c.g = e.g) - (SELECT count(*) FROM ends x WHERE x.g = e.g) AS n_lacking FROM ends e),
    path AS (SELECT g, list_position(['supplies', 'usedIn', 'defines', 'generatesRevenue'], relation)::INT - 1 AS place, relation, source, target FROM resolved WHERE relation IN ('supplies', 'usedIn', 'defines', 'generatesRevenue'))"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, relations = _ontologies(spark, sf_dir)
    return graph.resolve_ontologies(concepts.select("ontology", "concept"), relations.select("ontology", "relation", "source", "target"))


@register("grf_06_resolved_ontologies", f"{RESOLVED} SELECT g AS ontology, relation, source, target, CASE WHEN n_lacking = 0 THEN 'Published' ELSE 'Draft' END AS status, n_lacking FROM resolved")
def grf_06_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


@register("grf_05_semantic_paths", f"{RESOLVED} SELECT g AS ontology, place, relation, source, target FROM path")
def grf_05_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.semantic_path(_resolved(spark, sf_dir), graph.PATH_STEPS, "ontology")


@register("cvg_07_activation", f"""{RESOLVED} SELECT g AS ontology, CASE WHEN n_lacking = 0 THEN 'Published' ELSE 'Draft' END AS status, count(*) AS n_steps,
    first(p.source ORDER BY place) || string_agg(' → ' || p.relation || ' → ' || p.target, '' ORDER BY place) AS path FROM path p JOIN (SELECT DISTINCT g, n_lacking FROM resolved) USING (g) GROUP BY g, n_lacking""")
def cvg_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each ontology would be activated with: its status and its main path, as far as it has one."""
    resolved = _resolved(spark, sf_dir)
    steps = F.array_sort(F.collect_list(F.struct("place", "relation", "source", "target")))
    path = graph.semantic_path(resolved, graph.PATH_STEPS, "ontology").groupBy("ontology").agg(steps.alias("steps"), F.count(F.lit(1)).alias("n_steps"))
    return path.join(resolved.select("ontology", "status").distinct(), "ontology").select("ontology", "status", "n_steps", questions.path_text(F.col("steps")).alias("path"))


@register("grf_08_grid", "SELECT s_suppkey, (s_suppkey % 4) * 220 AS x, (s_suppkey // 4) * 110 AS y FROM supplier")
def grf_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = graph.grid(F.col("s_suppkey"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", x.alias("x"), y.alias("y"))


@register("cvg_09_ask_context", "SELECT element_id, 'Legal Name ' || element_id || ': ' || coverage || '/' || coalesce(availability, 'none') AS short, CASE WHEN coverage = 'MAPPED' THEN 'The catalogue has an Approved semantic mapping for this requirement.' ELSE 'The catalogue does not currently have an Approved semantic mapping for this requirement.' END AS first_sentence FROM (SELECT m.element_id, m.coverage, s.availability FROM (" + MAPPED + ") m LEFT JOIN (" + SEEN + ") s USING (source_field_id))")
def cvg_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _mapped(spark, sf_dir).join(_seen(spark, sf_dir), "source_field_id", "left")
    answer = questions.context_answer(F.lit("Legal Name"), F.lit("Supplier"), F.col("coverage"), F.col("availability"))
    sentence = F.regexp_extract(answer, r"Blueprint: ([^.]*\.)", 1)
    short = F.concat(F.lit("Legal Name "), F.col("element_id").cast("string"), F.lit(": "), F.col("coverage"), F.lit("/"), F.coalesce("availability", F.lit("none")))
    return j.select("element_id", short.alias("short"), sentence.alias("first_sentence"))


@register("qly_01_dataset_issues", "SELECT 'part' AS file, p_partkey AS row_index, 'p_name' AS field, 'DUPLICATE_KEY' AS problem FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part) WHERE r > 1 UNION ALL SELECT 'orders', o_orderkey, 'customer', 'BROKEN_REFERENCE' FROM orders WHERE o_orderkey % 40 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)")
def qly_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").withColumn("customer", F.when(F.col("o_orderkey") % 40 == 0, F.lit("")).otherwise(F.col("o_custkey").cast("string")))
    found = [
        validation.repeated_keys(read(spark, sf_dir, "part"), "part", "p_name", "p_partkey"),
        validation.broken_references(orders, "orders", "customer", "o_orderkey", read(spark, sf_dir, "customer"), "c_custkey"),
    ]
    return validation.issues(found)


#: Columns that look like keys, and what their values are called.
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey", "n_regionkey"), "customer": ("c_custkey", "c_nationkey"), "supplier": ("s_suppkey", "s_nationkey"), "part": ("p_partkey",),
    "orders": ("o_orderkey", "o_custkey"), "lineitem": ("l_orderkey", "l_partkey", "l_suppkey"), "events": ("event_id", "user_id"), "documents": ("doc_id",), "embeddings": ("vec_id",),
    "pages": ("page_id",), "benchmark": ("item_id",), "labels": ("doc_id",), "conversations": ("conv_id",),
}
INCLUSIONS_SQL = "WITH v AS (" + " UNION ".join(f"SELECT '{t}.{c}' AS c, {c}::VARCHAR AS v FROM {t} WHERE {c} IS NOT NULL" for t, cs in KEYS.items() for c in cs) + """), n AS (SELECT c, count(*) AS n FROM v GROUP BY 1)
    SELECT x.c AS a, y.c AS b, n AS n_values, n - count(*) AS n_broken FROM v x JOIN v y ON x.v = y.v AND x.c <> y.c JOIN n ON n.c = x.c GROUP BY x.c, y.c, n"""


@register("qly_02_inclusions", INCLUSIONS_SQL)
def qly_02_inclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which key-like columns of all tables may refer to which, found in their values."""
    return validation.inclusions({t: {c: F.col(c) for c in cs} for t, cs in KEYS.items()}, {t: read(spark, sf_dir, t) for t in KEYS})


@register("qly_05_manifest_digests", "SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN 'CHANGED' ELSE 'SAME' END AS state FROM documents")
def qly_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    listed = d.select("doc_id", F.sha2(F.col("text"), 256).alias("listed"))
    found = d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 29 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("found"))
    return listed.join(found, "doc_id").select("doc_id", F.when(F.col("listed") == F.col("found"), "SAME").otherwise("CHANGED").alias("state"))


# a dataset of seven files from the driver's tables, with some keys repeated and some references broken
FILES = {
    "suppliers.csv": ("supplier", "s_suppkey AS row_index, CAST(CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey - 1 ELSE s_suppkey END AS STRING) AS supplier_id, s_name AS supplier_name, CASE WHEN s_nationkey % 5 <> 0 THEN CAST(s_nationkey AS STRING) END AS region_id", "TRUE"),
    "materials.csv": ("part", "p_partkey AS row_index, CAST(CASE WHEN p_partkey % 50 = 0 THEN p_partkey - 1 ELSE p_partkey END AS STRING) AS material_id, CASE WHEN p_size <> 7 THEN CAST(p_size AS STRING) END AS supplier_id", "TRUE"),
    "products.csv": ("orders", "o_orderkey AS row_index, CAST(o_orderkey AS STRING) AS product_id, CAST(o_custkey AS STRING) AS material_id, CAST(o_custkey AS STRING) AS facility_id", "TRUE"),
    "facilities.csv": ("customer", "c_custkey AS row_index, CAST(CASE WHEN c_custkey % 25 = 0 THEN c_custkey - 1 ELSE c_custkey END AS STRING) AS facility_id", "TRUE"),
    "supply_agreements.csv": ("lineitem", "l_orderkey * 10 + l_linenumber AS row_index, CAST(l_orderkey AS STRING) AS agreement_id, CAST(l_partkey AS STRING) AS material_id, CAST(l_suppkey AS STRING) AS supplier_id", "TRUE"),
    "risk_events.csv": ("events", "event_id AS row_index, CAST(CASE WHEN event_id % 7 = 0 THEN event_id - 1 ELSE event_id END AS STRING) AS risk_event_id, event_type AS region_id", "TRUE"),
    "revenue_exposure.csv": ("lineitem", "l_orderkey * 10 + l_linenumber AS row_index, CAST(CASE WHEN l_orderkey % 9 = 0 THEN -l_orderkey ELSE l_orderkey END AS STRING) AS product_id", "l_linenumber = 2"),
}


def _files(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {file: read(spark, sf_dir, table).filter(condition).selectExpr(*_columns(columns)) for file, (table, columns, condition) in FILES.items()}


def _columns(listed: str) -> list[str]:
    return listed.split(", ")


def _file_sql(file: str) -> str:
    table, columns, condition = FILES[file]
    return f"(SELECT {columns} FROM {table} WHERE {condition})"


def _issues_sql() -> str:
    keys = dict(validation.KEYS)
    parts = [
        f"""SELECT '{file}' AS file, r.row_index, '{field}' AS field, 'Duplicate {field} "' || coalesce(r.{field}, '') || '" — first seen at row ' || (f.first + 1) || '.' AS message
        FROM {_file_sql(file)} r JOIN (SELECT coalesce({field}, '') AS v, min(row_index) AS first FROM {_file_sql(file)} GROUP BY 1) f ON coalesce(r.{field}, '') = f.v AND r.row_index > f.first"""
        for file, field in validation.KEYS
    ] + [
        f"""SELECT '{file}', row_index, '{field}', '{field} "' || coalesce({field}, '') || '" does not match any record in {target}.' FROM {_file_sql(file)}
        WHERE coalesce({field}, '') NOT IN (SELECT coalesce({keys[target]}, '') FROM {_file_sql(target)})"""
        for file, field, target in validation.REFERENCES
    ]
    return " UNION ALL ".join(parts)


@register("qly_01_whole_dataset", _issues_sql())
def qly_01_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.dataset_issues(_files(spark, sf_dir))


@register("qly_03_mapped_fields", " UNION ALL ".join(f"SELECT '{f}' AS file, '{c}' AS field, '{t}' AS inferred_type, '{k}' AS concept, '{r}' AS role, {p}::DOUBLE AS confidence, count(*) FILTER (WHERE coalesce({c}, '') <> '') AS n_values FROM {_file_sql(f)}" for f, c, t, k, r, p in validation.MAPPINGS))
def qly_03_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.mapped_fields(_files(spark, sf_dir))


@register("qly_05_manifest_differences", """
    SELECT 'docs/' || doc_id AS path, CASE WHEN doc_id % 31 = 0 THEN 'UNREGISTERED' WHEN doc_id % 41 = 0 THEN 'DUPLICATE_ENTRY' WHEN doc_id % 37 = 0 THEN 'INVALID_DIGEST' ELSE 'CHECKSUM_MISMATCH' END AS problem FROM documents WHERE doc_id % 31 = 0 OR doc_id % 41 = 0 OR doc_id % 37 = 0 OR doc_id % 29 = 0
    UNION ALL SELECT 'gone/' || doc_id, 'MISSING' FROM documents WHERE doc_id % 43 = 0""")
def qly_05_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest that leaves documents out, lists some twice, some that are gone, and some with a digest that is wrong or no digest."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    k = F.col("doc_id")
    digest = F.when(k % 37 == 0, "none").when(k % 29 == 0, F.sha2("path", 256)).otherwise(F.col("sha256"))
    listed = d.filter(k % 31 != 0).select("path", digest.alias("sha256"), F.explode(F.array_repeat(F.lit(1), F.when(k % 41 == 0, 2).otherwise(1)))).drop("col")
    gone = d.filter(k % 43 == 0).select(F.concat(F.lit("gone/"), k.cast("string")).alias("path"), "sha256")
    return validation.manifest_differences(listed.unionByName(gone), d)


@register("qly_04_header_differences", """
    SELECT 'supplier-' || s_suppkey || '.csv' AS file, x.column_name, x.difference FROM (SELECT s_suppkey, unnest([{'column_name': 's_phone', 'difference': CASE WHEN s_suppkey % 2 = 0 THEN 'MISSING' END}, {'column_name': 's_acctbal', 'difference': CASE WHEN s_suppkey % 3 = 0 THEN 'UNEXPECTED' END},
        {'column_name': 's_name', 'difference': CASE WHEN s_suppkey % 5 = 0 THEN 'MISSING' END}]) AS x FROM supplier) WHERE x.difference IS NOT NULL""")
def qly_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per supplier, whose headers lack columns or have others."""
    k = F.col("s_suppkey")
    parts = F.array(F.lit("s_suppkey"), F.when(k % 5 != 0, F.lit(" s_name")), F.when(k % 2 != 0, F.lit("s_phone")), F.when(k % 3 == 0, F.lit("s_acctbal")))
    files = read(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier-"), k.cast("string"), F.lit(".csv")).alias("file"), F.array_join(F.array_compact(parts), ",").alias("header"))
    return validation.header_differences(files, ["s_suppkey", "s_name", "s_phone"])


# a schema per nation, a table per supplier of it, declared by scripts
TABLES_SQL = """t AS (SELECT s_nationkey AS g, 't' || s_suppkey AS table_name, s_suppkey AS k, unnest(CASE WHEN s_suppkey % 4 = 0 THEN ['id', 'name'] ELSE ['id', 'name', 'score'] END) AS column_name FROM supplier)"""


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    score = F.when(k % 4 != 0, ",\n score NUMERIC(5, 2)").otherwise("")
    script = F.concat(F.when(k % 2 == 0, "CREATE TABLE t").otherwise("create table if not exists t"), k.cast("string"), F.lit(" (\n id UUID NOT NULL,\n name VARCHAR("), (k % 100 + 1).cast("string"), F.lit(")"), score, F.lit(",\n PRIMARY KEY (id)\n);"))
    scripts = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("schema_id")).agg(F.array_join(F.array_sort(F.collect_list(script)), "\n").alias("value"))
    return text_formats.ddl_columns(scripts)


@register("src_11_ddl_columns", f"WITH {TABLES_SQL} SELECT g AS schema_id, table_name, column_name, CASE column_name WHEN 'id' THEN 'UUID' WHEN 'name' THEN 'VARCHAR' ELSE 'NUMERIC' END AS kind FROM t")
def src_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that scripts declare, a script per nation with a table for each of its suppliers."""
    return _declared(spark, sf_dir)


@register("qly_06_traceability", f"WITH {TABLES_SQL} SELECT table_name, column_name, CASE WHEN column_name = 'name' AND k % 3 = 0 OR column_name = 'id' AND k % 7 <> 0 THEN 'A' ELSE 'B' END AS category FROM t")
def qly_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared columns against a dictionary with entries for some of them, some twice, and for columns that nothing declares."""
    k = F.col("s_suppkey")
    entries = F.array(F.when(k % 3 == 0, "name"), F.when(k % 7 != 0, "id"), F.when(k % 7 != 0, "id"), F.lit("gone"))
    dictionary = read(spark, sf_dir, "supplier").select(F.concat(F.lit("t"), k.cast("string")).alias("table_name"), F.explode(F.array_compact(entries)).alias("column_name"))
    return validation.traceability(_declared(spark, sf_dir), dictionary).select("table_name", "column_name", "category")


@register("qly_07_schema_checks", f"""WITH {TABLES_SQL}, n AS (SELECT g, count(DISTINCT table_name) AS tables, count(*) FILTER (WHERE column_name = 'score') AS scores FROM t GROUP BY 1)
    SELECT n_nationkey AS schema_id, x.check, x.ok FROM (SELECT n_nationkey, unnest([{{'check': 'table_count', 'ok': coalesce(tables, 0) = 4}}, {{'check': 'required_columns', 'ok': tables IS NOT NULL AND scores = tables}}]) AS x FROM nation LEFT JOIN n ON g = n_nationkey)""")
def qly_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's schema: whether it has four tables, and whether all of its tables have the columns that are required."""
    schemas = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("schema_id"), F.lit(4).alias("n_tables"))
    return validation.schema_checks(_declared(spark, sf_dir), schemas, "schema_id", ["id", "name", "score"])
