"""Conformance, coverage, evidence availability and gaps against requirement contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.operators import graph


def conformance(requirements: DataFrame, present: DataFrame, key: str = "requirement_id") -> DataFrame:
    """requirement, obligation, status: SATISFIED, MISSING, or NOT_EVALUATED for information elements (CVG-01).

    ``requirements`` has key, kind and obligation.
    """
    marked = requirements.join(present.select(key).distinct().withColumn("_there", F.lit(True)), key, "left")
    status = F.when(F.col("kind") == "INFORMATION_ELEMENT", "NOT_EVALUATED").when(F.col("_there"), "SATISFIED").otherwise("MISSING")
    return marked.select(key, "kind", "obligation", status.alias("status"))


def is_conformant(statuses: DataFrame, by: str) -> DataFrame:
    """Whether all evaluated REQUIRED requirements of each contract are satisfied (AGG-09)."""
    counted = (F.col("obligation") == "REQUIRED") & (F.col("status") != "NOT_EVALUATED")
    return statuses.groupBy(by).agg(F.coalesce(F.bool_and(F.when(counted, F.col("status") == "SATISFIED")), F.lit(True)).alias("conformant"))


def mapping_coverage(elements: DataFrame, mappings: DataFrame, element: str = "element_id") -> DataFrame:
    """element, status MAPPED, UNMAPPED or AMBIGUOUS, and the field where it is mapped once (CVG-02)."""
    approved = mappings.filter("governance_status = 'Approved'").groupBy(element).agg(F.count(F.lit(1)).alias("n"), F.min("source_field_id").alias("source_field_id"))
    j = elements.join(approved, element, "left")
    status = F.when(F.col("n").isNull(), "UNMAPPED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("MAPPED")
    return j.select(element, status.alias("coverage"), F.when(F.col("n") == 1, F.col("source_field_id")).alias("source_field_id"))


def evidence_availability(fields: DataFrame, evidence: DataFrame, field: str = "source_field_id") -> DataFrame:
    """field, availability NO_EVIDENCE, EVIDENCE_EMPTY or EVIDENCE_PRESENT, and how many observations; white space is present (CVG-03)."""
    seen = evidence.groupBy(field).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("representation") == "").alias("empty"))
    j = fields.join(seen, field, "left")
    state = F.when(F.col("n").isNull(), "NO_EVIDENCE").when(F.col("empty"), "EVIDENCE_EMPTY").otherwise("EVIDENCE_PRESENT")
    return j.select(field, state.alias("availability"), F.coalesce("n", F.lit(0).cast("long")).alias("n_evidence"))


def evidence_ids(fields: DataFrame, evidence: DataFrame, field: str = "source_field_id") -> DataFrame:
    """field, availability, evidence_ids in order of their spelling, error where an id repeats for a field (CVG-03).

    ``evidence`` has field, evidence_id and observed; a field of which an id repeats has no availability, and no ids.
    """
    found = evidence.groupBy(field).agg(
        F.bool_and(F.col("observed") == "").alias("_empty"),
        F.array_sort(F.collect_set(F.col("evidence_id").cast("string"))).alias("_ids"),
        F.count("evidence_id").alias("_n"),
    )
    j = fields.join(found, field, "left")
    error = F.when(F.size("_ids") < F.col("_n"), "DUPLICATE_EVIDENCE_ID")
    state = F.when(F.col("_n").isNull(), "NO_EVIDENCE").when(F.col("_empty"), "EVIDENCE_EMPTY").otherwise("EVIDENCE_PRESENT")
    ids = F.coalesce("_ids", F.array().cast("array<string>"))
    return j.select(field, F.when(error.isNull(), state).alias("availability"), F.when(error.isNull(), ids).alias("evidence_ids"), error.alias("error"))


def context(coverage: DataFrame, availability: DataFrame, element: str = "element_id") -> DataFrame:
    """Coverage with evidence, and what is inconsistent between them (CVG-04)."""
    j = coverage.join(availability, "source_field_id", "full")
    problem = (
        F.when(F.col(element).isNull(), "ORPHAN_EVIDENCE")
        .when((F.col("coverage") == "MAPPED") & F.col("availability").isNull(), "MISSING_EVIDENCE")
        .when((F.col("coverage") != "MAPPED") & F.col("availability").isNotNull(), "UNEXPECTED_EVIDENCE")
    )
    return j.select(element, "source_field_id", "coverage", "availability", problem.alias("problem"))


def gaps(statuses: DataFrame, elements: DataFrame, relations: DataFrame) -> DataFrame:
    """Elements that are not mapped, with their concept, its relations in both directions, and the remedy (CVG-05)."""
    lacking = statuses.filter("coverage <> 'MAPPED'").join(elements, "element_id")
    out = relations.groupBy(F.col("source").alias("concept")).agg(F.count(F.lit(1)).alias("n_out"))
    back = relations.groupBy(F.col("target").alias("concept")).agg(F.count(F.lit(1)).alias("n_in"))
    j = lacking.join(out, "concept", "left").join(back, "concept", "left")
    remedy = F.when(F.col("coverage") == "UNMAPPED", "APPROVE_MAPPING").otherwise("RESOLVE_AMBIGUITY")
    return j.select("element_id", "concept", F.coalesce("n_out", F.lit(0).cast("long")).alias("n_out"), F.coalesce("n_in", F.lit(0).cast("long")).alias("n_in"), remedy.alias("remedy"))


def ontologies_quality(concepts: DataFrame, relations: DataFrame, by: str = "ontology") -> DataFrame:
    """by, dimension, score, passed: seven ratios of each ontology against the required one (CVG-06, AGG-10).

    ``concepts`` has by, concept, definition, status; ``relations`` has by, relation, source, target, status. An ontology
    without any of the required concepts has no row.
    """
    spark = concepts.sparkSession
    wanted_names = spark.createDataFrame([(x,) for x in graph.CONCEPTS], "concept string")
    wanted = spark.createDataFrame(list(graph.RELATIONS), "relation string, source string, target string")
    c = concepts.join(F.broadcast(wanted_names), "concept")  # ten names
    names = concepts.select(by, "concept").distinct()
    r = relations.join(F.broadcast(wanted), ["relation", "source", "target"])  # the required relations
    side = lambda end: names.select(by, F.col("concept").alias(end), F.lit(True).alias(f"_{end}"))
    ends = r.join(side("source"), [by, "source"], "left").join(side("target"), [by, "target"], "left")
    a = c.groupBy(by).agg(
        F.count(F.lit(1)).alias("c_n"),
        F.count_if(F.trim("definition") != "").alias("c_def"),
        F.count_if(F.coalesce("status", F.lit("")) != "").alias("c_prov"),
        F.count_if(F.col("status") == "Approved").alias("c_ok"),
    )
    b = ends.groupBy(by).agg(
        F.count(F.lit(1)).alias("r_n"),
        F.count_if(F.col("_source") & F.col("_target")).alias("r_map"),
        F.count_if(F.coalesce("status", F.lit("")) != "").alias("r_prov"),
        F.count_if(F.col("status") == "Approved").alias("r_ok"),
    )
    both = a.join(b, by, "left").na.fill(0, ["r_n", "r_map", "r_prov", "r_ok"])
    return both.select(by, _ratios()).withColumn("passed", F.col("score") == 1.0)


def _ratios() -> Column:
    """dimension, score from counts of concepts (c_) and relations (r_)."""
    nc, nr, c = len(graph.CONCEPTS), len(graph.RELATIONS), F.col
    ratio = lambda name, x: F.struct(F.lit(name).alias("dimension"), x.alias("score"))
    return F.inline(
        F.array(
            ratio("concept_coverage", c("c_n") / nc),
            ratio("relationship_coverage", c("r_n") / nr),
            ratio("definition_completeness", c("c_def") / nc),
            ratio("mapping_completeness", c("r_map") / nr),
            ratio("provenance_completeness", (c("c_prov") + c("r_prov")) / (nc + nr)),
            ratio("valid_relationship_endpoints", c("r_n") / nr),
            ratio("governance_status_completeness", (c("c_ok") + c("r_ok")) / (nc + nr)),
        )
    )


def ontology_quality(concepts: DataFrame, relations: DataFrame) -> DataFrame:
    """dimension, score, passed of one ontology: ``concepts`` has concept, definition, status; ``relations`` relation, source, target, status."""
    one = F.lit(1)
    return ontologies_quality(concepts.withColumn("ontology", one), relations.withColumn("ontology", one)).drop("ontology")


def overall(dimensions: DataFrame, *by: str) -> DataFrame:
    """Mean of the dimensions, rounded half to even, and the names of those that fail (SCL-24, AGG-12), for each ``by``."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("dimension"))))
    return dimensions.groupBy(*by).agg(F.bround(F.avg("score"), 4).alias("overall"), F.array_join(failed, ",").alias("failed"))
