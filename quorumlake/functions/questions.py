"""Question templates, their answers and path texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two question templates.
PRODUCTS = r"(?i)^which\s+products?\s+depends?\s+on\s+(.+?)\s*[?.!]*$"
STATUS = r"(?i)^what\s+is\s+the\s+evidence\s+status\s+of\s+(.+?)\s+in\s+(.+?)\s*[?.!]*$"


def _bare(s: Column) -> Column:
    unquoted = F.regexp_replace(F.trim(s), "^[\"']+|[\"']+$", "")
    return F.trim(F.regexp_replace(unquoted, "^[?.! ]+|[?.! ]+$", ""))


def parse_question(question: Column) -> Column:
    """Struct of intent, entity, element, blueprint; intent UNSUPPORTED where no template fits (SCL-20)."""
    q = F.trim(F.regexp_replace(question, r"\s+", " "))
    entity = _bare(F.regexp_extract(q, PRODUCTS, 1))
    element, blueprint = (_bare(F.regexp_extract(q, STATUS, i)) for i in (1, 2))
    products = q.rlike(PRODUCTS) & (entity != "")
    status = ~q.rlike(PRODUCTS) & q.rlike(STATUS) & (element != "") & (blueprint != "")
    return F.struct(
        F.when(products, "PRODUCTS_DEPENDING_ON_SUPPLIER").when(status, "INFORMATION_ELEMENT_CONTEXT_EXPLANATION").otherwise("UNSUPPORTED").alias("intent"),
        F.when(products, entity).alias("entity"),
        F.when(status, element).alias("element"),
        F.when(status, blueprint).alias("blueprint"),
    )


#: Who speaks in answers.
SPEAKER = "The catalogue"
# The sentences of answers, in order; %s is who speaks, or what is asked about.
NO_PRODUCTS = ("%s found 0 products connected to ", " through governed ontology relationships.")
ONE_PRODUCT, MANY_PRODUCTS = "1 product depends on ", " products depend on "
MAPPED = "%s has an Approved semantic mapping for this requirement."
NOT_MAPPED = "%s does not currently have an Approved semantic mapping for this requirement."
NOT_APPLICABLE = "Evidence availability is not applicable, since no mapping exists to resolve a SourceField from."
PRESENT = "Governed non-empty evidence has been observed for the resolved SourceField."
EMPTY = "Governed evidence has been observed for the resolved SourceField, but it is empty."
NONE = "No governed evidence has been observed for the resolved SourceField."


def products_answer(supplier: Column, names: Column, speaker: str = SPEAKER) -> Column:
    """Answer text for none, one or several sorted product names (SCL-21)."""
    n = F.size(names)
    listed = F.array_join(F.transform(names, lambda x: F.concat(F.lit("- "), x)), "\n")
    return (
        F.when(n == 0, F.concat(F.lit(NO_PRODUCTS[0] % speaker), supplier, F.lit(NO_PRODUCTS[1])))
        .when(n == 1, F.concat(F.lit(ONE_PRODUCT), supplier, F.lit(":\n"), listed))
        .otherwise(F.concat(n.cast("string"), F.lit(MANY_PRODUCTS), supplier, F.lit(":\n"), listed))
    )


def context_answer(element: Column, blueprint: Column, coverage: Column, evidence: Column, speaker: str = SPEAKER) -> Column:
    """Explanation of a coverage and evidence pair (SCL-21)."""
    covered = F.when(coverage == "MAPPED", MAPPED % speaker).otherwise(NOT_MAPPED % speaker)
    observed = F.when(evidence.isNull(), NOT_APPLICABLE).when(evidence == "EVIDENCE_PRESENT", PRESENT).when(evidence == "EVIDENCE_EMPTY", EMPTY).otherwise(NONE)
    return F.concat(F.lit("'"), element, F.lit("' in the "), blueprint, F.lit(" Blueprint: "), covered, F.lit(" "), observed)


def path_text(steps: Column) -> Column:
    """``A → rel → B → rel → C`` of an array of (source, relation, target) (SCL-22)."""
    rest = F.flatten(F.transform(steps, lambda s: F.array(F.concat(F.lit("→ "), s["relation"], F.lit(" →")), s["target"])))
    return F.when(F.size(steps) == 0, "").otherwise(F.array_join(F.concat(F.array(F.get(steps, F.lit(0))["source"]), rest), " "))
