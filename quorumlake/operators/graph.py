"""Bounded simple paths over a typed property graph, for all starts at once.

Entities are (tenant_id, entity_id, entity_name, entity_type_name), edges
(tenant_id, relationship_name, from_entity_id, to_entity_id). Walks go hop by
hop; each front is stored, so a hop is joined once however often its rows are
read, and a walk ends when a front is empty. Edges are not deduplicated, so
parallel edges give parallel paths.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 6
Keep = Callable[[DataFrame], DataFrame]
STEP = "array<struct<relationship_name:string,entity_id:string,entity_name:string>>"


def distances(hops: DataFrame, target_type: str, max_depth: int, keep: Keep = lambda hops: hops) -> DataFrame:
    """tenant_id, at, far: nodes from which a ``target_type`` is ``max_depth`` hops away or fewer, and the fewest.

    Found backwards from the targets: only nodes that are new in a round lead to the next, and rounds end when none is.
    Targets themselves are not walked through. ``hops`` has tenant_id, at, next and the type of next, ``_type``.
    """
    onward = hops.filter(F.col("_type") != target_type).select("tenant_id", "at", "next").distinct()
    front = keep(hops.filter(F.col("_type") == target_type).select("tenant_id", "at").distinct().withColumn("far", F.lit(1)))
    found = front
    for far in range(2, max_depth + 1):
        ends = front.select("tenant_id", F.col("at").alias("next"))
        new = onward.join(ends, ["tenant_id", "next"], "left_semi").select("tenant_id", "at").distinct()
        front = keep(new.join(found, ["tenant_id", "at"], "left_anti").withColumn("far", F.lit(far)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def typed_hops(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """tenant_id, relationship_name, at, next, and the name and type of next: edges to nodes that are in ``entities``."""
    nodes = entities.select("tenant_id", F.col("entity_id").alias("to_entity_id"), F.col("entity_name").alias("_name"), F.col("entity_type_name").alias("_type"))
    return edges.join(nodes, ["tenant_id", "to_entity_id"]).select("tenant_id", "relationship_name", F.col("from_entity_id").alias("at"), F.col("to_entity_id").alias("next"), "_name", "_type")


def targets_reached(starts: DataFrame, hops: DataFrame, target_type: str, max_depth: int = MAX_DEPTH, keep: Keep = lambda hops: hops) -> DataFrame:
    """tenant_id, start_id, target_id, target_name: the ends of ``paths_to_type`` without their paths; a pair can come more than once.

    A hop starts only from pairs of start and node that the hop before found first, towards nodes from which a target
    can still be reached in the hops that are left; nothing is walked from a target. A target that some path reaches is
    reached by a shortest one, which meets no node twice. ``hops`` are ``typed_hops``; ``keep`` stores the fronts, and
    what has arrived is joined to them as the result is read.
    """
    pair = ["tenant_id", "start_id", "node"]
    arriving = hops.filter(F.col("_type") == target_type).select("tenant_id", F.col("at").alias("node"), F.col("next").alias("target_id"), F.col("_name").alias("target_name")).distinct()
    front = starts.select("tenant_id", "start_id", F.col("start_id").alias("node")).distinct()
    if max_depth > 1:
        far = distances(hops, target_type, max_depth - 1, keep).select("tenant_id", F.col("at").alias("next"), "far")
        onward = hops.filter(F.col("_type") != target_type).select("tenant_id", F.col("at").alias("node"), "next").distinct()
        onward = keep(onward.join(far, ["tenant_id", "next"]))
    seen, found = front, []
    for depth in range(1, max_depth + 1):
        found.append(front.join(arriving, ["tenant_id", "node"]).filter("target_id <> start_id").select("tenant_id", "start_id", "target_id", "target_name"))
        if depth == max_depth:
            break
        ahead = front.join(onward.filter(F.col("far") <= max_depth - depth), ["tenant_id", "node"]).select("tenant_id", "start_id", F.col("next").alias("node")).distinct()
        front = keep(ahead.join(seen, pair, "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return reduce(DataFrame.unionByName, found)


def paths_to_type(starts: DataFrame, entities: DataFrame, edges: DataFrame, target_type: str, max_depth: int = MAX_DEPTH, keep: Keep = lambda hops: hops) -> DataFrame:
    """tenant_id, start_id, target_id, target_name, depth, steps of every simple path that ends at its first ``target_type`` (GRF-02).

    ``starts`` has tenant_id and start_id. Nodes that aren't in ``entities`` end a path. A hop is taken only to a target,
    or to a node from which one can still be reached in the hops that are left. ``keep`` stores the hops and each front;
    hops to targets are joined to the stored fronts as the result is read, so paths that have arrived are not stored.
    """
    hops = keep(typed_hops(entities, edges))
    found = []
    known = entities.select("tenant_id", F.col("entity_id").alias("start_id"))
    front = starts.join(known, ["tenant_id", "start_id"], "left_semi").select("tenant_id", "start_id", F.col("start_id").alias("at"), F.array("start_id").alias("seen"), F.array().cast(STEP).alias("steps"))
    if max_depth > 1:
        far = distances(hops, target_type, max_depth - 1, keep).select("tenant_id", F.col("at").alias("next"), "far")
        target = F.col("_type") == target_type
        hops = keep(hops.join(far, ["tenant_id", "next"], "left").withColumn("left", F.when(target, 0).otherwise(F.col("far"))).filter("left IS NOT NULL").drop("far"))
    else:
        hops = hops.filter(F.col("_type") == target_type).withColumn("left", F.lit(0))
    step = F.struct("relationship_name", F.col("next").alias("entity_id"), F.col("_name").alias("entity_name"))
    arriving, onward = hops.filter("left = 0"), hops.filter("left > 0")
    for depth in range(1, max_depth + 1):
        new, steps = ~F.array_contains("seen", F.col("next")), F.concat("steps", F.array(step)).alias("steps")
        found.append(
            front.join(arriving, ["tenant_id", "at"])
            .filter(new)
            .select("tenant_id", "start_id", F.col("next").alias("target_id"), F.col("_name").alias("target_name"), F.lit(depth).alias("depth"), steps)
        )
        if depth == max_depth:
            break
        ahead = front.join(onward.filter(F.col("left") <= max_depth - depth), ["tenant_id", "at"]).filter(new)
        front = keep(ahead.select("tenant_id", "start_id", F.col("next").alias("at"), F.concat("seen", F.array("next")).alias("seen"), steps))
        if front.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def reachable(starts: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH, keep: Keep = lambda hops: hops) -> DataFrame:
    """tenant_id, start_id, node, depth: other nodes within ``max_depth`` hops, by the fewest.

    A hop starts only from pairs that the hop before found first, so no pair is walked from twice, cycles included, and
    the walk ends when nothing is new. ``keep`` stores the hops and what each hop finds.
    """
    hops = keep(edges.select("tenant_id", F.col("from_entity_id").alias("node"), F.col("to_entity_id").alias("next")).distinct())
    pair = ["tenant_id", "start_id", "node"]
    front = keep(starts.select("tenant_id", "start_id", F.col("start_id").alias("node")).distinct().withColumn("depth", F.lit(0)))
    seen = front
    for depth in range(1, max_depth + 1):
        ahead = front.join(hops, ["tenant_id", "node"]).select("tenant_id", "start_id", F.col("next").alias("node")).distinct()
        front = keep(ahead.join(seen, pair, "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("depth > 0")


def tenant_graph(entities: DataFrame, types: DataFrame, relations: DataFrame, relation_types: DataFrame, tenant: str) -> tuple[DataFrame, DataFrame]:
    """A tenant's entities with type names, and edges with relation names (GRF-01)."""
    own = entities.filter(F.col("tenant_id") == tenant).join(types, "entity_type_id").select("tenant_id", "entity_id", "entity_name", "entity_type_name")
    edges = relations.filter(F.col("tenant_id") == tenant).join(relation_types, "relationship_type_id").select("tenant_id", "relationship_name", "from_entity_id", "to_entity_id")
    return own, edges


# The segments of a supplier's impact, their ends' types and their depths.
SEGMENTS = (("Supplier", "Material", 1), ("Material", "Product", 2), ("Product", "Facility", 1), ("Product", "Revenue Exposure", 1), ("Supplier", "Risk Event", 2))


def impact(entities: DataFrame, edges: DataFrame, keep: Keep = lambda hops: hops) -> DataFrame:
    """tenant_id, supplier_id, entity_type_name, entity_id, entity_name, revenue_exposure_id: what each supplier's failure reaches (GRF-03).

    A segment is walked once for all its starts, as pairs without their paths, so paths of one segment don't multiply
    with those of the next. What lies beyond materials is found for each material first; then suppliers take it from
    their materials in one join. Of a material, the first revenue exposure in path order is named. ``keep`` stores what
    is read more than once: the hops, fronts, segments and what lies beyond materials.
    """
    keys = ["tenant_id", "supplier_id"]
    hops = keep(typed_hops(entities, edges))

    def segment(source: str, target: str, depth: int) -> DataFrame:
        starts = entities.filter(F.col("entity_type_name") == source).select("tenant_id", F.col("entity_id").alias("start_id"))
        return keep(targets_reached(starts, hops, target, depth, keep).distinct())

    def then(kind: str) -> DataFrame:
        """What of ``kind`` lies beyond the products of each material."""
        at = walked["Product", kind].select("tenant_id", F.col("start_id").alias("product_id"), "target_id", "target_name")
        return made.select("tenant_id", "start_id", F.col("target_id").alias("product_id")).join(at, ["tenant_id", "product_id"]).select("tenant_id", "start_id", F.lit(kind).alias("entity_type_name"), "target_id", "target_name").distinct()

    walked = {(a, b): segment(a, b, depth) for a, b, depth in SEGMENTS}
    materials, risks = (walked["Supplier", x].withColumnRenamed("start_id", "supplier_id") for x in ("Material", "Risk Event"))
    made = walked["Material", "Product"]
    beyond = keep(made.withColumn("entity_type_name", F.lit("Product")).unionByName(then("Facility")).unionByName(then("Revenue Exposure")))
    at_material = materials.select(*keys, F.col("target_id").alias("start_id"))
    reached = at_material.join(beyond, ["tenant_id", "start_id"]).select(*keys, "entity_type_name", "target_id", "target_name").distinct()
    of_product = walked["Product", "Revenue Exposure"].groupBy("tenant_id", F.col("start_id").alias("target_id")).agg(F.min(F.struct("target_name", F.col("target_id").alias("id"))).alias("exposure"))
    first = F.min(F.struct(F.col("target_name").alias("product_name"), F.col("target_id").alias("product_id"), "exposure"))
    of_material = walked["Material", "Product"].join(of_product, ["tenant_id", "target_id"]).groupBy("tenant_id", F.col("start_id").alias("target_id")).agg(first.alias("first"))
    named = materials.join(of_material, ["tenant_id", "target_id"], "left").withColumn("revenue_exposure_id", F.col("first.exposure.id"))
    none = F.lit(None).cast("string").alias("revenue_exposure_id")
    parts = [named.withColumn("entity_type_name", F.lit("Material")), reached.withColumn("revenue_exposure_id", none), risks.withColumns({"entity_type_name": F.lit("Risk Event"), "revenue_exposure_id": none})]
    rows = [x.select(*keys, "entity_type_name", F.col("target_id").alias("entity_id"), F.col("target_name").alias("entity_name"), "revenue_exposure_id") for x in parts]
    return reduce(DataFrame.unionByName, rows)


def path_order(name: Column, target: Column, depth: Column, steps: Column) -> list[Column]:
    """Stable order of paths: target name and id, then the shortest, then by steps (WIN-03)."""
    return [name, target, depth, F.transform(steps, lambda s: F.struct(s["relationship_name"], s["entity_id"]))]


def first_path(paths: DataFrame, key: str) -> DataFrame:
    """Each start's first target in path order (GRF-04)."""
    return paths.groupBy(key).agg(F.min(F.struct("target_name", "target_id", "depth")).alias("_first")).select(key, F.col("_first.target_id").alias("target_id"), F.col("_first.target_name").alias("target_name"))


# The ontology's concepts and relations, and the steps of its main path.
CONCEPTS = ("Supplier", "Material", "BOM", "Product", "Facility", "Region", "Contract", "Risk Event", "Revenue Exposure", "Alternate Supplier")
RELATIONS = (
    ("supplies", "Supplier", "Material"),
    ("usedIn", "Material", "BOM"),
    ("defines", "BOM", "Product"),
    ("generatesRevenue", "Product", "Revenue Exposure"),
    ("locatedIn", "Supplier", "Region"),
    ("exposedTo", "Region", "Risk Event"),
    ("boundBy", "Supplier", "Contract"),
    ("assembledAt", "Product", "Facility"),
    ("coveredBy", "Material", "Contract"),
    ("candidateFor", "Alternate Supplier", "Material"),
)
PATH_STEPS = ("supplies", "usedIn", "defines", "generatesRevenue")


def resolve_ontologies(concepts: DataFrame, bindings: DataFrame, by: str = "ontology") -> DataFrame:
    """by, relation, source, target, status, n_lacking: each ontology's bindings whose ends are its concepts, and whether it is complete (GRF-06).

    ``concepts`` has by, concept; ``bindings`` by, relation, source, target.
    """
    spark = concepts.sparkSession
    side = lambda end: concepts.select(by, F.col("concept").alias(end))
    ends = bindings.join(side("source"), [by, "source"]).join(side("target"), [by, "target"]).select(by, "relation", "source", "target")
    names = spark.createDataFrame([(c,) for c in CONCEPTS], "concept string")
    wanted = spark.createDataFrame(list(RELATIONS), "relation string, source string, target string")
    has = concepts.join(F.broadcast(names), "concept", "left_semi").groupBy(by).agg(F.countDistinct("concept").alias("_c"))  # ten names
    bound = ends.join(F.broadcast(wanted), ["relation", "source", "target"], "left_semi").groupBy(by).agg(F.countDistinct("relation", "source", "target").alias("_r"))  # the required relations
    lacking = F.lit(len(CONCEPTS) + len(RELATIONS)) - F.coalesce("_c", F.lit(0)) - F.coalesce("_r", F.lit(0))
    j = ends.join(has, by, "left").join(bound, by, "left").withColumn("n_lacking", lacking.cast("long"))
    return j.select(by, "relation", "source", "target", F.when(F.col("n_lacking") == 0, "Published").otherwise("Draft").alias("status"), "n_lacking")


def semantic_path(resolved: DataFrame, steps: tuple[str, ...] = PATH_STEPS, *by: str) -> DataFrame:
    """by, place, relation, source, target of the path's steps that the ontology has (GRF-05)."""
    order = resolved.sparkSession.createDataFrame(list(enumerate(steps)), "place int, relation string")
    return resolved.join(F.broadcast(order), "relation").select(*by, "place", "relation", "source", "target")  # a row per step


def grid(index: Column, columns: int = 4, width: int = 220, height: int = 110) -> tuple[Column, Column]:
    """x and y of the node of an index, from 0, on a grid that fills row by row (GRF-08)."""
    row = F.floor(index / columns)
    return (index % columns) * width, row * height


# The relations of a scenario as (id, kind of source, kind of target, label, on the risk path), and the label of a severe event.
SCENARIO_EDGES = (
    ("e-supplies", "supplier", "material", "supplies", True),
    ("e-used-in", "material", "product", "used in", True),
    ("e-assembled-at", "product", "facility", "assembled at", True),
    ("e-generates-revenue", "facility", "revenue", "generates revenue", True),
    ("e-located-in", "supplier", "region", "located in", True),
    ("e-affected-by", "region", "riskEvent", "affected by", True),
    ("e-covered-by", "material", "agreement", "covered by", True),
    ("e-alternate-for", "candidate", "material", "candidate alternate for", False),
)
SEVERE_EVENT = "Severe Regional Logistics Disruption"
# The labels and details of a scenario's nodes, in order.
STATUS, REGION, UNIT_COST, ANNUAL, TIED = "Status: %s", "Region: %s", "Unit cost: $%s", "$%sM Annual Revenue", "Annual revenue tied to this product."
AGREEMENT, SOURCED, CAPACITY, LEAD_TIME = "Supply Agreement %s", "%s%% sourced from %s", "Available capacity: %s%%", "Activation lead time: %s days"


def _rounded(x: Column) -> Column:
    """``x`` in whole numbers, as C prints it: by its exact binary value, a half to the even one; Java's form rounds the decimal text half up."""
    return F.format_string("%.0f", F.rint(x))


def _cents(x: Column) -> Column:
    """``x`` with two decimals, by its exact binary value, a half to the even one.

    The fraction is counted in 2**-52, a hundred times which a long holds; what is finer, of numbers below 1, is added as a
    double, exactly from 2**-8 on, and below that nothing comes near a half.
    """
    size = F.abs(x)
    whole, scaled = F.floor(size), (size - F.floor(size)) * 2.0**52
    hundredfold = F.floor(scaled) * F.lit(100).cast("long")
    cents, rest = F.shiftright(hundredfold, 52), hundredfold.bitwiseAND(F.lit(2**52 - 1))
    over = (rest - F.lit(2**51)).cast("double") + (scaled - F.floor(scaled)) * 100.0
    cents = cents + ((over > 0) | ((over == 0) & (cents % 2 == 1))).cast("long")
    text = F.format_string("%s%d.%02d", F.when(F.format_string("%.0f", x).startswith("-"), "-").otherwise(""), whole + F.floor(cents / 100), cents % 100)
    # from 2**52 on there are no fractions, and what isn't a number has a form of its own
    return F.when(size < 2.0**52, text).otherwise(F.format_string("%.2f", x))


def scenario_nodes(facts: DataFrame) -> DataFrame:
    """scenario_id, id, kind, label, details, on_risk_path: nine nodes of each row of facts (GRF-07).

    ``facts`` has scenario_id and the structs supplier (id, name, status), region (id, name), material (id, name, unit_cost),
    product (id, name), facility (id, name, region), revenue (annual), event (id, severity, description),
    agreement (id, percent, terms) and candidate (id, name, status, capacity, lead_days).
    """
    c, text = F.col, lambda name: F.col(name).cast("string")
    say = lambda form, *names: F.format_string(form, *[text(n) for n in names])

    def node(prefix: str, label: Column, *details: Column, kind: str | None = None, at: Column | None = None, risk: bool = True) -> Column:
        key = F.concat(F.lit(f"{prefix}:"), text(f"{prefix}.id") if at is None else at)
        lines = F.array(*details) if details else F.array().cast("array<string>")
        return F.struct(key.alias("id"), F.lit(kind or prefix).alias("kind"), label.alias("label"), lines.alias("details"), F.lit(risk).alias("on_risk_path"))

    nodes = (
        node("supplier", c("supplier.name"), say(STATUS, "supplier.status"), say(REGION, "region.name")),
        node("material", c("material.name"), F.format_string(UNIT_COST, _cents(c("material.unit_cost")))),
        node("product", c("product.name")),
        node("facility", c("facility.name"), say(REGION, "facility.region")),
        node("revenue", F.format_string(ANNUAL, _rounded(c("revenue.annual") / 1_000_000)), F.lit(TIED), at=F.lit("primary")),
        node("region", c("region.name")),
        node("riskEvent", F.when(c("event.severity") == "Severe", SEVERE_EVENT).otherwise(c("event.description")), c("event.description"), at=text("event.id")),
        node("agreement", say(AGREEMENT, "agreement.id"), say(SOURCED, "agreement.percent", "supplier.name"), c("agreement.terms")),
        node("candidate", c("candidate.name"), say(STATUS, "candidate.status"), say(CAPACITY, "candidate.capacity"), say(LEAD_TIME, "candidate.lead_days"), kind="candidateSupplier", risk=False),
    )
    return facts.select("scenario_id", F.inline(F.array(*nodes)))


def scenario_edges(facts: DataFrame) -> DataFrame:
    """scenario_id, id, source, target, label, on_risk_path: eight edges of each row of facts (GRF-07)."""
    struct = {"riskEvent": "event"}
    end = lambda kind: F.lit("revenue:primary") if kind == "revenue" else F.concat(F.lit(f"{kind}:"), F.col(f"{struct.get(kind, kind)}.id").cast("string"))
    edge = lambda i, a, b, label, risk: F.struct(F.lit(i).alias("id"), end(a).alias("source"), end(b).alias("target"), F.lit(label).alias("label"), F.lit(risk).alias("on_risk_path"))
    return facts.select("scenario_id", F.inline(F.array(*[edge(*e) for e in SCENARIO_EDGES])))


def scenario_summary(facts: DataFrame) -> DataFrame:
    """scenario_id, annual_exposure, secondary_source_active of each row of facts; a scenario has one of each other thing (GRF-07)."""
    return facts.select("scenario_id", F.col("revenue.annual").alias("annual_exposure"), (F.col("agreement.percent") < 100).alias("secondary_source_active"))
