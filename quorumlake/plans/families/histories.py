"""TMP and GRF: histories of records and paths through graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlake.functions import questions
from quorumlake.operators import graph, temporal
from quorumlake.operators.filters import valid_as_of
from quorumlake.operators.intervals import latest_fact
from quorumlake.plans.registry import register
from quorumlake.plans.tables import read, stored

KEY, ORDER = ["user_id", "event_type"], ["ts", "event_id"]
CUT = "TIMESTAMP_NTZ '2024-01-15 00:00:00'"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


@register("tmp_01_history", "SELECT user_id, event_type, string_agg(event_id::VARCHAR, ',' ORDER BY ts DESC, event_id DESC) AS history FROM events GROUP BY ALL")
def tmp_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = temporal.history(_records(spark, sf_dir), KEY, ORDER, "event_id")
    return h.select(*KEY, F.array_join(F.col("history").cast("array<string>"), ",").alias("history"))


@register("tmp_02_current_as_of", f"SELECT user_id, event_type, first(event_id ORDER BY ts DESC, event_id DESC) AS current_id, first(value ORDER BY ts DESC, event_id DESC) AS value FROM events WHERE ts <= {CUT.replace('_NTZ', '')} GROUP BY ALL")
def tmp_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir).withColumn("current_id", F.col("event_id"))
    return temporal.current_as_of(records, KEY, F.expr(CUT), ORDER, ["current_id", "value"])


@register("tmp_03_prior_chain", "SELECT event_id, lag(event_id) OVER w AS prior, CAST(row_number() OVER w - 1 AS INT) AS n_prior, lead(1) OVER w IS NULL AS is_current FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def tmp_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.with_prior(_records(spark, sf_dir), KEY, ORDER, "event_id").select("event_id", "prior", "n_prior", "is_current")


@register("tmp_04_policy_trace", "SELECT event_type, hour(ts)::INT AS version, count(*) AS records, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY ALL")
def tmp_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.policy_trace(_records(spark, sf_dir).withColumn("version", F.hour("ts")), "event_type", "version", "event_id")


@register("tmp_05_validity", "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01' AND (CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL 90 DAY END IS NULL OR o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1996-06-01')")
def tmp_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
    return read(spark, sf_dir, "orders").filter(valid_as_of(F.expr("TIMESTAMP_NTZ '1996-06-01'"), F.col("o_orderdate"), end)).select("o_orderkey")


@register("tmp_06_authority_in_force", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-10' < ts + INTERVAL 2 DAY")
def tmp_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).filter(temporal.in_force(F.expr("TIMESTAMP_NTZ '2024-01-10'"), F.col("ts"), F.col("ts") + F.expr("INTERVAL 2 DAYS"))).select("event_id")


@register("tmp_07_hold_state", "SELECT user_id, first(event_id % 2 = 0 ORDER BY ts DESC, event_id DESC) AS hold FROM events WHERE event_type = 'error' GROUP BY 1")
def tmp_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    holds = _records(spark, sf_dir).filter("event_type = 'error'").withColumn("hold", F.col("event_id") % 2 == 0)
    return temporal.hold_state(holds, "user_id", ORDER, "hold")


DISPOSED = "event_type <> 'error' AND ts + INTERVAL 5 DAY < TIMESTAMP '2024-01-20' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING first(event_id % 2 = 0 ORDER BY ts DESC, event_id DESC))"


@register("tmp_08_disposable", f"SELECT event_id FROM events WHERE {DISPOSED}")
def tmp_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _records(spark, sf_dir)
    holds = temporal.hold_state(e.filter("event_type = 'error'").withColumn("hold", F.col("event_id") % 2 == 0), "user_id", ORDER, "hold")
    rows = e.filter("event_type <> 'error'")
    return temporal.disposable(rows, holds, "user_id", "hold", F.col("ts") + F.expr("INTERVAL 5 DAYS"), F.expr("TIMESTAMP_NTZ '2024-01-20'")).select("event_id")


@register("snk_08_retained", f"SELECT event_type, count(*) AS n FROM events WHERE NOT ({DISPOSED}) GROUP BY 1")
def snk_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).join(tmp_08(spark, sf_dir), "event_id", "left_anti").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("flt_07_expired_unheld", f"SELECT count(*) AS n FROM events WHERE {DISPOSED}")
def flt_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tmp_08(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@register("jn_21_latest_fact", "SELECT o_custkey, o_orderkey, (SELECT first(event_id ORDER BY ts DESC, event_id DESC) FROM events WHERE user_id = o_custkey) AS latest_event FROM orders")
def jn_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = _records(spark, sf_dir).groupBy(F.col("user_id").alias("o_custkey")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest_event"))
    return read(spark, sf_dir, "orders").join(latest, "o_custkey", "left").select("o_custkey", "o_orderkey", "latest_event")


@register("jn_21_fact_as_of_order", """
    WITH o AS (SELECT o_custkey AS user_id, o_orderkey, TIMESTAMP '2024-01-01' + (o_orderkey * 37 % 43200) * INTERVAL 1 MINUTE AS at FROM orders),
    f AS (SELECT user_id, ts, max(event_id) AS latest_event FROM events WHERE event_type <> 'error' GROUP BY ALL)
    SELECT o_orderkey, latest_event, value AS latest_value FROM (SELECT o.*, f.latest_event FROM o ASOF LEFT JOIN f ON f.user_id = o.user_id AND f.ts <= o.at) LEFT JOIN events ON event_id = latest_event""")
def jn_21_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its customer's latest approved event up to the order, not of all time."""
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(mins=(F.col("o_orderkey") * 37 % 43200).cast("int"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", at.alias("at"))
    facts = _records(spark, sf_dir).filter("event_type <> 'error'").select("user_id", "ts", F.col("event_id").alias("latest_event"), F.col("value").alias("latest_value"))
    return latest_fact(orders, facts, ["user_id"], "at", ["ts", "latest_event"], ["latest_event", "latest_value"], stored).drop("user_id", "at")


@register("tmp_02_current_as_of_rows", """
    WITH f AS (SELECT o_orderstatus AS status, o_orderdate, max(o_orderkey) AS current_order FROM orders GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, l_partkey, current_order FROM lineitem l ASOF LEFT JOIN f ON f.status = l.l_linestatus AND f.o_orderdate <= l.l_shipdate""")
def tmp_02_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the record of its status that was current when it was shipped; a status has a third of all rows and more."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"), "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    records = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderdate", F.col("o_orderkey").alias("current_order"))
    return latest_fact(lines, records, ["status"], "l_shipdate", ["o_orderdate", "current_order"], ["current_order"], stored).drop("status", "l_shipdate")


@register("tmp_04_policy_records", "SELECT event_type, hour(ts)::INT AS version, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS records FROM events GROUP BY ALL")
def tmp_04_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records themselves, by id."""
    records = temporal.policy_records(_records(spark, sf_dir).withColumn("version", F.hour("ts")), "event_type", "version", "event_id")
    return records.select("event_type", "version", F.array_join(F.col("records").cast("array<string>"), ",").alias("records"))


@register("win_04_record_order", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC, value DESC, event_id DESC) AS INT) AS place FROM events")
def win_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.to_date("ts").desc(), F.col("value").desc(), F.col("event_id").desc()]
    return _records(spark, sf_dir).select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).alias("place"))


# ---- graphs: supplier -> part -> order -> customer -> nation -> region

ENTITIES_SQL = """
    ents AS (SELECT 'S:' || s_suppkey AS id, s_name AS name, 'Supplier' AS type FROM supplier UNION ALL SELECT 'P:' || p_partkey, p_name, 'Material' FROM part
        UNION ALL SELECT 'O:' || o_orderkey, 'Order ' || o_orderkey, 'Product' FROM orders UNION ALL SELECT 'N:' || n_nationkey, n_name, 'Region' FROM nation
        UNION ALL SELECT 'R:' || r_regionkey, r_name, 'Risk Event' FROM region),
    edges AS (SELECT 'supplies' AS rel, 'S:' || l_suppkey AS a, 'P:' || l_partkey AS b FROM lineitem WHERE l_quantity > 40
        UNION ALL SELECT 'usedIn', 'P:' || l_partkey, 'O:' || l_orderkey FROM lineitem WHERE l_quantity > 40
        UNION ALL SELECT 'locatedIn', 'S:' || s_suppkey, 'N:' || s_nationkey FROM supplier UNION ALL SELECT 'exposedTo', 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation
        UNION ALL SELECT 'borders', 'N:' || n_nationkey, 'N:' || (n_nationkey + 1) % 25 FROM nation)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def node(name: str, prefix: str, key: str, label: object, kind: str) -> DataFrame:
        return read(spark, sf_dir, name).select(F.lit("t").alias("tenant_id"), F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("entity_id"), label.alias("entity_name"), F.lit(kind).alias("entity_type_name"))

    def edge(df: DataFrame, rel: str, a: str, ka: object, b: str, kb: object) -> DataFrame:
        return df.select(F.lit("t").alias("tenant_id"), F.lit(rel).alias("relationship_name"), F.concat(F.lit(f"{a}:"), ka.cast("string")).alias("from_entity_id"), F.concat(F.lit(f"{b}:"), kb.cast("string")).alias("to_entity_id"))

    entities = [
        node("supplier", "S", "s_suppkey", F.col("s_name"), "Supplier"),
        node("part", "P", "p_partkey", F.col("p_name"), "Material"),
        node("orders", "O", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), "Product"),
        node("nation", "N", "n_nationkey", F.col("n_name"), "Region"),
        node("region", "R", "r_regionkey", F.col("r_name"), "Risk Event"),
    ]
    lines, nation = read(spark, sf_dir, "lineitem").filter("l_quantity > 40"), read(spark, sf_dir, "nation")
    edges = [
        edge(lines, "supplies", "S", F.col("l_suppkey"), "P", F.col("l_partkey")),
        edge(lines, "usedIn", "P", F.col("l_partkey"), "O", F.col("l_orderkey")),
        edge(read(spark, sf_dir, "supplier"), "locatedIn", "S", F.col("s_suppkey"), "N", F.col("s_nationkey")),
        edge(nation, "exposedTo", "N", F.col("n_nationkey"), "R", F.col("n_regionkey")),
        edge(nation, "borders", "N", F.col("n_nationkey"), "N", (F.col("n_nationkey") + 1) % 25),
    ]
    return reduce(DataFrame.unionByName, entities), reduce(DataFrame.unionByName, edges)


def _starts(entities: DataFrame, condition: str) -> DataFrame:
    return entities.filter(condition).select("tenant_id", F.col("entity_id").alias("start_id"))


SUPPLIERS, ALL_STARTS = "entity_type_name = 'Supplier'", "SELECT id FROM ents WHERE type = 'Supplier'"


def _walk_sql(target: str, depth: int, starts: str) -> str:
    return f"""WITH RECURSIVE {ENTITIES_SQL}, walk AS (
        SELECT e.id AS start_id, e.id AS node, e.name, e.type, 0 AS depth, [e.id] AS seen, '' AS rels FROM ents e WHERE e.id IN ({starts})
        UNION ALL SELECT w.start_id, n.id, n.name, n.type, w.depth + 1, list_append(w.seen, n.id), w.rels || '>' || g.rel
        FROM walk w JOIN edges g ON g.a = w.node JOIN ents n ON n.id = g.b WHERE w.depth < {depth} AND NOT list_contains(w.seen, n.id) AND (w.depth = 0 OR w.type <> '{target}'))"""


@register("grf_02_paths_to_type", _walk_sql("Product", 6, ALL_STARTS) + " SELECT start_id, node AS target_id, name AS target_name, depth, rels FROM walk WHERE depth > 0 AND type = 'Product'")
def grf_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, edges = _graph(spark, sf_dir)
    paths = graph.paths_to_type(_starts(entities, SUPPLIERS), entities, edges, "Product", keep=stored)
    return paths.select("start_id", "target_id", "target_name", "depth", F.array_join(F.transform("steps", lambda s: F.concat(F.lit(">"), s["relationship_name"])), "").alias("rels"))


@register("grf_01_tenant_graph", "SELECT l_suppkey % 5 AS tenant, count(*) AS edges, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey % 5 = 2 GROUP BY 1")
def grf_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").withColumn("tenant", F.col("l_suppkey") % 5).filter("tenant = 2")  # noqa: E741
    return l.join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("tenant").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("l_suppkey").alias("suppliers"))


@register("grf_03_impact_segments", "SELECT s.l_suppkey AS supplier, count(DISTINCT s.l_partkey) AS materials, count(DISTINCT o.o_orderkey) AS products, count(DISTINCT o.o_custkey) AS exposures FROM lineitem s JOIN orders o ON s.l_orderkey = o.o_orderkey GROUP BY 1")
def grf_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_orderkey").alias("o_orderkey"))
    joined = lines.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return joined.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.countDistinct("l_partkey").alias("materials"), F.countDistinct("o_orderkey").alias("products"), F.countDistinct("o_custkey").alias("exposures"))


IMPACT_SQL = f"""WITH {ENTITIES_SQL},
    more AS (SELECT * FROM ents UNION ALL SELECT DISTINCT 'F:' || o_custkey % 40, 'Site ' || o_custkey % 40, 'Facility' FROM orders UNION ALL SELECT 'C:' || c_custkey, c_name, 'Revenue Exposure' FROM customer),
    mat AS (SELECT DISTINCT 'S:' || l_suppkey AS s, 'P:' || l_partkey AS m FROM lineitem WHERE l_quantity > 40),
    pro AS (SELECT DISTINCT 'P:' || l_partkey AS m, 'O:' || l_orderkey AS p FROM lineitem WHERE l_quantity > 40),
    ord AS (SELECT 'O:' || o_orderkey AS p, 'F:' || o_custkey % 40 AS f, CASE WHEN o_orderkey % 3 <> 0 THEN 'C:' || o_custkey END AS c FROM orders),
    fin AS (SELECT m, first(c ORDER BY 'Order ' || substr(p, 3), p) AS c FROM pro JOIN ord USING (p) WHERE c IS NOT NULL GROUP BY 1),
    near AS (SELECT s_suppkey, s_nationkey AS n FROM supplier), risk AS (SELECT 'S:' || s_suppkey AS s, 'R:' || n_regionkey AS r FROM near JOIN nation ON n = n_nationkey),
    pairs AS (SELECT s, 'Material' AS kind, m AS id, fin.c AS exposure FROM mat LEFT JOIN fin USING (m) UNION SELECT s, 'Product', p, NULL FROM mat JOIN pro USING (m)
        UNION SELECT s, 'Facility', f, NULL FROM mat JOIN pro USING (m) JOIN ord USING (p) UNION SELECT s, 'Revenue Exposure', ord.c, NULL FROM mat JOIN pro USING (m) JOIN ord USING (p) WHERE ord.c IS NOT NULL UNION SELECT s, 'Risk Event', r, NULL FROM risk)
    SELECT s AS supplier_id, kind AS entity_type_name, pairs.id AS entity_id, name AS entity_name, exposure AS revenue_exposure_id FROM pairs JOIN more USING (id)"""


@register("grf_03_impact_of_all_suppliers", IMPACT_SQL)
def grf_03_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are products, made at sites and paid for by customers; orders by threes have no customer to name."""
    entities, edges = _graph(spark, sf_dir)
    orders, key = read(spark, sf_dir, "orders"), lambda prefix, column: F.concat(F.lit(prefix), column.cast("string"))
    node = lambda df, i, label, kind: df.select(F.lit("t").alias("tenant_id"), i.alias("entity_id"), label.alias("entity_name"), F.lit(kind).alias("entity_type_name"))
    edge = lambda df, rel, b: df.select(F.lit("t").alias("tenant_id"), F.lit(rel).alias("relationship_name"), key("O:", F.col("o_orderkey")).alias("from_entity_id"), b.alias("to_entity_id"))
    site = F.col("o_custkey") % 40
    entities = entities.unionByName(node(orders, key("F:", site), key("Site ", site), "Facility").distinct()).unionByName(node(read(spark, sf_dir, "customer"), key("C:", F.col("c_custkey")), F.col("c_name"), "Revenue Exposure"))
    edges = edges.unionByName(edge(orders, "assembledAt", key("F:", site))).unionByName(edge(orders.filter("o_orderkey % 3 <> 0"), "generatesRevenue", key("C:", F.col("o_custkey"))))
    return graph.impact(entities, edges, stored).drop("tenant_id")


GRAPH_SQL = """SELECT 'node' AS kind, 'S:' || s_suppkey AS id, s_name AS label, CASE WHEN s_acctbal < 0 THEN 'Alternate Supplier' ELSE 'Supplier' END AS type_name, NULL AS to_id FROM supplier WHERE s_suppkey % 5 = 2
    UNION ALL SELECT 'edge', 'S:' || l_suppkey, NULL, CASE l_returnflag WHEN 'A' THEN 'candidateFor' WHEN 'N' THEN 'supplies' END, 'P:' || l_partkey FROM lineitem WHERE l_suppkey % 5 = 2 AND l_returnflag IN ('A', 'N')"""


@register("grf_01_graph_of_a_tenant", GRAPH_SQL)
def grf_01_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and relations by the ids of their types; a relation of an unknown type is no edge."""
    tenant = lambda c: (F.col(c) % 5).cast("string").alias("tenant_id")
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    entities = read(spark, sf_dir, "supplier").select(tenant("s_suppkey"), key("S:", "s_suppkey").alias("entity_id"), F.col("s_name").alias("entity_name"), F.when(F.col("s_acctbal") < 0, 2).otherwise(1).alias("entity_type_id"))
    relations = read(spark, sf_dir, "lineitem").select(tenant("l_suppkey"), F.ascii("l_returnflag").alias("relationship_type_id"), key("S:", "l_suppkey").alias("from_entity_id"), key("P:", "l_partkey").alias("to_entity_id"))
    types = spark.createDataFrame([(1, "Supplier"), (2, "Alternate Supplier")], "entity_type_id int, entity_type_name string")
    relation_types = spark.createDataFrame([(ord("N"), "supplies"), (ord("A"), "candidateFor")], "relationship_type_id int, relationship_name string")
    nodes, edges = graph.tenant_graph(entities, types, relations, relation_types, "2")
    none = lambda name: F.lit(None).cast("string").alias(name)
    return nodes.select(F.lit("node").alias("kind"), F.col("entity_id").alias("id"), F.col("entity_name").alias("label"), F.col("entity_type_name").alias("type_name"), none("to_id")).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.col("from_entity_id").alias("id"), none("label"), F.col("relationship_name").alias("type_name"), F.col("to_entity_id").alias("to_id"))
    )


@register("grf_04_first_risk_event", _walk_sql("Risk Event", 2, ALL_STARTS) + " SELECT start_id, first(node ORDER BY name, node) AS target_id, first(name ORDER BY name, node) AS target_name FROM walk WHERE depth > 0 AND type = 'Risk Event' GROUP BY 1")
def grf_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, edges = _graph(spark, sf_dir)
    return graph.first_path(graph.paths_to_type(_starts(entities, SUPPLIERS), entities, edges, "Risk Event", 2, stored), "start_id")


@register("win_03_path_order", _walk_sql("Risk Event", 3, ALL_STARTS) + " SELECT start_id, node AS target_id, depth, rels, CAST(row_number() OVER (PARTITION BY start_id ORDER BY name, node, depth, rels) AS INT) AS place FROM walk WHERE depth > 0 AND type = 'Risk Event'")
def win_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, edges = _graph(spark, sf_dir)
    paths = graph.paths_to_type(_starts(entities, SUPPLIERS), entities, edges, "Risk Event", 3, stored)
    order = graph.path_order(F.col("target_name"), F.col("target_id"), F.col("depth"), F.col("steps"))
    rels = F.array_join(F.transform("steps", lambda s: F.concat(F.lit(">"), s["relationship_name"])), "")
    return paths.select("start_id", "target_id", "depth", rels.alias("rels"), F.row_number().over(Window.partitionBy("start_id").orderBy(*order)).alias("place"))


@register("grf_07_scenario_model", "SELECT s_suppkey, kind, label FROM supplier, LATERAL (SELECT unnest(['supplier', 'nation', 'risk']) AS kind) k, LATERAL (SELECT CASE kind WHEN 'supplier' THEN s_name WHEN 'nation' THEN 'N:' || s_nationkey ELSE CASE WHEN s_acctbal < 0 THEN 'at risk' ELSE 'clear' END END AS label) l")
def grf_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda kind, label: F.struct(F.lit(kind).alias("kind"), label.alias("label"))
    nodes = F.array(node("supplier", F.col("s_name")), node("nation", F.concat(F.lit("N:"), F.col("s_nationkey").cast("string"))), node("risk", F.when(F.col("s_acctbal") < 0, "at risk").otherwise("clear")))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.inline(nodes))


FACTS_SQL = """SELECT c_custkey AS k, s_suppkey, s_name, n_name, n_nationkey, p_partkey, p_name, p_retailprice, o_orderkey, o_orderpriority, o_totalprice * 1000 AS annual, event_id, event_type, a_key, a_name
    FROM customer JOIN supplier ON s_suppkey = c_custkey % 10 + 1 JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = c_custkey JOIN orders ON o_orderkey = c_custkey JOIN events ON event_id = c_custkey
    JOIN (SELECT s_suppkey AS a_key, s_name AS a_name FROM supplier) ON a_key = (c_custkey + 3) % 10 + 1"""
SCENARIO_SQL = f"""WITH f AS ({FACTS_SQL})
    SELECT k AS scenario_id, n.id, n.kind, n.label, n.d AS details, n.risk AS on_risk_path FROM (SELECT k, unnest([
        {{'id': 'supplier:' || s_suppkey, 'kind': 'supplier', 'label': s_name, 'd': 'Status: Approved|Region: ' || n_name, 'risk': true}},
        {{'id': 'material:' || p_partkey, 'kind': 'material', 'label': p_name, 'd': printf('Unit cost: $%.2f', p_retailprice), 'risk': true}},
        {{'id': 'product:' || o_orderkey, 'kind': 'product', 'label': o_orderpriority, 'd': '', 'risk': true}},
        {{'id': 'facility:' || k, 'kind': 'facility', 'label': 'Site ' || k, 'd': 'Region: ' || n_name, 'risk': true}},
        {{'id': 'revenue:primary', 'kind': 'revenue', 'label': printf('$%.0fM Annual Revenue', annual / 1000000), 'd': 'Annual revenue tied to this product.', 'risk': true}},
        {{'id': 'region:' || n_nationkey, 'kind': 'region', 'label': n_name, 'd': '', 'risk': true}},
        {{'id': 'riskEvent:' || event_id, 'kind': 'riskEvent', 'label': CASE WHEN k % 3 = 0 THEN 'Severe Regional Logistics Disruption' ELSE event_type END, 'd': event_type, 'risk': true}},
        {{'id': 'agreement:' || (k + 7), 'kind': 'agreement', 'label': 'Supply Agreement ' || (k + 7), 'd': (k % 101) || '% sourced from ' || s_name || '|net 30', 'risk': true}},
        {{'id': 'candidate:' || a_key, 'kind': 'candidateSupplier', 'label': a_name, 'd': 'Status: Qualified|Available capacity: ' || (k % 50) || '%|Activation lead time: 14 days', 'risk': false}}]) AS n FROM f)
    UNION ALL SELECT k, e.id, 'edge', e.label, e.s || '|' || e.t, e.risk FROM (SELECT k, unnest([
        {{'id': 'e-supplies', 's': 'supplier:' || s_suppkey, 't': 'material:' || p_partkey, 'label': 'supplies', 'risk': true}}, {{'id': 'e-used-in', 's': 'material:' || p_partkey, 't': 'product:' || o_orderkey, 'label': 'used in', 'risk': true}},
        {{'id': 'e-assembled-at', 's': 'product:' || o_orderkey, 't': 'facility:' || k, 'label': 'assembled at', 'risk': true}}, {{'id': 'e-generates-revenue', 's': 'facility:' || k, 't': 'revenue:primary', 'label': 'generates revenue', 'risk': true}},
        {{'id': 'e-located-in', 's': 'supplier:' || s_suppkey, 't': 'region:' || n_nationkey, 'label': 'located in', 'risk': true}}, {{'id': 'e-affected-by', 's': 'region:' || n_nationkey, 't': 'riskEvent:' || event_id, 'label': 'affected by', 'risk': true}},
        {{'id': 'e-covered-by', 's': 'material:' || p_partkey, 't': 'agreement:' || (k + 7), 'label': 'covered by', 'risk': true}}, {{'id': 'e-alternate-for', 's': 'candidate:' || a_key, 't': 'material:' || p_partkey, 'label': 'candidate alternate for', 'risk': false}}]) AS e FROM f)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scenario for each customer that has a part, an order and an event of its number."""
    s, k = read(spark, sf_dir, "supplier"), F.col("c_custkey")
    other = s.select(F.col("s_suppkey").alias("a_key"), F.col("s_name").alias("a_name"))
    j = read(spark, sf_dir, "customer").join(s, F.col("s_suppkey") == k % 10 + 1).join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    j = j.join(read(spark, sf_dir, "part"), F.col("p_partkey") == k).join(read(spark, sf_dir, "orders"), F.col("o_orderkey") == k).join(read(spark, sf_dir, "events"), F.col("event_id") == k).join(other, F.col("a_key") == (k + 3) % 10 + 1)
    return j.selectExpr(
        "c_custkey AS scenario_id",
        "named_struct('id', s_suppkey, 'name', s_name, 'status', 'Approved') AS supplier",
        "named_struct('id', n_nationkey, 'name', n_name) AS region",
        "named_struct('id', p_partkey, 'name', p_name, 'unit_cost', p_retailprice) AS material",
        "named_struct('id', o_orderkey, 'name', o_orderpriority) AS product",
        "named_struct('id', c_custkey, 'name', 'Site ' || c_custkey, 'region', n_name) AS facility",
        "named_struct('annual', o_totalprice * 1000) AS revenue",
        "named_struct('id', event_id, 'severity', if(c_custkey % 3 = 0, 'Severe', 'Minor'), 'description', event_type) AS event",
        "named_struct('id', c_custkey + 7, 'percent', c_custkey % 101, 'terms', 'net 30') AS agreement",
        "named_struct('id', a_key, 'name', a_name, 'status', 'Qualified', 'capacity', c_custkey % 50, 'lead_days', 14) AS candidate",
    )


@register("grf_07_scenarios", SCENARIO_SQL)
def grf_07_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, and edges with their ends as details."""
    facts = _facts(spark, sf_dir)
    nodes = graph.scenario_nodes(facts).withColumn("details", F.array_join("details", "|"))
    edges = graph.scenario_edges(facts).select("scenario_id", "id", F.lit("edge").alias("kind"), "label", F.concat_ws("|", "source", "target").alias("details"), "on_risk_path")
    return nodes.unionByName(edges)


@register("grf_07_scenario_summaries", f"SELECT k AS scenario_id, annual AS annual_exposure, k % 101 < 100 AS secondary_source_active FROM ({FACTS_SQL})")
def grf_07_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.scenario_summary(_facts(spark, sf_dir))


NAMED_SQL = "SELECT e.id AS start_id, coalesce(len(names), 0)::INT AS n, CASE WHEN coalesce(len(names), 0) = 0 THEN 'The catalogue found 0 products connected to ' || e.name || ' through governed ontology relationships.' WHEN len(names) = 1 THEN '1 product depends on ' || e.name || ':' || chr(10) || '- ' || names[1] ELSE len(names) || ' products depend on ' || e.name || ':' || chr(10) || array_to_string(list_transform(names, lambda x: '- ' || x), chr(10)) END AS answer FROM ents e LEFT JOIN named ON start_id = e.id WHERE e.type = 'Supplier'"


@register("cvg_08_ask_products", _walk_sql("Product", 6, ALL_STARTS) + ", named AS (SELECT start_id, list_sort(list(DISTINCT name)) AS names FROM walk WHERE depth > 0 AND type = 'Product' GROUP BY 1) " + NAMED_SQL)
def cvg_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, edges = _graph(spark, sf_dir)
    suppliers = entities.filter(SUPPLIERS)
    asked = suppliers.select("tenant_id", F.col("entity_id").alias("start_id"), questions.parse_question(F.concat(F.lit("which products depend on "), F.col("entity_name"), F.lit("?"))).alias("q"), "entity_name")
    # several suppliers may have a name; each is asked about once, under its own
    named = suppliers.select(F.col("tenant_id").alias("_tenant"), F.lower("entity_name").alias("_named")).distinct()
    known = asked.join(named, (F.col("tenant_id") == F.col("_tenant")) & (F.lower("q.entity") == F.col("_named")), "left_semi").select("tenant_id", "start_id", "entity_name")
    # only what is reachable is asked: paths end at their first product, and at nodes that are no entities
    reached = graph.targets_reached(known.select("tenant_id", "start_id"), stored(graph.typed_hops(entities, edges)), "Product", keep=stored)
    names = reached.groupBy("tenant_id", "start_id").agg(F.array_sort(F.collect_set("target_name")).alias("names"))
    listed = F.coalesce("names", F.array().cast("array<string>"))
    return known.join(names, ["tenant_id", "start_id"], "left").select("start_id", F.size(listed).alias("n"), questions.products_answer(F.col("entity_name"), listed).alias("answer"))
