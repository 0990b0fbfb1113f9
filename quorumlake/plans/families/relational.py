"""FLT, PRJ, JN, AGG, WIN, SET: relational operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.operators import aggregates, filters, joins, ranking, temporal
from quorumlake.plans.registry import register
from quorumlake.plans.tables import read, stored

AS_OF = "TIMESTAMP_NTZ '1998-06-01 00:00:00'"


# ---- filters and projections

@register("flt_01_tenant", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def flt_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.of_tenant(read(spark, sf_dir, "customer"), 7, "c_nationkey").select("c_custkey", "c_name")


@register("flt_02_named", "SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = (SELECT lower(min(n_name)) FROM nation WHERE n_nationkey = 3)")
def flt_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    wanted = n.filter("n_nationkey = 3").agg(F.lower(F.min("n_name")).alias("w"))
    return n.join(F.broadcast(wanted), F.lower("n_name") == F.col("w"), "left_semi").select("n_nationkey", "n_name")


VALID = "l_linestatus = 'O' AND l_returnflag = 'N'"


@register("flt_03_valid_as_of", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {VALID} AND l_shipdate <= TIMESTAMP '1998-06-01' AND l_shipdate + INTERVAL 180 DAY > TIMESTAMP '1998-06-01'")
def flt_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    ok = filters.valid_as_of(F.expr(AS_OF), F.col("l_shipdate"), F.col("l_shipdate") + F.expr("INTERVAL 180 DAYS"), active=F.col("l_linestatus") == "O", approved=F.col("l_returnflag") == "N")
    return l.filter(ok).select("l_orderkey", "l_linenumber")


@register("flt_04_one_by_name", "SELECT p_brand, p_type, count(*) AS matches, CASE WHEN count(*) = 1 THEN 'FOUND' ELSE 'AMBIGUOUS' END AS status FROM part GROUP BY ALL")
def flt_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.one_by_name(read(spark, sf_dir, "part"), ["p_brand", "p_type"])


@register("flt_05_review_queue", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND nullif(o_orderpriority, '1-URGENT') IS NOT NULL")
def flt_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT"))
    return read(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "P") & profile.isNotNull()).select("o_orderkey")


@register("flt_06_status", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL")
def flt_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@register("flt_08_prefix", "SELECT p_partkey FROM part WHERE starts_with(p_type, 'S')")
def flt_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").filter(F.col("p_type").startswith("S")).select("p_partkey")


@register("flt_09_required_members", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def flt_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return filters.members(read(spark, sf_dir, "customer"), wanted, ["c_nationkey"]).select("c_custkey")


@register("flt_10_threshold", "SELECT event_id, value FROM events WHERE value >= 250")
def flt_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").filter("value >= 250").select("event_id", "value")


@register("flt_11_request_errors", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT coalesce(o_totalprice <= 300000, false) THEN 'amount' END, CASE WHEN NOT coalesce(o_orderkey % 13 <> 0, false) THEN 'key' END, CASE WHEN NOT coalesce(trim(nullif(o_orderpriority, '5-LOW')) <> '', false) THEN 'priority' END], lambda x: x IS NOT NULL), ',') AS errors FROM orders")
def flt_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.errors(amount=F.col("o_totalprice") <= 300000, key=F.col("o_orderkey") % 13 != 0, priority=F.trim(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))) != "")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, ",").alias("errors"))


@register("flt_12_edges_of_node", "SELECT 'outgoing' AS direction, o_orderkey AS other FROM orders WHERE o_custkey = 5 UNION ALL SELECT 'incoming', l_orderkey FROM lineitem WHERE l_suppkey = 5")
def flt_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read(spark, sf_dir, "orders").filter("o_custkey = 5").select(F.lit("outgoing").alias("direction"), F.col("o_orderkey").alias("other"))
    return out.unionByName(read(spark, sf_dir, "lineitem").filter("l_suppkey = 5").select(F.lit("incoming").alias("direction"), F.col("l_orderkey").alias("other")))


@register("prj_01_response", "SELECT o_orderkey AS execution_id, o_orderstatus AS state, o_orderdate AS admitted_at FROM orders")
def prj_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("execution_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("admitted_at"))


# ---- joins

@register("jn_01_entity_type", "SELECT c_custkey, c_name, n_name AS type_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def jn_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("type_name"))
    return read(spark, sf_dir, "customer").join(types, "c_nationkey").select("c_custkey", "c_name", "type_name")


@register("jn_02_relation_type", "SELECT l_orderkey, l_linenumber, r_name AS relation FROM lineitem JOIN region ON l_suppkey % 5 = r_regionkey")
def jn_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = read(spark, sf_dir, "region")
    return read(spark, sf_dir, "lineitem").join(kinds, F.col("l_suppkey") % 5 == F.col("r_regionkey")).select("l_orderkey", "l_linenumber", F.col("r_name").alias("relation"))


@register("jn_03_endpoint_triples", "SELECT DISTINCT s.s_nationkey AS source, 'supplies' AS relation, p.p_brand AS target FROM lineitem JOIN supplier s ON l_suppkey = s_suppkey JOIN part p ON l_partkey = p_partkey")
def jn_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "part")
    edges = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    both = edges.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return both.select(F.col("s_nationkey").alias("source"), F.lit("supplies").alias("relation"), F.col("p_brand").alias("target")).distinct()


@register("jn_04_ambiguous_mapping", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_size) > 1 AS ambiguous FROM part")
def jn_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.unambiguous(read(spark, sf_dir, "part"), ["p_brand", "p_size"]).select("p_partkey", "ambiguous")


@register("jn_05_bindings", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 4")
def jn_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "region").filter("r_regionkey <> 4")
    places = read(spark, sf_dir, "nation").join(known, F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@register("jn_06_names_in_order", "SELECT o_custkey, string_agg(coalesce(name, '?'), ',' ORDER BY o_orderkey DESC) AS names, count(*) FILTER (WHERE name IS NULL) AS n_missing FROM (SELECT o_custkey, o_orderkey, o_orderkey % 120 AS id FROM orders) LEFT JOIN (SELECT s_suppkey AS id, s_name AS name FROM supplier) USING (id) GROUP BY o_custkey")
def jn_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey"), asc=False).alias("keys"))
    lists = o.select("o_custkey", F.transform("keys", lambda k: k % 120).alias("ids"))
    names = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    out = joins.in_order(lists, "o_custkey", "ids", names, "id", "name", default="?")
    return out.select("o_custkey", F.array_join("names", ",").alias("names"), "n_missing")


@register("jn_08_units_with_alternates", "SELECT p_partkey, a.s_suppkey AS alternate FROM (SELECT p_partkey, p_size % 26 AS tenant FROM part) p LEFT JOIN (SELECT s_suppkey, s_nationkey AS tenant FROM supplier WHERE s_suppkey % 5 = 0) a USING (tenant)")
def jn_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    alternates = read(spark, sf_dir, "supplier").filter("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("alternate"), F.col("s_nationkey").alias("tenant"))
    parts = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 26).alias("tenant"))
    # every part of a tenant has all of its alternates, so both are dealt to slices; parts without any stand alone
    units = joins.in_slices(parts, alternates, ["tenant"], "p_partkey", "alternate", 2_000)
    alone = parts.join(alternates.select("tenant").distinct(), "tenant", "left_anti")
    return units.unionByName(alone, allowMissingColumns=True).select("p_partkey", "alternate")


AUDIT_SQL = """
    WITH l AS (SELECT o_orderkey AS k, count(*) AS n, min(o_orderstatus) AS p FROM orders WHERE o_orderkey % 10 <> 1 GROUP BY 1),
         r AS (SELECT l_orderkey AS k, count(*) AS n, min(l_linestatus) AS p FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 10 <> 2 GROUP BY 1)
    SELECT k AS key, CASE WHEN r.n IS NULL THEN 'MISSING' WHEN l.n IS NULL THEN 'ORPHAN' WHEN l.n > 1 OR r.n > 1 THEN 'DUPLICATE' WHEN l.p IS DISTINCT FROM r.p THEN 'MISMATCH' END AS violation
    FROM l FULL JOIN r USING (k)"""


@register("jn_09_full_audit", AUDIT_SQL)
def jn_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 1").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("p"))
    right = read(spark, sf_dir, "lineitem").filter("l_linenumber = 1 and l_orderkey % 10 <> 2").select(F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("p"))
    return joins.audit(left, right, ["key"], "p")


@register("jn_10_requirement_present", "SELECT n_nationkey, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 8000) THEN 'SATISFIED' ELSE 'MISSING' END AS status FROM nation")
def jn_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = read(spark, sf_dir, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    return joins.required(read(spark, sf_dir, "nation").select("n_nationkey"), there, ["n_nationkey"]).select("n_nationkey", F.when(F.col("missing"), "MISSING").otherwise("SATISFIED").alias("status"))


@register("jn_11_broken_keys", "SELECT o_orderkey, k AS customer FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN -o_custkey ELSE o_custkey END AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer)")
def jn_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("o_orderkey") % 50 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"))
    return filters.members(read(spark, sf_dir, "orders").select("o_orderkey", k.alias("customer")), customers, ["customer"], present=False)


@register("jn_12_sources_of_references", "SELECT o_orderkey, string_agg(coalesce(s_name, 'Unknown source'), ',' ORDER BY l_linenumber, l_suppkey) AS sources FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 9 <> 0) ON s_suppkey = l_suppkey WHERE l_returnflag <> 'R' GROUP BY o_orderkey")
def jn_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = read(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("refs"))
    lists = refs.select(F.col("l_orderkey").alias("o_orderkey"), F.transform("refs", lambda x: x["l_suppkey"]).alias("ids"))
    names = read(spark, sf_dir, "supplier").filter("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return joins.in_order(lists, "o_orderkey", "ids", names, "id", "name", default="Unknown source").select("o_orderkey", F.array_join("names", ",").alias("sources"))


@register("jn_13_evidence_of_subject", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey % 4 = l_suppkey % 4)")
def jn_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 4).alias("subject"))
    lines = read(spark, sf_dir, "lineitem").withColumn("subject", F.col("l_suppkey") % 4)
    return filters.members(lines, subjects, ["l_orderkey", "subject"], present=False).select("l_orderkey", "l_linenumber")


@register("jn_14_routed_reference", "SELECT event_id, event_type FROM events WHERE (event_type = 'click' AND user_id IN (SELECT s_suppkey FROM supplier)) OR (event_type = 'view' AND user_id IN (SELECT p_partkey FROM part WHERE p_size > 25))")
def jn_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = read(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("ref"))
    targets = {"click": (read(spark, sf_dir, "supplier"), "s_suppkey"), "view": (read(spark, sf_dir, "part").filter("p_size > 25"), "p_partkey")}
    return joins.routed(refs, "event_type", "ref", targets).select("event_id", "event_type")


@register("jn_15_unowned_elements", "SELECT DISTINCT o_custkey AS case_id, o_custkey % 10 AS owner, o_orderkey AS id FROM orders WHERE o_orderkey % 10 <> o_custkey % 10")
def jn_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    cases = o.groupBy(F.col("o_custkey").alias("case_id")).agg(F.collect_list("o_orderkey").alias("ids")).withColumn("owner", F.col("case_id") % 10)
    return joins.unowned(cases, "case_id", "ids", o.select((F.col("o_orderkey") % 10).alias("owner"), F.col("o_orderkey").alias("id")), "owner", "id").select("case_id", "owner", "id")


@register("jn_16_owning_concept", "SELECT l_orderkey, l_linenumber, p_brand AS concept, p_brand IS NULL AS missing FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <> 7) ON l_partkey = p_partkey WHERE l_linenumber = 1")
def jn_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").filter("p_size <> 7").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("concept"))
    return joins.required(read(spark, sf_dir, "lineitem").filter("l_linenumber = 1"), parts, ["l_partkey"]).select("l_orderkey", "l_linenumber", "concept", "missing")


@register("jn_17_either_way", "SELECT n_nationkey, 'outgoing' AS direction, (n_nationkey * 3) % 25 AS other FROM nation UNION ALL SELECT ((n_nationkey * 3) % 25)::INT, 'incoming', n_nationkey FROM nation")
def jn_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey")
    edges = n.select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") * 3 % 25).alias("b"))
    return joins.either_way(n, edges, "n_nationkey", "a", "b")


CHAIN_SQL = """
    WITH m AS (SELECT l_suppkey, first(l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS material, min(l_orderkey) AS contract FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1),
         p AS (SELECT p_partkey, p_name AS product FROM part WHERE p_size > 5), o AS (SELECT o_orderkey, o_orderstatus AS agreement FROM orders WHERE o_orderkey % 4 <> 0)
    SELECT s_suppkey, material, product, agreement, CASE WHEN material IS NULL THEN 'material' WHEN product IS NULL THEN 'product' WHEN agreement IS NULL THEN 'agreement' END AS broken
    FROM supplier LEFT JOIN m ON s_suppkey = l_suppkey LEFT JOIN p ON material = p_partkey LEFT JOIN o ON contract = o_orderkey"""


@register("jn_18_scenario_chain", CHAIN_SQL)
def jn_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").filter("l_partkey % 3 <> 0").select("l_suppkey", F.col("l_partkey").alias("material"), F.col("l_orderkey").alias("contract"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("row"))
    first = joins.first_match(lines, "l_suppkey", "row", "material", "contract")
    products = read(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("material"), F.col("p_name").alias("product"))
    agreements = read(spark, sf_dir, "orders").filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("contract"), F.col("o_orderstatus").alias("agreement"))
    chain = read(spark, sf_dir, "supplier").join(first, F.col("s_suppkey") == F.col("l_suppkey"), "left").join(products, "material", "left").join(agreements, "contract", "left")
    broken = joins.broken_at(("material", F.col("material")), ("product", F.col("product")), ("agreement", F.col("agreement")))
    return chain.select("s_suppkey", "material", "product", "agreement", broken.alias("broken"))


@register("jn_19_manifest_differences", "SELECT k, CASE WHEN a IS NULL THEN 'unexpected' ELSE 'omitted' END AS what FROM (SELECT o_orderkey AS k, 1 AS a FROM orders WHERE o_orderkey % 7 <> 0) FULL JOIN (SELECT DISTINCT l_orderkey AS k, 1 AS b FROM lineitem WHERE l_orderkey % 11 <> 0) USING (k) WHERE a IS NULL OR b IS NULL")
def jn_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = read(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("p"))
    found = read(spark, sf_dir, "lineitem").filter("l_orderkey % 11 <> 0").select(F.col("l_orderkey").alias("k"), F.lit(1).alias("p")).distinct()
    return joins.audit(listed, found, ["k"], "p").filter("violation is not null").select("k", F.when(F.col("violation") == "MISSING", "omitted").otherwise("unexpected").alias("what"))


@register("jn_20_group_records", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def jn_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return read(spark, sf_dir, "lineitem").join(groups, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@register("jn_22_reconciled_owners", "SELECT l_orderkey, l_linenumber, CASE WHEN c IS NULL OR s IS NULL THEN 'UNRESOLVED_ENDPOINT' WHEN c <> s THEN 'OWNERS_DISAGREE' END AS reason, CASE WHEN c = s THEN c END AS owner FROM lineitem LEFT JOIN (SELECT p_partkey, p_size % 4 AS c FROM part WHERE p_partkey % 8 <> 0) ON p_partkey = l_partkey LEFT JOIN (SELECT p_partkey AS k, p_size % 4 AS s FROM part WHERE p_partkey % 8 <> 0) ON k = l_suppkey")
def jn_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = read(spark, sf_dir, "part").filter("p_partkey % 8 <> 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("owner"))
    return joins.reconciled(read(spark, sf_dir, "lineitem"), owners, "l_partkey", "l_suppkey", "id", "owner").select("l_orderkey", "l_linenumber", "reason", "owner")


@register("jn_23_vocabulary_lookup", "SELECT name, n_nationkey AS id, n_nationkey IS NULL AS missing FROM (SELECT n_name AS name FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 'ATLANTIS') LEFT JOIN nation ON name = n_name")
def jn_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    wanted = n.filter("n_nationkey < 5").select(F.col("n_name").alias("name")).unionByName(spark.createDataFrame([("ATLANTIS",)], "name string"))
    return joins.required(wanted, n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id")), ["name"])


# ---- aggregates

@register("agg_01_counts", "SELECT count(*) AS n, count(*) FILTER (WHERE starts_with(p_type, 'S')) AS n_prefix FROM part")
def agg_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_type").startswith("S")).alias("n_prefix"))


@register("agg_02_agreement", "SELECT o_custkey, count(DISTINCT v) AS n_values, CASE count(DISTINCT v) WHEN 0 THEN 'MISSING' WHEN 1 THEN 'AGREE' ELSE 'CONFLICT' END AS state FROM (SELECT o_custkey, nullif(o_orderpriority, '5-LOW') AS v FROM orders) GROUP BY 1")
def agg_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.agreement(read(spark, sf_dir, "orders").select("o_custkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("v")), ["o_custkey"], "v")


@register("agg_03_source_trust", "SELECT l_partkey, count(DISTINCT l_suppkey) AS systems, count(DISTINCT l_suppkey) >= 2 AS corroborated, round(avg(t), 10) AS mean_trust FROM (SELECT DISTINCT l_partkey, l_suppkey, CASE WHEN l_suppkey % 4 = 0 THEN 0.5 WHEN l_suppkey % 4 = 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS t FROM lineitem) GROUP BY 1")
def agg_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    trust = F.coalesce(F.get(F.array(F.lit(0.5), F.lit(2.0)), (F.col("l_suppkey") % 4).cast("int")), F.lit(1.0))
    systems = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().withColumn("t", trust)
    return systems.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("systems"), (F.count(F.lit(1)) >= 2).alias("corroborated"), F.round(F.avg("t"), 10).alias("mean_trust"))


@register("agg_04_net_score", "SELECT l_orderkey, round(coalesce(sum(l_discount) FILTER (WHERE l_returnflag = 'N'), 0) - coalesce(sum(l_tax) FILTER (WHERE l_returnflag = 'R'), 0), 6) + 0 AS score FROM lineitem GROUP BY 1")
def agg_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_discount", "l_tax")))
    cases = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(ordered.alias("i"))
    positive = F.transform(F.filter("i", lambda x: x["l_returnflag"] == "N"), lambda x: x["l_discount"])
    negative = F.transform(F.filter("i", lambda x: x["l_returnflag"] == "R"), lambda x: x["l_tax"])
    return cases.select("l_orderkey", (F.round(aggregates.net_score(positive, negative), 6) + F.lit(0.0)).alias("score"))


@register("agg_05_single_source", f"SELECT p_partkey, count(l_orderkey) AS n, count(l_orderkey) = 1 AS single FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND {VALID} AND l_shipdate > TIMESTAMP '1998-06-01' GROUP BY 1")
def agg_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = read(spark, sf_dir, "lineitem").filter(f"{VALID} AND l_shipdate > {AS_OF}").select(F.col("l_partkey").alias("p_partkey"))
    return aggregates.single_source(read(spark, sf_dir, "part").select("p_partkey"), valid, ["p_partkey"])


@register("agg_06_sourcing_status", "SELECT l_partkey, CASE WHEN l_partkey % 17 = 0 THEN 'INDETERMINATE' WHEN n = 0 THEN 'NO_QUALIFIED_SOURCE' WHEN n = 1 THEN 'SINGLE_SOURCE' ELSE 'DUAL_SOURCE' END AS status FROM (SELECT l_partkey, count(DISTINCT l_suppkey) FILTER (WHERE l_suppkey % 13 = 0) AS n FROM lineitem GROUP BY 1)")
def agg_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.collect_set("l_suppkey").alias("s"))
    n = F.size(F.filter("s", lambda x: x % 13 == 0))
    return arrays.select("l_partkey", aggregates.sourcing_status(n, F.col("l_partkey") % 17 != 0).alias("status"))


SEVERITY = "CASE l_linenumber % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MATERIAL' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END"


@register("agg_07_worst_severity", f"SELECT l_orderkey, max({SEVERITY}) AS by_text, ['LOW', 'MATERIAL', 'HIGH', 'CRITICAL'][max(list_position(['LOW', 'MATERIAL', 'HIGH', 'CRITICAL'], {SEVERITY}))] AS by_rank FROM lineitem GROUP BY 1")
def agg_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.expr(SEVERITY)).alias("s"))
    return s.select("l_orderkey", aggregates.worst(F.col("s")).alias("by_text"), aggregates.worst(F.col("s"), "rank").alias("by_rank"))


@register("agg_08_any", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS conflicting, bool_or(l_quantity > 45 AND l_linestatus = 'O') AS ready FROM lineitem GROUP BY 1")
def agg_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("conflicting"), F.bool_or((F.col("l_quantity") > 45) & (F.col("l_linestatus") == "O")).alias("ready"))


@register("agg_09_all_required", "SELECT l_orderkey, coalesce(bool_and(CASE WHEN l_linenumber % 2 = 0 THEN coalesce(CASE WHEN l_returnflag <> 'A' THEN l_quantity > 5 END, false) END), true) AS satisfied FROM lineitem GROUP BY 1")
def agg_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = F.when(F.col("l_returnflag") != "A", F.col("l_quantity") > 5)
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(aggregates.all_pass(passed, F.col("l_linenumber") % 2 == 0).alias("satisfied"))


@register("agg_11_by_stage", "SELECT o_custkey, o_orderstatus AS stage, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS items FROM orders GROUP BY ALL")
def agg_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = aggregates.by_stage(read(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "stage"), "o_custkey", "stage", "o_orderkey")
    return staged.select("o_custkey", "stage", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@register("agg_12_check_lists", "SELECT s_suppkey, concat_ws(',', CASE WHEN s_acctbal > 0 THEN 'balance' END, CASE WHEN s_nationkey < 12 THEN 'place' END) AS passed, concat_ws(',', CASE WHEN NOT s_acctbal > 0 THEN 'balance' END, CASE WHEN NOT s_nationkey < 12 THEN 'place' END) AS failed FROM supplier")
def agg_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = F.array(F.struct(F.lit("balance").alias("n"), (F.col("s_acctbal") > 0).alias("ok")), F.struct(F.lit("place").alias("n"), (F.col("s_nationkey") < 12).alias("ok")))
    names = lambda keep: F.array_join(F.transform(F.filter("c", keep), lambda x: x["n"]), ",")
    return read(spark, sf_dir, "supplier").withColumn("c", checks).select("s_suppkey", names(lambda x: x["ok"]).alias("passed"), names(lambda x: ~x["ok"]).alias("failed"))


@register("agg_13_grouped_in_order", "SELECT event_type, coalesce(list_position(['purchase', 'view', 'click', 'error'], event_type), 0)::BIGINT AS place, count(*) AS n FROM events GROUP BY ALL")
def agg_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(x) for x in ("purchase", "view", "click", "error")]), F.col("event_type"))
    return read(spark, sf_dir, "events").groupBy("event_type", place.alias("place")).agg(F.count(F.lit(1)).alias("n"))


@register("agg_14_impact_summary", "SELECT l_suppkey, count(DISTINCT l_partkey) AS materials, count(DISTINCT l_orderkey) AS products, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue FROM lineitem GROUP BY 1")
def agg_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("materials"), F.countDistinct("l_orderkey").alias("products"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("revenue"))


@register("agg_15_miscounted", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) <> 1")
def agg_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.miscounted(read(spark, sf_dir, "part"), ["p_name"])


@register("agg_16_counts_for_all", "SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY 1")
def agg_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return aggregates.counts_for_all(read(spark, sf_dir, "nation").select("n_nationkey"), rows, "n_nationkey")


@register("agg_17_next_number", "SELECT o_custkey, count(*) + 1 AS next_number FROM orders GROUP BY 1")
def agg_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) + 1).alias("next_number"))


# ---- ranking

@register("win_01_repeats_of_first", "SELECT * FROM (SELECT p_partkey, p_name, CAST(row_number() OVER w AS INT) AS place, first_value(p_partkey) OVER w AS first_place FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_partkey)) WHERE place > 1")
def win_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.repeats_of_first(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@register("win_02_best_candidate", "SELECT o_custkey, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def win_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best(read(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey")


@register("win_05_queue_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def win_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = -F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return ranking.places(read(spark, sf_dir, "orders").select("o_orderkey", age.alias("age")), ["age", "o_orderkey"], stored).select("o_orderkey", "place")


@register("win_06_latest_attempt", "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS o_orderkey, first(o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS o_orderstatus FROM orders GROUP BY 1")
def win_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = read(spark, sf_dir, "orders").withColumn("attempt", F.col("o_orderkey"))
    return temporal.current_as_of(attempts, ["o_custkey"], None, ["o_orderdate", "attempt"], ["o_orderkey", "o_orderstatus"])


@register("win_07_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 26 OFFSET 50")
def win_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.page(read(spark, sf_dir, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")], 50, 26).select("o_orderkey")


@register("win_08_last_per_tenant", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS rank FROM events) WHERE rank <= 3")
def win_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.last_per_key(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id", "rank")


@register("win_09_sorted_ids", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) AS ids FROM orders GROUP BY 1")
def win_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))), ",").alias("ids"))


@register("win_10_names_by_id", "SELECT l_suppkey, string_agg(p_name, ',' ORDER BY p_name) AS names FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 48) JOIN part ON p_partkey = l_partkey GROUP BY 1")
def win_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = read(spark, sf_dir, "lineitem").filter("l_quantity > 48").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return ranking.names_by_id(named, "l_suppkey", "p_partkey", "p_name").select("l_suppkey", F.array_join("names", ",").alias("names"))


@register("win_11_next_ordinal", "SELECT conv_id, bool_and(pos = turn) AS valid, least(coalesce(min(pos) FILTER (WHERE NOT good), 1000000), count(*)) AS resume_at FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, length(text) > 40 AS good FROM conversations) GROUP BY 1")
def win_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.next_ordinal(read(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text") > 40)


# ---- sets

@register("set_01_intersection", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(read(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")))


@register("set_02_subset_status", "SELECT n_regionkey, CASE WHEN bool_and(n_nationkey IN (SELECT s_nationkey FROM supplier)) THEN 'Published' ELSE 'Draft' END AS status FROM nation GROUP BY 1")
def set_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    marked = joins.required(read(spark, sf_dir, "nation"), there, ["n_nationkey"])
    return marked.groupBy("n_regionkey").agg(F.when(F.bool_or("missing"), "Draft").otherwise("Published").alias("status"))


@register("set_03_key_differences", "SELECT event_id, array_to_string(list_sort(list_filter(['user', 'type', 'value'], lambda x: NOT list_contains(k, x))), ',') AS missing, array_to_string(list_sort(list_filter(k, lambda x: NOT list_contains(['user', 'type', 'value'], x))), ',') AS unknown FROM (SELECT event_id, [CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'usr' END, event_type] AS k FROM events)")
def set_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(F.when(F.col("event_id") % 2 == 0, "user").otherwise("usr"), F.col("event_type"))
    wanted = F.array(*[F.lit(x) for x in ("user", "type", "value")])
    joined = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return read(spark, sf_dir, "events").select("event_id", joined(wanted, keys).alias("missing"), joined(keys, wanted).alias("unknown"))


@register("set_04_conditions_verified", "SELECT o_custkey, list_has_all(list(DISTINCT o_orderpriority), ['1-URGENT', '5-LOW']) AS satisfied FROM orders GROUP BY 1")
def set_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = F.array(F.lit("1-URGENT"), F.lit("5-LOW"))
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.size(F.array_except(conditions, F.collect_set("o_orderpriority"))) == 0).alias("satisfied"))


@register("set_05_except_both_ways", "(SELECT 'left' AS side, o_custkey AS k FROM orders EXCEPT ALL SELECT 'left', c_custkey FROM customer) UNION ALL (SELECT 'right', c_custkey FROM customer EXCEPT ALL SELECT 'right', o_custkey FROM orders)")
def set_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    side = lambda df, s: df.select(F.lit(s).alias("side"), "k")
    return side(a.exceptAll(b), "left").unionByName(side(b.exceptAll(a), "right"))


@register("set_06_union_all", "SELECT 'customer' AS kind, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier")
def set_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"))
    return c.unionByName(read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name")))


@register("set_07_array_sets", "SELECT l_orderkey, len(list_intersect(list(DISTINCT l_suppkey % 10), [1, 2, 3]))::INT AS common, len(list_filter(list(DISTINCT l_suppkey % 10), lambda x: x NOT IN (1, 2, 3)))::INT AS others FROM lineitem GROUP BY 1")
def set_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)])
    s = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 10).alias("s"))
    return s.select("l_orderkey", F.size(F.array_intersect("s", strong)).alias("common"), F.size(F.array_except("s", strong)).alias("others"))
