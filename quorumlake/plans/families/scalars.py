"""SCL-*: scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import buckets, ids, questions, text
from quorumlake.operators.names import similar_names
from quorumlake.plans.registry import register
from quorumlake.plans.tables import read

# supplier names with endings and punctuation that normalisation must deal with
NAMES = "CASE s_suppkey % 6 WHEN 0 THEN s_name || ', Inc.' WHEN 1 THEN '  ' || s_name || '   Co.  Ltd' WHEN 2 THEN s_name || ' S.p.A.' WHEN 3 THEN upper(s_name) || ' LLC' WHEN 4 THEN s_name || ' & Sons Pte Ltd' ELSE s_name END"
SUFFIXES = "incorporated|corporation|co ltd|pte ltd|company|limited|l l c|s p a|gmbh|corp|inc|ltd|llc|plc|pte|spa|s a|co|sa|ag|nv|bv|kk"
KEY = "trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g'))"
CANONICAL = f"regexp_replace({KEY}, '(?:^| )(?:l l c|s p a|co ltd|pte ltd|{SUFFIXES})$', '')"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.expr(NAMES).alias("raw"))


@register("scl_01_squeeze", f"SELECT s_suppkey, regexp_replace(trim(lower(raw)), '\\s+', ' ', 'g') AS squeezed FROM (SELECT s_suppkey, {NAMES} AS raw FROM supplier)")
def scl_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("s_suppkey", text.squeeze(F.col("raw")).alias("squeezed"))


@register("scl_02_name_key", f"SELECT s_suppkey, {KEY} AS name_key FROM (SELECT s_suppkey, {NAMES} AS raw FROM supplier)")
def scl_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("s_suppkey", text.name_key(F.col("raw")).alias("name_key"))


@register("scl_03_without_suffix", f"SELECT s_suppkey, regexp_replace(k, '(?:^| )(?:l l c|s p a|co ltd|pte ltd|{SUFFIXES})$', '') AS name FROM (SELECT s_suppkey, {KEY} AS k FROM (SELECT s_suppkey, {NAMES} AS raw FROM supplier))")
def scl_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("s_suppkey", text.without_suffix(text.name_key(F.col("raw"))).alias("name"))


@register("scl_04_canonical_name", f"SELECT s_suppkey, {CANONICAL} AS canonical FROM (SELECT s_suppkey, {NAMES} AS raw FROM supplier)")
def scl_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("s_suppkey", text.canonical_name(F.col("raw")).alias("canonical"))


@register("scl_05_derived_acronym", f"SELECT p_partkey, upper(array_to_string(list_transform(string_split({CANONICAL}, ' '), lambda w: substr(w, 1, 1)), '')) AS acronym FROM (SELECT p_partkey, p_name || ' Corp' AS raw FROM part)")
def scl_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", text.derived_acronym(F.concat("p_name", F.lit(" Corp"))).alias("acronym"))


@register("scl_06_acronym", "SELECT p_partkey, upper(regexp_replace(lower(p_brand || '-' || p_type), '[^a-z0-9]+', '', 'g')) AS acronym FROM part")
def scl_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", text.letters_and_digits(F.concat_ws("-", "p_brand", "p_type")).alias("acronym"))


@register("scl_07_domain", "SELECT page_id, regexp_replace(string_split(regexp_replace(trim(lower(url)), '^[a-z]+://', ''), '/')[1], '^www\\.', '') AS domain FROM pages")
def scl_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.domain(F.col("url")).alias("domain"))


@register("scl_08_country", "SELECT doc_id, CASE WHEN length(c) = 2 THEN upper(c) ELSE c END AS country FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN trim(lower(lang || '  land')) ELSE lower(lang) END AS d, regexp_replace(d, '\\s+', ' ', 'g') AS c FROM documents)")
def scl_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("  land"))).otherwise(F.col("lang"))
    return read(spark, sf_dir, "documents").select("doc_id", text.country(raw).alias("country"))


@register("scl_09_address", "SELECT c_custkey, trim(regexp_replace(lower(c_name || ', ' || c_mktsegment || ' st. #' || c_nationkey), '[^a-z0-9]+', ' ', 'g')) AS address FROM customer")
def scl_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("c_name", F.lit(", "), "c_mktsegment", F.lit(" st. #"), F.col("c_nationkey").cast("string"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.address(raw).alias("address"))


@register("scl_10_postal_code", "SELECT c_custkey, upper(regexp_replace(lower(c_nationkey || '-ab ' || c_custkey), '[^a-z0-9]+', '', 'g')) AS postal FROM customer")
def scl_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("c_nationkey").cast("string"), F.lit("-ab "), F.col("c_custkey").cast("string"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.letters_and_digits(raw).alias("postal"))


@register("scl_11_fingerprint", "SELECT c_custkey, 'fp:' || substr(sha256(lower(trim(c_name))), 1, 12) AS fingerprint FROM customer")
def scl_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", text.fingerprint(F.col("c_name")).alias("fingerprint"))


@register("scl_12_similarity")
def scl_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_size").alias("tenant_id"), "p_name")
    named = lambda name: p.select("tenant_id", F.col("p_name").alias(name))
    found = similar_names(named("a"), named("b"), 0.8).filter("a < b")
    return found.join(named("a"), ["tenant_id", "a"]).join(named("b"), ["tenant_id", "b"]).select("a", "b", "score")


UUID5 = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1)::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""


@register("scl_13_stable_id", f"SELECT o_orderkey, {UUID5} AS id FROM (SELECT o_orderkey, sha1(unhex('{ids.NAMESPACE.hex}') || encode('order:' || o_orderkey)) AS h FROM orders)")
def scl_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", ids.stable_id("order", F.col("o_orderkey").cast("string")).alias("id"))


@register("scl_14_length_prefixed_id", f"SELECT event_id, {UUID5} AS id FROM (SELECT event_id, sha1(unhex('{ids.NAMESPACE.hex}') || encode(octet_length(encode(event_type)) || ':' || event_type || octet_length(encode(t)) || ':' || t)) AS h FROM (SELECT event_id, event_type, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS t FROM events))")
def scl_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", ids.uuid5(ids.length_prefixed(F.col("event_type"), ids.iso_time(F.col("ts")))).alias("id"))


@register("scl_15_members_key", "SELECT o_custkey, sha256(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR)) AS key FROM orders GROUP BY o_custkey")
def scl_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("m"))
    return members.select("o_custkey", ids.members_key(F.col("m")).alias("key"))


@register("scl_16_payload_digest", "SELECT event_id, sha256(props) AS digest FROM events")
def scl_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", ids.payload_digest(F.col("props")).alias("digest"))


SCORE = "CASE WHEN event_id % 97 = 0 THEN 1.5 ELSE greatest(0.0, least(1.0, value / 500)) END"


@register("scl_17_confidence", f"SELECT event_id, CASE WHEN s BETWEEN 0 AND 1 THEN CASE WHEN s >= 0.9 THEN 'High' WHEN s >= 0.65 THEN 'Medium' ELSE 'Low' END END AS confidence FROM (SELECT event_id, {SCORE} AS s FROM events)")
def scl_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", buckets.confidence(F.expr(SCORE)).alias("confidence"))


@register("scl_18_outcome", f"SELECT event_id, CASE WHEN s >= 0.9 THEN 'Established' WHEN s >= 0.65 THEN 'Candidate' ELSE 'Rejected' END AS outcome FROM (SELECT event_id, {SCORE} AS s FROM events)")
def scl_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", buckets.outcome(F.expr(SCORE), 0.9, 0.65).alias("outcome"))


STATE = "CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'Failed' ELSE 'Executing' END ELSE 'Completed' END"
CODE = "CASE o_orderkey % 7 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'IDENTITY_NOT_RESOLVED' WHEN 3 THEN 'CONDITIONALLY_APPROVED' WHEN 4 THEN 'DECISION_NOT_VALID' WHEN 5 THEN 'INDETERMINATE' ELSE NULL END"
TERMINAL_SQL = f"""
    SELECT o_orderkey,
      CASE WHEN state NOT IN ('Completed', 'Failed') THEN NULL WHEN state = 'Failed' THEN 'TECHNICAL_FAILURE' WHEN o_orderkey % 11 = 0 THEN 'BUSINESS_GATED'
           WHEN code IN ('APPROVED', 'CONDITIONALLY_APPROVED', 'REJECTED', 'INDETERMINATE') THEN code
           WHEN code IN ('EVIDENCE_INDETERMINATE', 'IDENTITY_NOT_RESOLVED', 'SEMANTICS_NOT_RESOLVED') THEN 'INDETERMINATE'
           WHEN o_custkey % 2 = 0 THEN 'BUSINESS_GATED' ELSE 'APPROVED' END AS store_class,
      CASE WHEN state NOT IN ('Completed', 'Failed') THEN 'IN_PROGRESS' WHEN state = 'Failed' THEN 'TECHNICAL_FAILURE'
           WHEN code IN ('APPROVED', 'CONDITIONALLY_APPROVED', 'REJECTED', 'INDETERMINATE') THEN code
           WHEN code IN ('EVIDENCE_INDETERMINATE', 'IDENTITY_NOT_RESOLVED', 'SEMANTICS_NOT_RESOLVED') THEN 'INDETERMINATE' ELSE 'BUSINESS_GATED' END AS api_class
    FROM (SELECT o_orderkey, o_custkey, {STATE} AS state, {CODE} AS code FROM orders)"""


@register("scl_19_terminal_class", TERMINAL_SQL)
def scl_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr(STATE).alias("state"), F.expr(CODE).alias("code"))
    return o.select(
        "o_orderkey",
        buckets.terminal_class(F.col("state"), F.col("o_orderkey") % 11 != 0, F.col("code"), F.col("o_custkey") % 2 != 0).alias("store_class"),
        buckets.api_class(F.col("state"), F.col("code")).alias("api_class"),
    )


QUESTION = "CASE s_suppkey % 4 WHEN 0 THEN 'Which products depend on ' || s_name || '?' WHEN 1 THEN '  which PRODUCT  depends on \"' || s_name || '\" ?!' WHEN 2 THEN 'What is the evidence status of Legal Name in ' || s_name || '.' ELSE 'How many products has ' || s_name || '?' END"


@register("scl_20_parse_question", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 2 THEN 'INFORMATION_ELEMENT_CONTEXT_EXPLANATION' WHEN 3 THEN 'UNSUPPORTED' ELSE 'PRODUCTS_DEPENDING_ON_SUPPLIER' END AS intent, CASE WHEN s_suppkey % 4 < 2 THEN s_name END AS entity, CASE WHEN s_suppkey % 4 = 2 THEN 'Legal Name' END AS element, CASE WHEN s_suppkey % 4 = 2 THEN s_name END AS blueprint FROM supplier")
def scl_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select("s_suppkey", questions.parse_question(F.expr(QUESTION)).alias("q")).select("s_suppkey", "q.*")


ANSWER_SQL = """
    WITH n AS (SELECT s_suppkey, s_name, list_sort(list(DISTINCT p_name) FILTER (WHERE p_name IS NOT NULL)) AS names
               FROM supplier LEFT JOIN (SELECT l_suppkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey) ON l_suppkey = s_suppkey GROUP BY ALL)
    SELECT s_suppkey, CASE WHEN coalesce(len(names), 0) = 0 THEN 'The catalogue found 0 products connected to ' || s_name || ' through governed ontology relationships.'
        WHEN len(names) = 1 THEN '1 product depends on ' || s_name || ':' || chr(10) || '- ' || names[1]
        ELSE len(names) || ' products depend on ' || s_name || ':' || chr(10) || array_to_string(list_transform(names, lambda x: '- ' || x), chr(10)) END AS answer FROM n"""


@register("scl_21_products_answer", ANSWER_SQL)
def scl_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    named = lines.join(read(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    s = read(spark, sf_dir, "supplier").join(named, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return s.select("s_suppkey", questions.products_answer(F.col("s_name"), F.coalesce("names", F.array().cast("array<string>"))).alias("answer"))


@register("scl_22_path_text", "SELECT n_nationkey, 'Supplier → locatedIn → ' || n_name || ' → partOf → ' || r_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def scl_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    step = lambda a, r, b: F.struct(a.alias("source"), F.lit(r).alias("relation"), b.alias("target"))
    return joined.select("n_nationkey", questions.path_text(F.array(step(F.lit("Supplier"), "locatedIn", F.col("n_name")), step(F.col("n_name"), "partOf", F.col("r_name")))).alias("path"))


@register("scl_23_json_round_trip", "SELECT c_custkey, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer")
def scl_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")))
    return read(spark, sf_dir, "customer").select("c_custkey", F.from_json(record, "name string, nation int, balance double").alias("r")).select("c_custkey", "r.*")


@register("scl_24_mean_score", "SELECT l_suppkey, round_even(avg(l_discount * 10), 4) AS mean_score, avg(l_discount * 10) = 1.0 AS passed FROM (SELECT l_suppkey, round(l_discount * 64) / 64 AS l_discount FROM lineitem) GROUP BY l_suppkey")
def scl_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.round(F.col("l_discount") * 64) / 64).alias("d"))  # noqa: E741  binary fractions: exact sums
    return l.groupBy("l_suppkey").agg(F.bround(F.avg(F.col("d") * 10), 4).alias("mean_score"), (F.avg(F.col("d") * 10) == 1.0).alias("passed"))


@register("scl_25_corroboration", "SELECT l_partkey, least(1.0, 0.125 * (count(DISTINCT l_suppkey) - 1))::DOUBLE AS contribution FROM lineitem GROUP BY l_partkey")
def scl_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    systems = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n"))
    return systems.select("l_partkey", buckets.corroboration(0.25, F.lit(0.5), F.col("n")).alias("contribution"))


@register("scl_26_eligible", "SELECT s_suppkey, s_acctbal > 0 AND s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0 AND s_nationkey <> 3 AS eligible FROM supplier")
def scl_26(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [F.col("s_acctbal") > 0, F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 5 != 0, F.col("s_nationkey") != 3]
    return read(spark, sf_dir, "supplier").select("s_suppkey", buckets.eligible(*flags).alias("eligible"))


@register("scl_27_retention_deadline", "SELECT o_orderkey, o_orderdate + INTERVAL 2555 DAY AS keep_until, o_orderdate + INTERVAL 2557 DAY AS keep_audit_until FROM orders")
def scl_27(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", buckets.retention_deadline(at).alias("keep_until"), buckets.retention_deadline(at, 365 * 7 + 2).alias("keep_audit_until"))


@register("scl_28_poll_delay", "SELECT event_id, least(30000, 5000 * greatest(1, (event_id % 9)::INT)) AS delay_ms FROM events")
def scl_28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", buckets.poll_delay_ms((F.col("event_id") % 9).cast("int")).alias("delay_ms"))


@register("scl_29_outcome_label", "SELECT o_orderpriority AS raw, replace(lower(replace(o_orderpriority, '-', '_')), '_', ' ') AS label, count(*) AS n FROM orders GROUP BY ALL")
def scl_29(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = text.outcome_label(F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit("_")))
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("raw"), label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("scl_30_money_label", "SELECT o_custkey, '$' || CAST(floor(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / 1000000 + 0.5) AS BIGINT) || 'M' AS label FROM orders GROUP BY o_custkey")
def scl_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(buckets.millions_label(total).alias("label"))


@register("scl_31_claim_values", "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name || ' ' || p_name, ' '))), ',') AS claims FROM part")
def scl_31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(text.claim_values(F.concat("p_name", F.lit("  "), "p_name")), ",").alias("claims"))
