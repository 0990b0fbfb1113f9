"""ER: entity resolution with suppliers as cases, each represented by three source systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import text
from quorumlake.operators import policy, resolution, temporal
from quorumlake.plans.registry import register
from quorumlake.plans.tables import read, stored

K = "s_suppkey"
REPRESENTATIONS = f"""
    inline(array(
      named_struct('source_system_name', 'CRM', 'display_name', s_name, 'website_domain', 'www.s' || {K} || '.com', 'country', 'tw', 'postal_code', string(null), 'tax', 'T' || {K}, 'parent_entity_name', if({K} % 6 = 0, 'Hold Co', null)),
      named_struct('source_system_name', 'ERP', 'display_name', s_name || ' Inc.', 'website_domain', if({K} % 5 = 0, 'x.com', 'https://s' || {K} || '.com/a'), 'country', if({K} % 7 = 0, 'us', 'TW'), 'postal_code', string(null), 'tax', CASE WHEN {K} % 11 = 0 THEN 'TX' WHEN {K} % 2 = 0 THEN 't' || {K} || ' ' ELSE '' END, 'parent_entity_name', string(null)),
      named_struct('source_system_name', 'REG', 'display_name', if({K} % 3 = 0, 'Other ' || s_name, s_name), 'website_domain', string(null), 'country', string(null), 'postal_code', if({K} % 4 = 0, '1 0', null), 'tax', '', 'parent_entity_name', string(null))))"""


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = read(spark, sf_dir, "supplier")
    r = s.select(F.col(K).alias("case_id"), F.expr(REPRESENTATIONS)).withColumns(
        {
            "strong_identifiers": F.array(F.struct(F.lit("STRONG_IDENTIFIER_TAX_REGISTRATION").alias("type"), F.col("tax").alias("value"))),
            "aliases": F.array().cast("array<string>"),
        }
        | {c: F.lit(None).cast("string") for c in ("trading_name", "acronym", "email_domain", "registered_address")}
    )
    candidates = s.select(F.col(K).alias("case_id"), F.concat("s_name", F.lit(" Ltd")).alias("candidate_name"), F.expr(f"if({K} % 9 = 0, 'DE', 'TW')").alias("candidate_country"), F.expr(f"if({K} % 12 = 0, 'Other Hold', null)").alias("candidate_parent_entity_name"))
    return r, candidates


FACTS = f"SELECT {K} AS case_id, {K} % 11 = 0 AS tax_conflict, {K} % 7 = 0 OR {K} % 9 = 0 AS country_conflict, {K} % 5 = 0 AS domain_conflict, {K} % 4 = 0 AS postal, {K} % 6 = 0 AS parent, {K} % 12 = 0 AS parent_conflict FROM supplier"
POLICIES = "(VALUES ('Conservative', 0.92, 0.55, 0.92, 0.6, true, true, true), ('Balanced', 0.85, 0.5, 0.85, 0.55, false, false, true), ('Exploratory', 0.75, 0.4, 0.75, 0.45, false, false, false)) p(policy, resolved, possible, high, medium, country_veto, country_veto2, parent_veto)"
DECIDED = f"""
    SELECT case_id, policy, CASE WHEN n_veto > 0 THEN 'Blocked Conflict' WHEN NOT review AND score >= resolved THEN 'Resolved' WHEN score >= possible THEN 'Possible Resolution' ELSE 'Unresolved' END AS outcome,
        CASE WHEN n_veto > 0 THEN 'Low' WHEN score >= high THEN 'High' WHEN score >= medium THEN 'Medium' ELSE 'Low' END AS confidence, score::DOUBLE AS score, n_veto
    FROM (SELECT *, CASE WHEN n_veto > 0 THEN 0 ELSE least(1.0, greatest(0.0, raw)) END AS score FROM (
        SELECT case_id, p.*, (tax_conflict::INT + (country_conflict AND country_veto)::INT + (parent_conflict AND parent_veto)::INT) AS n_veto,
            (country_conflict AND NOT country_veto) OR (parent_conflict AND NOT parent_veto) AS review,
            0.1 + 0.05 + 0.1 + 0.9 + (CASE WHEN domain_conflict THEN -0.35 ELSE 0.35 END) + (CASE WHEN country_conflict THEN -0.15 ELSE 0.15 END) + (CASE WHEN postal THEN 0.1 ELSE 0.0 END) AS raw
        FROM ({FACTS}) f, {POLICIES}))"""
EVIDENCE_SQL = f"""
    SELECT case_id, policy, evidence_type, classification FROM ({FACTS}) f, {POLICIES}, LATERAL (SELECT unnest([
        {{'evidence_type': 'LEGAL_NAME_MATCH', 'classification': 'POSITIVE'}}, {{'evidence_type': 'TRADING_NAME_MATCH', 'classification': 'MISSING'}}, {{'evidence_type': 'ALIAS_MATCH', 'classification': 'MISSING'}},
        {{'evidence_type': 'ACRONYM_MATCH', 'classification': 'POSITIVE'}}, {{'evidence_type': 'LEGAL_SUFFIX_NORMALIZED', 'classification': 'POSITIVE'}},
        {{'evidence_type': 'DOMAIN_VERIFIED', 'classification': CASE WHEN domain_conflict THEN 'NEGATIVE' ELSE 'POSITIVE' END}}, {{'evidence_type': 'EMAIL_DOMAIN_VERIFIED', 'classification': 'MISSING'}},
        {{'evidence_type': 'COUNTRY_MATCH', 'classification': CASE WHEN NOT country_conflict THEN 'POSITIVE' WHEN country_veto THEN 'VETO' ELSE 'NEGATIVE' END}}, {{'evidence_type': 'REGISTERED_ADDRESS_MATCH', 'classification': 'MISSING'}},
        {{'evidence_type': 'POSTAL_CODE_MATCH', 'classification': CASE WHEN postal THEN 'POSITIVE' ELSE 'MISSING' END}}, {{'evidence_type': 'STRONG_IDENTIFIER_LEI', 'classification': 'MISSING'}}, {{'evidence_type': 'STRONG_IDENTIFIER_EXTERNAL_ID', 'classification': 'MISSING'}},
        {{'evidence_type': 'STRONG_IDENTIFIER_TAX_REGISTRATION', 'classification': CASE WHEN tax_conflict THEN 'VETO' ELSE 'POSITIVE' END}}, {{'evidence_type': 'SOURCE_SYSTEM_CROSSWALK', 'classification': 'MISSING'}},
        {{'evidence_type': 'PARENT_SUBSIDIARY_DISTINCTION', 'classification': CASE WHEN NOT parent THEN 'MISSING' WHEN NOT parent_conflict THEN 'POSITIVE' WHEN parent_veto THEN 'VETO' ELSE 'NEGATIVE' END}},
        {{'evidence_type': 'SOURCE_SYSTEM_PROVENANCE', 'classification': 'POSITIVE'}}]) AS e), LATERAL (SELECT e.evidence_type AS evidence_type, e.classification AS classification)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = policy.presets(read(spark, sf_dir, "supplier"))
    return resolution.decide(resolution.evidence(*_cases(spark, sf_dir), policies), policies)


@register("er_05_evidence_profile", EVIDENCE_SQL)
def er_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = policy.presets(read(spark, sf_dir, "supplier"))
    return resolution.evidence(*_cases(spark, sf_dir), policies).select("case_id", "policy", "evidence_type", "classification")


@register("er_12_decide", DECIDED)
def er_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir)


COUNTRIES = "CASE WHEN case_id % 9 = 0 AND case_id % 7 = 0 THEN 'DE: candidate; TW: CRM; US: ERP' WHEN case_id % 9 = 0 THEN 'DE: candidate; TW: CRM, ERP' ELSE 'TW: CRM, candidate; US: ERP' END"
REASONS = f"""
    SELECT case_id, policy, concat_ws('|', country, tax, parent) AS triggered_veto,
        CASE WHEN coalesce(country, tax, parent) IS NULL THEN concat_ws('|', 'Strong identifier match: STRONG_IDENTIFIER_TAX_REGISTRATION', CASE WHEN n >= least_n THEN 'Corroborating non-name attributes: ' || n || ' (policy requires ' || least_n || ')' END,
            CASE WHEN review THEN 'Country or parent/subsidiary conflict forces steward review' END) ELSE '' END AS triggered_mandatory
    FROM (SELECT case_id, policy, CASE policy WHEN 'Conservative' THEN 3 WHEN 'Balanced' THEN 2 ELSE 1 END AS least_n,
        2 + (NOT domain_conflict)::INT + (NOT country_conflict)::INT + postal::INT + (parent AND NOT parent_conflict)::INT AS n,
        (country_conflict AND NOT country_veto) OR (parent_conflict AND NOT parent_veto) AS review,
        CASE WHEN country_conflict AND country_veto THEN 'Veto: COUNTRY_MATCH conflicts (' || {COUNTRIES} || ')' END AS country,
        CASE WHEN tax_conflict THEN 'Veto: STRONG_IDENTIFIER_TAX_REGISTRATION conflicts (CRM; ERP)' END AS tax,
        CASE WHEN parent_conflict AND parent_veto THEN 'Veto: PARENT_SUBSIDIARY_DISTINCTION conflicts (CRM)' END AS parent
        FROM ({FACTS}) f, {POLICIES})"""


@register("er_12_reasons", REASONS)
def er_12_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that a case triggers, as sentences; every case here triggers one, so they are its reasons too."""
    policies = policy.presets(read(spark, sf_dir, "supplier"))
    found = resolution.reasons(resolution.evidence(*_cases(spark, sf_dir), policies), policies)
    return found.select("case_id", "policy", F.array_join("triggered_veto", "|").alias("triggered_veto"), F.array_join("triggered_mandatory", "|").alias("triggered_mandatory"))


@register("er_09_masked_values", f"""
    SELECT case_id, evidence_type, CASE WHEN evidence_type = 'COUNTRY_MATCH' THEN CASE WHEN NOT country_conflict THEN 'TW' WHEN case_id % 9 = 0 AND case_id % 7 = 0 THEN 'DE,TW,US' WHEN case_id % 9 = 0 THEN 'DE,TW' ELSE 'TW,US' END WHEN tax_conflict THEN 'fp:conflict:0,fp:conflict:1' END AS said,
        CASE WHEN evidence_type = 'COUNTRY_MATCH' THEN CASE WHEN country_conflict THEN {COUNTRIES} ELSE 'CRM, ERP, candidate' END WHEN tax_conflict THEN 'CRM; ERP' WHEN case_id % 2 = 0 THEN 'CRM, ERP' ELSE 'CRM' END AS provenance
    FROM ({FACTS}) f, (SELECT unnest(['COUNTRY_MATCH', 'STRONG_IDENTIFIER_TAX_REGISTRATION']) AS evidence_type)""")
def er_09_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What countries and tax registrations were compared: of registrations that agree there is a fingerprint (not shown here), of others a mask."""
    kind = F.col("evidence_type")
    found = resolution.evidence(*_cases(spark, sf_dir), policy.presets(read(spark, sf_dir, "supplier"))).filter((F.col("policy") == "Balanced") & kind.isin("COUNTRY_MATCH", "STRONG_IDENTIFIER_TAX_REGISTRATION"))
    shown = (kind == "COUNTRY_MATCH") | (F.col("classification") == "VETO")
    return found.select("case_id", kind, F.when(shown, F.array_join("values", ",")).alias("said"), "provenance")



# every customer proposes a policy, some of them out of bounds
PROPOSED = "c_custkey, c_acctbal / 10000 AS resolved, (c_custkey % 13) / 10.0 AS possible, (c_custkey % 7) / 6.0 AS high, (c_custkey % 5) / 4.0 AS medium, c_custkey % 4 AS min_corroborating"


@register("er_13_policy_errors", f"""
    SELECT c_custkey, concat_ws(',', CASE WHEN high < medium THEN 'bands' END, CASE WHEN min_corroborating < 1 THEN 'corroborating' END, CASE WHEN resolved <= possible THEN 'order' END,
        CASE WHEN NOT (resolved BETWEEN 0 AND 1 AND possible BETWEEN 0 AND 1) THEN 'thresholds' END) AS errors FROM (SELECT {PROPOSED} FROM customer)""")
def er_13_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposed = read(spark, sf_dir, "customer").selectExpr(*PROPOSED.replace(".0 AS", ".0D AS").split(", "))
    return proposed.select("c_custkey", F.array_join(policy.policy_errors(), ",").alias("errors"))


ACTION = "CASE case_id % 4 WHEN 0 THEN 'CONFIRM' WHEN 1 THEN 'REJECT' WHEN 2 THEN 'UNRESOLVED' ELSE 'BLOCK' END"


@register("er_15_steward_action", f"""
    SELECT case_id, action, error, CASE WHEN error IS NULL THEN made END AS new_outcome, CASE WHEN error IS NULL THEN CASE action WHEN 'CONFIRM' THEN 'High' WHEN 'REJECT' THEN confidence ELSE 'Low' END END AS new_confidence, CASE WHEN error IS NULL AND action = 'CONFIRM' THEN entity_id END AS new_entity_id
    FROM (SELECT *, CASE WHEN action = 'CONFIRM' AND outcome = 'Blocked Conflict' THEN 'OVERRIDE_NOT_PERMITTED' WHEN action = 'CONFIRM' AND entity_id IS NULL THEN 'NO_CANDIDATE' WHEN action = 'BLOCK' AND outcome <> 'Blocked Conflict' THEN 'NO_CONFLICT' END AS error,
        CASE action WHEN 'CONFIRM' THEN 'Resolved' WHEN 'UNRESOLVED' THEN 'Unresolved' WHEN 'BLOCK' THEN 'Blocked Conflict' ELSE CASE WHEN outcome = 'Blocked Conflict' THEN outcome WHEN score >= 0.55 THEN 'Possible Resolution' ELSE 'Unresolved' END END AS made
        FROM (SELECT d.*, {ACTION} AS action, CASE WHEN case_id % 8 <> 0 THEN 'E' || case_id END AS entity_id FROM ({DECIDED}) d WHERE policy = 'Conservative'))""")
def er_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = _decided(spark, sf_dir).filter("policy = 'Conservative'")
    actions = read(spark, sf_dir, "supplier").select(F.col(K).alias("case_id")).select("case_id", F.expr(ACTION).alias("action"), F.expr("if(case_id % 8 <> 0, 'E' || case_id, null)").alias("entity_id"))
    return resolution.steward(decided, actions, F.lit(0.55))


@register("er_16_preview", f"WITH d AS ({DECIDED}) SELECT d.case_id, d.policy, d.outcome, d.outcome <> n.outcome AS would_change FROM d JOIN d n USING (case_id) WHERE d.policy <> 'Conservative' AND n.policy = 'Conservative'")
def er_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.preview(_decided(spark, sf_dir), "Conservative")


@register("er_17_case_queue", f"WITH d AS ({DECIDED}) SELECT d.case_id, d.outcome, n.outcome AS prior_outcome FROM d JOIN d n USING (case_id) WHERE d.policy = 'Conservative' AND n.policy = 'Balanced' AND d.outcome IN ('Possible Resolution', 'Unresolved', 'Blocked Conflict')")
def er_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _decided(spark, sf_dir).filter("policy in ('Balanced', 'Conservative')").withColumn("sequence", F.when(F.col("policy") == "Balanced", 1).otherwise(2))
    chained = temporal.with_prior(log, ["case_id"], ["sequence"], "outcome")
    return chained.filter(F.col("is_current") & F.col("outcome").isin("Possible Resolution", "Unresolved", "Blocked Conflict")).select("case_id", "outcome", F.col("prior").alias("prior_outcome"))


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = read(spark, sf_dir, "supplier")
    cases = p.select((F.col(K) % 10).alias("tenant_id"), F.col(K).alias("case_id"), F.expr(f"CASE {K} % 3 WHEN 0 THEN s_name WHEN 1 THEN upper(s_name) ELSE s_name || ' int' END").alias("name"), F.expr(f"if({K} % 20 = 0, 'forced', null)").alias("override_entity_id"))
    return cases, p.select((F.col(K) % 10).alias("tenant_id"), F.concat(F.lit("E"), F.col(K).cast("string")).alias("entity_id"), F.col("s_name").alias("entity_name"))


@register("er_01_candidates_by_name")
def er_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.candidates_by_name(*_named(spark, sf_dir), 0.65, stored)


@register("er_02_resolve_by_name")
def er_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, entities = _named(spark, sf_dir)
    return resolution.resolve_by_name(cases, resolution.needed_candidates(cases, entities, 0.65, 0.97, stored), resolved=0.97, high=0.9, medium=0.65)


@register("er_04_resolve_meanings")
def er_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, entities = _named(spark, sf_dir)
    return resolution.resolve_by_name(cases, resolution.needed_candidates(cases, entities, 0.9, 0.99, stored, keep_all=True), resolved=0.99, high=0.9, medium=0.65, keep_all=True)


@register("er_03_exact_names", f"SELECT {K} % 10 AS tenant_id, {K} AS case_id, 'E' || {K} AS entity_id FROM supplier WHERE {K} % 3 <> 2")
def er_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.candidates_by_name(*_named(spark, sf_dir), 1.0).select("tenant_id", "case_id", "entity_id")


@register("er_03_concept_candidates", f"""
    SELECT {K} % 10 AS tenant_id, {K} AS entity_id, CASE {K} % 4 WHEN 0 THEN 'Supplier' WHEN 1 THEN 'Risk Event' WHEN 2 THEN 'Material' END AS concept, 1.0::DOUBLE AS score FROM supplier WHERE {K} % 4 <> 3""")
def er_03_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's terms against the governed concepts of its tenant; a concept counts by its best term."""
    s, k = read(spark, sf_dir, "supplier"), F.col(K)
    terms = F.expr(f"CASE {K} % 4 WHEN 0 THEN array('vendor', ' SUPPLIER ') WHEN 1 THEN array('risk  event') WHEN 2 THEN array('Material', 'zzzz') ELSE array('qqqq') END")
    entities = s.select((k % 10).alias("tenant_id"), k.alias("entity_id"), F.explode(terms).alias("term"))
    concepts = spark.range(10).select(F.col("id").alias("tenant_id"), F.explode(F.array(*[F.lit(x) for x in ("Supplier", "Material", "Risk Event")])).alias("concept"))
    return resolution.concept_candidates(entities, concepts, 0.9)


@register("er_06_acronym", f"SELECT case_id, evidence_type, classification FROM ({EVIDENCE_SQL}) WHERE policy = 'Balanced' AND evidence_type IN ('ACRONYM_MATCH')")
def er_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return er_05(spark, sf_dir).filter("policy = 'Balanced' and evidence_type in ('ACRONYM_MATCH')").drop("policy")


@register("er_07_legal_suffix", f"SELECT case_id, evidence_type, classification FROM ({EVIDENCE_SQL}) WHERE policy = 'Balanced' AND evidence_type IN ('LEGAL_SUFFIX_NORMALIZED')")
def er_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return er_05(spark, sf_dir).filter("policy = 'Balanced' and evidence_type in ('LEGAL_SUFFIX_NORMALIZED')").drop("policy")


@register("er_08_agreement", f"SELECT case_id, evidence_type, classification FROM ({EVIDENCE_SQL}) WHERE policy = 'Balanced' AND evidence_type IN ('DOMAIN_VERIFIED','COUNTRY_MATCH','POSTAL_CODE_MATCH','EMAIL_DOMAIN_VERIFIED','REGISTERED_ADDRESS_MATCH')")
def er_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return er_05(spark, sf_dir).filter("policy = 'Balanced' and evidence_type in ('DOMAIN_VERIFIED','COUNTRY_MATCH','POSTAL_CODE_MATCH','EMAIL_DOMAIN_VERIFIED','REGISTERED_ADDRESS_MATCH')").drop("policy")


@register("er_09_strong_identifiers", f"SELECT case_id, evidence_type, classification FROM ({EVIDENCE_SQL}) WHERE policy = 'Balanced' AND evidence_type IN ('STRONG_IDENTIFIER_TAX_REGISTRATION','STRONG_IDENTIFIER_LEI','STRONG_IDENTIFIER_EXTERNAL_ID','SOURCE_SYSTEM_CROSSWALK')")
def er_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return er_05(spark, sf_dir).filter("policy = 'Balanced' and evidence_type in ('STRONG_IDENTIFIER_TAX_REGISTRATION','STRONG_IDENTIFIER_LEI','STRONG_IDENTIFIER_EXTERNAL_ID','SOURCE_SYSTEM_CROSSWALK')").drop("policy")


@register("er_10_parent", f"SELECT case_id, evidence_type, classification FROM ({EVIDENCE_SQL}) WHERE policy = 'Balanced' AND evidence_type IN ('PARENT_SUBSIDIARY_DISTINCTION')")
def er_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return er_05(spark, sf_dir).filter("policy = 'Balanced' and evidence_type in ('PARENT_SUBSIDIARY_DISTINCTION')").drop("policy")


@register("er_11_provenance", f"SELECT case_id, evidence_type, classification FROM ({EVIDENCE_SQL}) WHERE policy = 'Balanced' AND evidence_type IN ('SOURCE_SYSTEM_PROVENANCE')")
def er_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return er_05(spark, sf_dir).filter("policy = 'Balanced' and evidence_type in ('SOURCE_SYSTEM_PROVENANCE')").drop("policy")


@register("er_14_evaluate_with_override", f"SELECT case_id, CASE WHEN n_veto > 0 THEN 'Blocked Conflict' WHEN case_id % 5 = 0 THEN 'Resolved' ELSE outcome END AS outcome FROM ({DECIDED}) WHERE policy = 'Balanced'")
def er_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = _decided(spark, sf_dir).filter("policy = 'Balanced'")
    override = F.when((F.col("case_id") % 5 == 0) & (F.col("n_veto") == 0), "Resolved")
    return decided.select("case_id", policy.with_override(F.col("outcome"), override, F.lit(True)).alias("outcome"))


@register("jn_07_similar_pairs")
def jn_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return er_01(spark, sf_dir)


@register("jn_07_similar_names")
def jn_07_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of names themselves, each once, whatever number of cases and entities bear them."""
    cases, entities = _named(spark, sf_dir)
    a, b = cases.select("tenant_id", text.name_key(F.col("name")).alias("a")), entities.select("tenant_id", text.name_key(F.col("entity_name")).alias("b"))
    return resolution.similar_names(a, b, 0.65, keep=stored)
