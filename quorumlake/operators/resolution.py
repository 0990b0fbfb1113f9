"""Entity resolution: candidates by name, evidence by attribute, outcome by policy.

Representations are rows of (case_id, source_system_name, display_name,
trading_name, aliases, acronym, website_domain, email_domain, country,
registered_address, postal_code, strong_identifiers array of (type, value),
parent_entity_name), candidates rows of (case_id, candidate_name,
candidate_country, candidate_parent_entity_name). Evidence is a long table, so
one grouped pass serves all cases, types and policies.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import buckets, text
from quorumlake.operators import policy
from quorumlake.operators.names import Keep, similar_names

# Evidence types in the order in which they are evaluated.
TYPES = (
    "LEGAL_NAME_MATCH", "TRADING_NAME_MATCH", "ALIAS_MATCH", "ACRONYM_MATCH", "LEGAL_SUFFIX_NORMALIZED", "DOMAIN_VERIFIED", "EMAIL_DOMAIN_VERIFIED", "COUNTRY_MATCH",
    "REGISTERED_ADDRESS_MATCH", "POSTAL_CODE_MATCH", *policy.STRONG, "PARENT_SUBSIDIARY_DISTINCTION", "SOURCE_SYSTEM_PROVENANCE",
)
NEGATIVE_TYPES = ("DOMAIN_VERIFIED", "EMAIL_DOMAIN_VERIFIED", "REGISTERED_ADDRESS_MATCH", "POSTAL_CODE_MATCH")
# What an explanation calls an attribute (other types by their own name), and how it words a positive finding.
LABELS = {
    "LEGAL_NAME_MATCH": "Legal Name",
    "TRADING_NAME_MATCH": "Trading Name",
    "ALIAS_MATCH": "Approved Alias",
    "DOMAIN_VERIFIED": "Website Domain",
    "EMAIL_DOMAIN_VERIFIED": "Business Email Domain",
    "COUNTRY_MATCH": "Country",
    "REGISTERED_ADDRESS_MATCH": "Registered Address",
    "POSTAL_CODE_MATCH": "Postal Code",
}
EXACT_NAME, AGREES = "%s matches the candidate exactly for: %s.", "%s agrees across: %s."
ACRONYM, SUFFIX = "Derived acronym '%s' matches: %s.", "A governed legal suffix was normalized for: %s."
PARENT, SYSTEMS = "Declared parent/subsidiary relationships are consistent with the candidate.", "%d independent source systems corroborate this case: %s."
VETO, STRONG_MATCH = "Veto: %s conflicts (%s)", "Strong identifier match: %s"
CORROBORATING, ONE_OF = "Corroborating non-name attributes: %d (policy requires %d)", "Policy requires one of: %s"
REVIEW, NOTHING = "Country or parent/subsidiary conflict forces steward review", "No positive, negative, or veto evidence was available."


#: By how many cases or entities a name is borne in one row of those that are compared.
BEARERS = 10
#: Scores down to which a case's best candidate is looked for, one after the other, before the threshold.
STEPS = (0.9, 0.8)


def _borne(rows: DataFrame, name: str, by: str, carried: str) -> DataFrame:
    """tenant_id, name and an array of those that bear it, about ``BEARERS`` a row."""
    parts = rows.groupBy("tenant_id", name).agg(F.ceil(F.count(F.lit(1)) / BEARERS).alias("_of"))
    part = F.pmod(F.xxhash64(by), F.col("_of")).alias("_part")
    return rows.join(parts.hint("merge"), ["tenant_id", name]).groupBy("tenant_id", name, part).agg(F.collect_list(F.struct(by)).alias(carried)).drop("_part")


def _keys(cases: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = cases.select("tenant_id", "case_id", text.name_key(F.col("name")).alias("a")).filter("a IS NOT NULL").distinct()
    return a, entities.select("tenant_id", "entity_id", text.name_key(F.col("entity_name")).alias("b")).filter("b IS NOT NULL").distinct()


def _by_each_name(a: DataFrame, b: DataFrame, threshold: float, keep: Keep) -> DataFrame:
    """tenant_id, case_id, entity_id, score of each pair of a name of a case and one of an entity."""
    found = similar_names(_borne(a, "a", "case_id", "by_a"), _borne(b, "b", "entity_id", "by_b"), threshold, keep=keep)
    found = found.select("tenant_id", "by_b", "score", F.inline("by_a")).select("tenant_id", "case_id", "score", F.inline("by_b"))
    return found.select("tenant_id", "case_id", "entity_id", "score")


def candidates_by_name(cases: DataFrame, entities: DataFrame, threshold: float, keep: Keep = lambda names: names) -> DataFrame:
    """tenant_id, case_id, entity_id, score: each case's best similarity to each entity, where it reaches ``threshold`` (ER-01, ER-03); ``keep`` stores indexed names.

    Names are compared with those that bear them, so pairs need no join, and only where a case or an entity has several
    names no grouping either: their number can be the square of what is read, and none of them is shuffled.
    """
    a, b = _keys(cases, entities)
    found = _by_each_name(a, b, threshold, keep)
    several = lambda rows, by: rows.groupBy("tenant_id", by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("n")
    if several(a, "case_id").unionByName(several(b, "entity_id")).isEmpty():
        return found
    return found.groupBy("tenant_id", "case_id", "entity_id").agg(F.max("score").alias("score"))


def needed_candidates(cases: DataFrame, entities: DataFrame, threshold: float, resolved: float, keep: Keep, keep_all: bool = False) -> DataFrame:
    """Of ``candidates_by_name`` those by which ``resolve_by_name`` decides: the best of each case without an override.

    They are looked for from the top: by equal names, then down to one score after another, each time only for cases that
    have none yet, so most pairs that are far apart are never scored. With ``keep_all`` a case that is not resolved by
    an equal name has all its candidates.
    """
    undecided = cases.filter("override_entity_id IS NULL").select("tenant_id", "case_id").distinct()
    left = cases.join(undecided.hint("merge"), ["tenant_id", "case_id"], "left_semi")
    best = lambda found: found.groupBy("tenant_id", "case_id").agg(F.min(F.struct((-F.col("score")).alias("low"), "entity_id")).alias("top")).select("tenant_id", "case_id", "top.entity_id", (-F.col("top.low")).alias("score"))
    steps = [1.0] * (resolved <= 1) if keep_all else [1.0, *(s for s in STEPS if s > threshold)]
    out = []
    for step in steps:
        out.append(keep(best(_by_each_name(*_keys(left, entities), step, keep))))
        left = left.join(out[-1].hint("merge"), ["tenant_id", "case_id"], "left_anti")
        if left.isEmpty():
            break
    else:
        out.append(candidates_by_name(left, entities, threshold, keep) if keep_all else best(_by_each_name(*_keys(left, entities), threshold, keep)))
    return functools.reduce(DataFrame.unionByName, out)


def concept_candidates(terms: DataFrame, concepts: DataFrame, threshold: float) -> DataFrame:
    """tenant_id, entity_id, concept, score: concepts by the best of an entity's terms, where it reaches ``threshold`` (ER-03).

    ``terms`` has tenant_id, entity_id, term; ``concepts`` tenant_id, concept.
    """
    cases = terms.select("tenant_id", F.col("entity_id").alias("case_id"), F.col("term").alias("name"))
    found = candidates_by_name(cases, concepts.select("tenant_id", F.col("concept").alias("entity_id"), F.col("concept").alias("entity_name")), threshold)
    return found.select("tenant_id", F.col("case_id").alias("entity_id"), F.col("entity_id").alias("concept"), "score")


def resolve_by_name(cases: DataFrame, found: DataFrame, *, resolved: float, high: float, medium: float, keep_all: bool = False) -> DataFrame:
    """tenant_id, case_id, entity_id, score, outcome, confidence of every case; an override decides (ER-02, ER-04).

    With ``keep_all`` a possible case names all its candidates instead of one.
    """
    one = F.struct((-F.col("score")).alias("low"), "entity_id")
    ranked = F.array_sort(F.collect_list(one)) if keep_all else F.array(F.min(one))
    best = found.groupBy("tenant_id", "case_id").agg(ranked.alias("ranked"))
    joined = cases.select("tenant_id", "case_id", "override_entity_id").distinct().join(best.hint("merge"), ["tenant_id", "case_id"], "left")
    top = F.get("ranked", F.lit(0))
    forced = F.col("override_entity_id").isNotNull()
    score = F.when(forced, 1.0).otherwise(F.coalesce(-top["low"], F.lit(0.0)))
    outcome = F.when(forced, "Resolved").when(top.isNull(), "Unresolved").when(score >= resolved, "Resolved").otherwise("Possible Resolution")
    named = F.when(F.lit(keep_all) & (outcome == "Possible Resolution"), F.array_join(F.transform("ranked", lambda x: x["entity_id"]), ","))
    entity = F.coalesce("override_entity_id", named, top["entity_id"])
    return joined.select("tenant_id", "case_id", entity.alias("entity_id"), score.alias("score"), outcome.alias("outcome"), buckets.confidence(score, high, medium).alias("confidence"))


def _present(value: Column) -> Column:
    return F.when(value != "", value)


def observations(representations: DataFrame, candidates: DataFrame) -> DataFrame:
    """case_id, evidence_type, source, value: what each source and the candidate say, null where nothing."""
    r = representations.join(candidates, "case_id")
    c = F.col
    target = text.canonical_name(c("candidate_name"))
    same = lambda value: F.when(text.canonical_name(value) == target, target)
    acronym = F.coalesce(text.letters_and_digits(_present(c("acronym"))), text.derived_acronym(c("display_name")))
    suffixed = lambda name: F.when(text.canonical_name(name) != text.name_key(name), "suffix")
    said = {
        "LEGAL_NAME_MATCH": same(c("display_name")),
        "TRADING_NAME_MATCH": same(_present(c("trading_name"))),
        "ALIAS_MATCH": F.when(F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: text.canonical_name(a) == target), target),
        "ACRONYM_MATCH": F.when(acronym == text.derived_acronym(c("candidate_name")), acronym),
        "LEGAL_SUFFIX_NORMALIZED": suffixed(c("display_name")),
        "DOMAIN_VERIFIED": text.domain(_present(c("website_domain"))),
        "EMAIL_DOMAIN_VERIFIED": text.domain(_present(c("email_domain"))),
        "COUNTRY_MATCH": text.country(_present(c("country"))),
        "REGISTERED_ADDRESS_MATCH": text.address(_present(c("registered_address"))),
        "POSTAL_CODE_MATCH": text.letters_and_digits(_present(c("postal_code"))),
        "PARENT_SUBSIDIARY_DISTINCTION": text.canonical_name(_present(c("parent_entity_name"))),
        "SOURCE_SYSTEM_PROVENANCE": c("source_system_name"),
    }
    say = lambda kind, value: F.struct(F.lit(kind).alias("evidence_type"), value.alias("value"))
    plain = r.select("case_id", c("source_system_name").alias("source"), F.inline(F.array(*[say(k, v) for k, v in said.items()])))
    one = representations.select("case_id", c("source_system_name").alias("source"), F.explode("strong_identifiers").alias("i")).filter("trim(i.value) <> ''")
    # identifiers are compared as they stand; registrations only by fingerprint
    key = F.when(c("i.type") == "STRONG_IDENTIFIER_TAX_REGISTRATION", text.fingerprint(c("i.value"))).otherwise(c("i.value"))
    strong = one.select("case_id", "source", c("i.type").alias("evidence_type"), key.alias("value"))
    own = candidates.select("case_id", F.lit("candidate").alias("source"), F.inline(F.array(say("COUNTRY_MATCH", text.country(_present(c("candidate_country")))), say("LEGAL_SUFFIX_NORMALIZED", suffixed(c("candidate_name"))))))
    return plain.unionByName(strong).unionByName(own)


def evidence(representations: DataFrame, candidates: DataFrame, policies: DataFrame, trust: dict[str, float] | None = None) -> DataFrame:
    """One row per case, policy and type (ER-05 to ER-11): case_id, policy, evidence_type, place, classification, contribution, sources, values, provenance.

    ``values`` are the normalized values; those of conflicting strong identifiers are masked as ``fp:conflict:i``.
    ``provenance`` names the sources, by value where they disagree; values of strong identifiers don't stand in it.
    """
    c = F.col
    spark = representations.sparkSession
    weight = F.create_map(*[F.lit(x) for pair in policy.WEIGHTS.items() for x in pair])
    weights = spark.createDataFrame([(k, i) for i, k in enumerate(TYPES)], "evidence_type string, place int")
    trusted = F.create_map(*[F.lit(x) for pair in (trust or {"": 1.0}).items() for x in pair])
    trust_of = F.when(c("evidence_type") == "SOURCE_SYSTEM_PROVENANCE", F.coalesce(trusted[c("value")], F.lit(1.0)))
    distinct = observations(representations, candidates).groupBy("case_id", "evidence_type", "value").agg(F.collect_set("source").alias("by"))
    grouped = distinct.groupBy("case_id", "evidence_type").agg(
        F.count("value").alias("n"),
        F.avg(trust_of).alias("trust"),
        F.array_sort(F.collect_set("value")).alias("values"),
        F.array_sort(F.collect_list(F.when(c("value").isNotNull(), F.struct("value", F.array_sort("by").alias("by"))))).alias("said"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(c("value").isNotNull(), c("by")))))).alias("sources"),
    )
    cases = candidates.select("case_id", text.canonical_name(_present(c("candidate_parent_entity_name"))).alias("parent"))
    every = cases.join(representations.select("case_id").distinct(), "case_id", "left_semi").crossJoin(F.broadcast(weights))  # 16 types
    full = every.join(grouped, ["case_id", "evidence_type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kind = c("evidence_type")
    p = full.crossJoin(F.broadcast(policies))  # a few policies
    conflict = F.when(kind.isin(*policy.STRONG), "VETO").when(kind == "COUNTRY_MATCH", F.when(c("country_conflict") == "veto", "VETO").otherwise("NEGATIVE")).when(kind.isin(*NEGATIVE_TYPES), "NEGATIVE").otherwise("POSITIVE")
    differs = F.coalesce(F.exists("values", lambda v: v != c("parent")), F.lit(False))
    found = (
        F.when(c("n") == 0, "MISSING")
        .when(kind == "SOURCE_SYSTEM_PROVENANCE", F.when(c("n") >= 2, "POSITIVE").otherwise("MISSING"))
        .when(kind == "PARENT_SUBSIDIARY_DISTINCTION", F.when(differs, F.when(c("parent_conflict") == "veto", "VETO").otherwise("NEGATIVE")).otherwise("POSITIVE"))
        .when(c("n") == 1, "POSITIVE")
        .otherwise(conflict)
    )
    own = F.coalesce(weight[kind], F.lit(0.0))
    adds = F.when(kind == "SOURCE_SYSTEM_PROVENANCE", F.least(F.lit(1.0), own * c("trust") * (c("n") - 1))).otherwise(own)
    contribution = F.when(found == "POSITIVE", adds).when(found == "NEGATIVE", -own).otherwise(0.0)
    none = F.array().cast("array<string>")
    parties = lambda x: F.array_join(x["by"], ", ")
    strong, many = kind.isin(*policy.STRONG), c("n") > 1
    by_value = F.transform("said", lambda x: F.concat(x["value"], F.lit(": "), parties(x)))
    differing = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("said", lambda x: x["value"] != c("parent")), lambda x: x["by"]))))
    provenance = (
        F.when(c("n") == 0, "none")
        .when(kind == "SOURCE_SYSTEM_PROVENANCE", F.array_join("values", ", "))
        .when(kind == "PARENT_SUBSIDIARY_DISTINCTION", F.array_join(F.when(differs, differing).otherwise(c("sources")), ", "))
        .when(many & strong, F.array_join(F.array_sort(F.transform("said", parties)), "; "))
        .when(many, F.array_join(by_value, "; "))
        .otherwise(F.array_join("sources", ", "))
    )
    masked = F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda i: F.concat(F.lit("fp:conflict:"), (i - 1).cast("string")))
    values = F.when(many & strong, masked).when(kind == "LEGAL_SUFFIX_NORMALIZED", F.coalesce("sources", none)).otherwise(F.coalesce("values", none))
    return p.select("case_id", "policy", kind, "place", found.alias("classification"), contribution.alias("contribution"), F.coalesce("sources", none).alias("sources"), values.alias("values"), provenance.alias("provenance"))


def explanation(kind: Column, values: Column, provenance: Column) -> Column:
    """What a positive item says (ER-12)."""
    label = F.coalesce(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[kind], kind)
    return (
        F.when(kind.isin("LEGAL_NAME_MATCH", "TRADING_NAME_MATCH", "ALIAS_MATCH"), F.format_string(EXACT_NAME, label, provenance))
        .when(kind == "ACRONYM_MATCH", F.format_string(ACRONYM, F.get(values, F.lit(0)), provenance))
        .when(kind == "LEGAL_SUFFIX_NORMALIZED", F.format_string(SUFFIX, provenance))
        .when(kind == "PARENT_SUBSIDIARY_DISTINCTION", F.lit(PARENT))
        .when(kind == "SOURCE_SYSTEM_PROVENANCE", F.format_string(SYSTEMS, F.size(values), provenance))
        .otherwise(F.format_string(AGREES, label, provenance))
    )


def reasons(items: DataFrame, policies: DataFrame) -> DataFrame:
    """case_id, policy, triggered_veto, triggered_mandatory, reasons of each profile: arrays of sentences (ER-12).

    Vetoes silence the other rules; where no rule was triggered the positive items explain themselves, in the types' order.
    """
    c = F.col
    said = F.when(c("classification") == "POSITIVE", explanation(c("evidence_type"), c("values"), c("provenance")))
    one = items.select("case_id", "policy", F.struct("place", "evidence_type", "classification", "provenance", said.alias("said")).alias("item"))
    profile = one.groupBy("case_id", "policy").agg(F.array_sort(F.collect_list("item")).alias("items")).join(F.broadcast(policies), "policy")  # a few policies
    of = lambda kind: F.filter("items", lambda x: x["classification"] == kind)
    strong = F.array_sort(F.transform(F.filter(of("POSITIVE"), lambda x: x["evidence_type"].isin(*policy.STRONG)), lambda x: x["evidence_type"]))
    other = F.size(F.filter(of("POSITIVE"), lambda x: ~x["evidence_type"].isin(*policy.NAME_ONLY)))
    review = F.exists(of("NEGATIVE"), lambda x: x["evidence_type"].isin(*policy.REVIEW_FORCING))
    rules = F.array(
        F.when(F.size(strong) > 0, F.format_string(STRONG_MATCH, F.array_join(strong, ", "))),
        F.when(other >= c("min_corroborating"), F.format_string(CORROBORATING, other, c("min_corroborating"))),
        F.when(c("strong_mandatory") & (F.size(strong) == 0), ONE_OF % ", ".join(sorted(policy.STRONG))),
        F.when(review, REVIEW),
    )
    veto = F.transform(of("VETO"), lambda x: F.format_string(VETO, x["evidence_type"], x["provenance"]))
    facts = profile.select(
        "case_id",
        "policy",
        veto.alias("triggered_veto"),
        F.when(F.size(veto) == 0, F.array_compact(rules)).otherwise(F.array().cast("array<string>")).alias("triggered_mandatory"),
        F.transform(of("POSITIVE"), lambda x: F.concat(x["evidence_type"], F.lit(": "), x["said"])).alias("plain"),
    )
    rule = F.concat("triggered_veto", "triggered_mandatory")
    why = F.when(F.size(rule) > 0, rule).when(F.size("plain") > 0, c("plain")).otherwise(F.array(F.lit(NOTHING)))
    return facts.select("case_id", "policy", "triggered_veto", "triggered_mandatory", why.alias("reasons"))


def decide(items: DataFrame, policies: DataFrame) -> DataFrame:
    """case_id, policy, outcome, confidence, score, n_veto of each profile under its policy (ER-12, ER-14).

    Contributions are added in the types' order, whatever order rows arrive in.
    """
    c = F.col
    ordered = F.array_sort(F.collect_list(F.struct("place", "evidence_type", "classification", "contribution")))
    profile = items.groupBy("case_id", "policy").agg(ordered.alias("items")).join(F.broadcast(policies), "policy")
    of = lambda kind: F.filter("items", lambda x: x["classification"] == kind)
    total = lambda kind: F.aggregate(of(kind), F.lit(0.0), lambda a, x: a + F.abs(x["contribution"]))
    score = buckets.clamp(F.round(total("POSITIVE") - total("NEGATIVE"), 12))
    veto = F.size(of("VETO"))
    strong = F.exists(of("POSITIVE"), lambda x: x["evidence_type"].isin(*policy.STRONG))
    corroborated = F.size(F.filter(of("POSITIVE"), lambda x: ~x["evidence_type"].isin(*policy.NAME_ONLY))) >= c("min_corroborating")
    review = F.exists(of("NEGATIVE"), lambda x: x["evidence_type"].isin(*policy.REVIEW_FORCING))
    automatic = ~review & (~c("strong_mandatory") | strong) & (strong | corroborated)
    facts = profile.select("case_id", "policy", "resolved", "possible", "high", "medium", veto.alias("n_veto"), F.when(veto > 0, 0.0).otherwise(score).alias("score"), automatic.alias("automatic"))
    outcome = (
        F.when(c("n_veto") > 0, "Blocked Conflict")
        .when(c("automatic") & (c("score") >= c("resolved")), "Resolved")
        .when(c("score") >= c("possible"), "Possible Resolution")
        .otherwise("Unresolved")
    )
    confidence = F.when(c("n_veto") > 0, "Low").when(c("score") >= c("high"), "High").when(c("score") >= c("medium"), "Medium").otherwise("Low")
    return facts.select("case_id", "policy", outcome.alias("outcome"), confidence.alias("confidence"), "score", "n_veto")


def steward(decided: DataFrame, actions: DataFrame, possible: Column) -> DataFrame:
    """What an action (CONFIRM, REJECT, UNRESOLVED, BLOCK) makes of a decided case, or why it isn't allowed (ER-15).

    ``actions`` has case_id, action, entity_id.
    """
    c = F.col
    j = decided.join(actions, "case_id")
    blocked = c("outcome") == "Blocked Conflict"
    error = F.when((c("action") == "CONFIRM") & blocked, "OVERRIDE_NOT_PERMITTED").when((c("action") == "CONFIRM") & c("entity_id").isNull(), "NO_CANDIDATE").when((c("action") == "BLOCK") & ~blocked, "NO_CONFLICT")
    made = (
        F.when(c("action") == "CONFIRM", "Resolved")
        .when(c("action") == "REJECT", F.when(blocked, "Blocked Conflict").when(c("score") >= possible, "Possible Resolution").otherwise("Unresolved"))
        .when(c("action") == "UNRESOLVED", "Unresolved")
        .when(c("action") == "BLOCK", "Blocked Conflict")
    )
    confidence = F.when(c("action") == "CONFIRM", "High").when(c("action") == "REJECT", c("confidence")).otherwise("Low")
    return j.select("case_id", "action", error.alias("error"), F.when(error.isNull(), made).alias("new_outcome"), F.when(error.isNull(), confidence).alias("new_confidence"), F.when(error.isNull() & (c("action") == "CONFIRM"), c("entity_id")).alias("new_entity_id"))


def preview(decided: DataFrame, current_policy: str) -> DataFrame:
    """Each case under the other policies, and whether its outcome would change (ER-16)."""
    now = decided.filter(F.col("policy") == current_policy).select("case_id", F.col("outcome").alias("current_outcome"))
    return decided.filter(F.col("policy") != current_policy).join(now, "case_id").select("case_id", "policy", "outcome", (F.col("outcome") != F.col("current_outcome")).alias("would_change"))
