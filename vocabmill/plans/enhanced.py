"""Mapping with clinical context, negation and rules (CTX02, CTX08, CTX13, ENH01-ENH03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed_values import DOMAIN_BOOSTS
from ..functions.normalize import is_lab_term, normalize_term
from ..operators import context as cx, rules as ru

SYSTEM_ORDER = {"snomed": 0, "loinc": 1, "rxnorm": 2}
SYNONYM_SCORE = 95.0
FALLBACK, LEAST_FALLBACK = "context_aware_fuzzy", 0.6


def scored_in_context(terms: DataFrame, mappings: DataFrame) -> DataFrame:
    """CTX02, FUZ06: mappings with score, context_enhanced, context_term and the confidence that follows.

    terms: (term_id, term, context).  mappings: as map_terms returns.  Synonyms
    and fuzzy matches have a score, from 0 to 100; other mappings keep their
    confidence, however the context is.  Fuzzy matches but variations are first
    raised for keywords of their display that the context supports; what that
    doesn't touch is raised for the context's keywords of the vocabulary's
    kind: condition, medication, and for labs lab or measurement, as the term
    looks.
    """
    known = terms.select("term_id", F.coalesce("context", F.lit("")).alias("__context"), is_lab_term(normalize_term(F.col("term"))).alias("__lab"))
    rows = mappings.join(known, "term_id", "left")
    context = F.coalesce("__context", F.lit(""))
    score = F.when(F.col("via") == "synonym", SYNONYM_SCORE).when(F.col("via") == "fuzzy", F.col("confidence") * 100)
    supported = cx.supported_score(score, F.col("display"), context, F.col("system"))
    helped = F.coalesce((F.col("via") == "fuzzy") & (F.col("match_type") != "variation") & (context != "") & supported["context_term"].isNotNull(), F.lit(False))
    kind = F.when(F.col("system") == "snomed", "condition").when(F.col("system") == "rxnorm", "medication").when(F.col("__lab"), "lab").otherwise("measurement")
    told = F.coalesce(F.col("found") & (cx.enhanced_score(F.lit(0.0), context, kind) > 0), F.lit(False))
    final = F.when(helped, supported["score"]).otherwise(cx.enhanced_score(score, context, kind))
    rows = rows.withColumns({"score": final, "context_enhanced": helped | told, "context_term": F.when(helped, supported["context_term"])})
    return rows.withColumn("confidence", F.coalesce(F.col("score") / 100, F.col("confidence"))).drop("__context", "__lab")


def fallback(read: DataFrame, hits: DataFrame) -> DataFrame:
    """CTX08: (term_id, system, found, code, display, confidence, match_type) of terms by the vocabularies their domain prefers.

    read: (term_id, domain).  hits: (term_id, system, code, display, score),
    fuzzy matches scored from 0 to 100.  The domain's first vocabulary whose
    best hit has a confidence of 0.6 or more answers, with the domain's factor;
    terms of other domains have no fallback.
    """
    preferred = [(domain, system, place, float(factor)) for domain, (systems, factor) in DOMAIN_BOOSTS.items() for place, system in enumerate(systems)]
    order = read.sparkSession.createDataFrame(preferred, "domain string, system string, place int, factor double")
    near = hits.where(F.col("score") >= 100 * LEAST_FALLBACK)
    met = read.select("term_id", "domain").join(F.broadcast(order), "domain").join(near, ["term_id", "system"])
    best = met.groupBy("term_id").agg(F.min(F.struct("place", (-F.col("score")).alias("s"), "code", "display", "system", "factor")).alias("m"))
    confidence = F.least(F.lit(1.0), -F.col("m.s") / 100 * F.col("m.factor"))
    return best.select("term_id", "m.system", F.lit(True).alias("found"), "m.code", "m.display", confidence.alias("confidence"), F.lit(FALLBACK).alias("match_type"))


def with_context(terms: DataFrame, mappings: DataFrame, fuzzy_hits: DataFrame | None = None) -> DataFrame:
    """CTX13: one row a term: its best mapping after context, scores, and the other mappings.

    terms: (term_id, term, context[, domain_hint]).  mappings: as map_terms
    returns.  The best has most confidence; ties go to snomed, loinc, rxnorm.
    fuzzy_hits answer for terms without a mapping, see ``fallback``.
    """
    hint = F.col("domain_hint") if "domain_hint" in terms.columns else F.lit(None).cast("string")
    text = F.lower(F.concat_ws(" ", F.coalesce("context", F.lit("")), F.col("term")))
    read = terms.select("term_id", "term", F.col("context"), text.alias("text"), hint.alias("hint")).withColumn("modifiers", cx.modifiers(F.col("text"))).withColumn("domain", F.coalesce("hint", cx.domain(F.col("text"))))
    read = read.withColumn("context_confidence", cx.context_confidence(F.col("text"), F.col("domain"), F.col("modifiers")))
    if fuzzy_hits is not None:
        own = mappings.where("found").select("term_id", "system", "found", "code", "display", "confidence", "match_type")
        mappings = own.unionByName(fallback(read.join(own.select("term_id").distinct(), "term_id", "left_anti"), fuzzy_hits))
    place = F.create_map(*[x for k, v in SYSTEM_ORDER.items() for x in (F.lit(k), F.lit(v))])[F.col("system")]
    found = mappings.where("found").groupBy("term_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("s"), place.alias("place"), "system", "code", "display", "confidence", "match_type"))).alias("all"))
    rows = read.join(found, "term_id", "left")
    best = F.get("all", F.lit(0))
    rows = rows.withColumn("found", F.col("all").isNotNull()).withColumn("b", best)
    new = cx.enhanced_mapping(F.col("b.confidence"), F.col("b.match_type"), F.col("b.system"), F.col("domain"), F.col("modifiers"))
    features = cx.semantic_features(F.col("text"), F.col("term"))
    as_is = F.col("b.match_type") == FALLBACK  # its confidence has the domain's factor already
    rows = rows.withColumn("system", F.col("b.system")).withColumn("confidence", F.when(as_is, F.col("b.confidence")).otherwise(new["confidence"])).withColumn("match_type", F.when(as_is, FALLBACK).otherwise(new["match_type"]))
    scores = {
        "context_score": cx.context_score(F.col("found"), F.col("domain"), F.coalesce("confidence", F.lit(0.0)), F.col("modifiers")),
        "semantic_score": cx.semantic_score(F.col("found"), F.coalesce("match_type", F.lit("")), features["has_dosage"], features["has_measurement"]),
        "domain_relevance": cx.domain_relevance(F.col("found"), F.coalesce("system", F.lit("")), F.col("domain")),
    }
    alternatives = cx.alternatives(F.slice(F.col("all"), 2, F.greatest(F.size("all"), F.lit(1))), F.col("domain"))
    return rows.select(
        "term_id", "term", "context", "found", "system", F.col("b.code").alias("code"), F.col("b.display").alias("display"), "confidence", "match_type", "domain", "modifiers", "context_confidence",
        *[c.alias(n) for n, c in scores.items()], F.struct(*[c.alias(n) for n, c in features.items()]).alias("features"), alternatives.alias("alternatives"),
    )


def enhanced(terms: DataFrame, mappings: DataFrame, rules: DataFrame, negation: bool = True, use_rules: bool = True) -> DataFrame:
    """ENH01, ENH02: with_context, then rules and negation: (term_id, is_negated, negation_cue, domain, context_score, mappings, metadata).

    metadata: the scores, modifiers and features of the context, the other
    mappings, and the type of the rule that was applied.
    """
    read = with_context(terms, mappings)
    cue = cx.negation_cue(F.coalesce("context", F.lit("")), F.col("term")) if negation else F.lit(None).cast("string")
    base = F.when(F.col("found"), F.array(F.struct("code", "system", "display", "confidence", "match_type"))).otherwise(F.array().cast("array<struct<code:string,system:string,display:string,confidence:double,match_type:string>>"))
    about = F.struct("context_confidence", "semantic_score", "domain_relevance", "modifiers", "features", "alternatives")
    rows = read.select("term_id", base.alias("mappings"), cue.alias("negation_cue"), "domain", "context_score", about.alias("about"))
    listed = rows.select("term_id", "mappings")
    if use_rules:
        asked = read.select("term_id", "term", F.create_map(F.lit("domain"), F.col("domain")).alias("context"))
        listed = ru.apply(listed, ru.ranked(ru.matches(asked, rules), rules))
    joined = listed.join(rows.drop("mappings"), "term_id")
    lowered = F.transform("mappings", lambda m: m.withField("confidence", cx.negated_confidence(m.confidence, F.col("negation_cue"))))
    first = F.get("mappings", F.lit(0)).match_type
    rule = F.when(F.startswith(first, F.lit("rule_")), F.substring(first, 6, 100))
    return joined.select("term_id", F.col("negation_cue").isNotNull().alias("is_negated"), "negation_cue", "domain", "context_score", lowered.alias("mappings"), F.struct("about.*", rule.alias("rule_type")).alias("metadata"))
