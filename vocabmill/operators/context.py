"""Clinical context: modifiers, domains and scores (CTX01-CTX14, NEG01-NEG02, FUZ06).

All are Column functions over a term, its context and a mapping's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import fixed_values as fv
from ..functions.normalize import words


def enhanced_score(score: Column, context: Column, kind: Column | str) -> Column:
    """CTX01, CTX02: the score, raised if the context holds a keyword of its kind; capped at 100.

    Keywords that hold capitals never match, as the context is lower-cased.
    An unknown kind counts as medical.
    """
    kind = F.lit(kind) if isinstance(kind, str) else kind
    default = None
    for name, (delta, keywords) in fv.CONTEXT_KEYWORDS.items():
        raised = F.when(F.exists(words(keywords), lambda k: F.contains(F.lower(context), k)), F.least(F.lit(100.0), score + delta)).otherwise(score)
        if default is None:
            default, out = raised, F.when(F.lit(False), raised)
        out = out.when(kind == name, raised)
    return F.when(score.isNull() | context.isNull() | (context == ""), score).otherwise(out.otherwise(default))


def _matches(text: Column, patterns) -> Column:
    return F.regexp_like(text, F.lit("|".join(patterns)))


def modifiers(text: Column) -> Column:
    """CTX03: the modifiers that a lower-cased text shows, in a fixed order."""
    found = F.array(*[F.when(_matches(text, p), F.lit(name)) for name, p in fv.MODIFIER_PATTERNS.items()])
    return F.filter(found, lambda m: m.isNotNull())


def domain_counts(text: Column) -> dict[str, Column]:
    return {name: sum((F.regexp_count(text, F.lit(p)) for p in patterns), F.lit(0)) for name, patterns in fv.DOMAIN_PATTERNS.items()}


def domain(text: Column) -> Column:
    """CTX04: the domain with most pattern matches, the first of equals; else general."""
    seen = [F.struct(n.alias("n"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, n) in enumerate(domain_counts(text).items())]
    none = F.struct(F.lit(0).alias("n"), F.lit(1).alias("place"), F.lit("general").alias("name"))  # above other zeros
    return F.when(text.isNotNull(), F.greatest(none, *seen)["name"])  # names each count once, however often the domain is asked for


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def context_confidence(text: Column, dom: Column, mods: Column) -> Column:
    """CTX05."""
    base = F.lit(0.5) + F.when(dom != "general", 0.2).otherwise(0.0) + F.least(F.lit(0.2), F.size(mods) * 0.1) + F.least(F.lit(1.0), word_count(text) / 20.0) * 0.1
    return F.least(F.lit(1.0), base)


def semantic_features(text: Column, term: Column) -> dict[str, Column]:
    """CTX06."""
    return {
        "word_count": word_count(text),
        "term_position": F.instr(F.lower(text), F.lower(term)) - 1,
        "medical_terms_count": F.regexp_count(text, F.lit(r"\b\w+(?:ology|itis|osis|pathy|graphy|scopy)\b")),
        "numeric_values": F.regexp_count(text, F.lit(r"\b\d+(?:\.\d+)?\s*(?:mg|ml|cm|mm|%|units?)\b")),
        "has_dosage": F.regexp_like(text, F.lit(r"\b\d+\s*(?:mg|ml|units?)\b")),
        "has_measurement": F.regexp_like(text, F.lit(r"\b\d+(?:\.\d+)?\s*(?:cm|mm|inches?|feet)\b")),
    }


def _preferred(dom: Column, system: Column) -> Column:
    """The factor of a preferred vocabulary, else null."""
    out = F.when(F.lit(False), F.lit(1.0))
    for name, (systems, factor) in fv.DOMAIN_BOOSTS.items():
        out = out.when((dom == name) & system.isin(*systems), F.lit(factor))
    return out


def enhanced_mapping(confidence: Column, match_type: Column, system: Column, dom: Column, mods: Column) -> dict[str, Column]:
    """CTX07: confidence and match_type after domain preference, negation and uncertainty."""
    factor = _preferred(dom, system)
    negated, unsure = F.array_contains(mods, "negation"), F.array_contains(mods, "uncertainty")
    raised = F.when(factor.isNotNull(), F.least(F.lit(1.0), confidence * factor)).otherwise(confidence)
    return {
        "confidence": raised * F.when(negated, 0.7).otherwise(1.0) * F.when(unsure, 0.9).otherwise(1.0),
        "match_type": F.concat(F.when(unsure, "uncertain_").otherwise(""), F.when(negated, "negated_").otherwise(""), F.when(factor.isNotNull(), "domain_enhanced_").otherwise(""), match_type),
    }


def context_score(found: Column, dom: Column, confidence: Column, mods: Column) -> Column:
    """CTX09."""
    raw = F.lit(0.5) + F.when(dom != "general", 0.2).otherwise(0.0) + confidence * 0.2 - F.when(F.array_contains(mods, "negation"), 0.3).otherwise(0.0) - F.when(F.array_contains(mods, "uncertainty"), 0.1).otherwise(0.0)
    return F.when(found, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(0.0)


def semantic_score(found: Column, match_type: Column, has_dosage: Column, has_measurement: Column) -> Column:
    """CTX10."""
    has = lambda part: F.contains(match_type, F.lit(part))
    base = F.when(has("exact"), 1.0).when(has("fuzzy") | has("partial"), 0.8).when(has("synonym"), 0.9).otherwise(0.6)
    raised = base + F.when(has_dosage & has("drug"), 0.1).otherwise(0.0) + F.when(has_measurement & has("measurement"), 0.1).otherwise(0.0)
    return F.when(found, F.least(F.lit(1.0), raised)).otherwise(0.0)


def domain_relevance(found: Column, system: Column, dom: Column) -> Column:
    """CTX11."""
    rest = F.when((system == "loinc") & (dom == "laboratory"), 0.95).when((system == "snomed") & dom.isin("cardiology", "endocrinology"), 0.85).when((system == "rxnorm") & (dom == "general"), 0.8).otherwise(0.5)
    return F.when(~found, 0.0).when(_preferred(dom, system).isNotNull(), 0.9).otherwise(rest)


def alternatives(mappings: Column, dom: Column, least: float = 0.5, most: int = 3) -> Column:
    """CTX12: of other mappings (structs system, code, display, confidence) those from ``least`` on, most relevant to the domain first, then most confident."""
    rated = F.transform(F.filter(mappings, lambda m: m.confidence >= least), lambda m: F.struct((-domain_relevance(F.lit(True), m.system, dom)).alias("r"), (-m.confidence).alias("c"), m.system.alias("system"), m.code.alias("code"), m.display.alias("display"), m.confidence.alias("confidence")))
    return F.transform(F.slice(F.array_sort(rated), 1, most), lambda m: F.struct(m.system.alias("system"), m.code.alias("code"), m.display.alias("display"), m.confidence.alias("confidence")))


def supported_score(score: Column, display: Column, context: Column, system: Column) -> dict[str, Column]:
    """FUZ06: +10, at most to 100, for each keyword of the display that the context supports."""
    bonus, term = F.lit(0), F.lit(None).cast("string")
    for name, table in fv.SUPPORTING_CONTEXT.items():
        for keyword, hints in table.items():
            hit = F.get(F.filter(words(hints), lambda h: F.contains(F.lower(context), h)), F.lit(0))
            on = (system == name) & F.contains(F.lower(display), F.lit(keyword)) & hit.isNotNull()
            bonus = bonus + F.when(on, 10).otherwise(0)
            term = F.when(on, hit).otherwise(term)
    return {"score": F.when(bonus > 0, F.least(F.lit(100.0), score + bonus)).otherwise(score), "context_term": term}


#: A negation cue rules the term if at most so many words lie between, with no terminator.
SCOPE_WORDS = 5
_CUE = r"(?:no evidence of|no signs? of|negative for|denies|denied|deny|without|ruled out|rules out|absence of|no|not|never)"
_STOP = r"(?:but|however|although|except|aside from|apart from|which|who)"


def negation_cue(context: Column, term: Column) -> Column:
    """NEG01: the cue that negates the term's first occurrence in its context, else null.

    NegEx (Chapman et al., 2001): a cue before the term within SCOPE_WORDS
    words, with no terminator, period or semicolon between.
    """
    at = F.instr(F.lower(context), F.lower(term))
    before = F.lower(F.substring(context, F.lit(1), at - 1))
    scope = F.array_join(F.slice(F.split(F.concat(F.lit("- - - - - - - - - "), F.element_at(F.split(before, r"[.;]"), -1)), r"\s+"), -(SCOPE_WORDS + 4), SCOPE_WORDS + 4), " ")
    clean = F.element_at(F.split(scope, rf"\b{_STOP}\b"), -1)
    cue = F.regexp_extract(clean, rf"\b({_CUE})\b(?:\s+\S+){{0,{SCOPE_WORDS}}}\s*$", 1)
    return F.when((at > 0) & (cue != ""), cue)


def negated_confidence(confidence: Column, cue: Column) -> Column:
    """NEG02."""
    return F.when(cue.isNotNull(), confidence * 0.3).otherwise(confidence)
