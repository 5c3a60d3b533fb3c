"""The cascades of the three vocabularies over a batch of terms (LKP24-LKP28)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import normalize as nz
from ..functions.fixed_values import THRESHOLDS
from ..functions.staging import staged
from ..operators import fuzzy, lookup as lk

RESULT = ("term_id", "system", "found", "code", "display", "confidence", "match_type", "via")


def _named(hits: DataFrame, concepts: DataFrame, system: str, via: str) -> DataFrame:
    known = concepts.select("id", "code", "display")
    return hits.join(known, "id").select("term_id", F.lit(system).alias("system"), F.lit(True).alias("found"), "code", "display", "confidence", "match_type", F.lit(via).alias("via"), "tier")


def _looked_up(tiers, asked: DataFrame, concepts: DataFrame) -> DataFrame:
    """The best hit of each asked row; each distinct query is looked up once."""
    distinct = staged(asked.select(F.col("q").alias("term_id"), "q").distinct())
    hits = staged(lk.best(tiers(distinct, concepts, F.col("q"))))
    return asked.join(hits.withColumnRenamed("term_id", "q"), "q").select("term_id", "id", "tier", "confidence", "match_type")


def _through(queries: DataFrame, tiers, concepts: DataFrame, system: str, via: str, confidence: float) -> DataFrame:
    """Terms looked up as other words: queries (term_id, position, q)."""
    asked = queries.withColumn("__t", F.col("term_id")).withColumn("term_id", F.struct("__t", "position")).select("term_id", "q")
    hits = _looked_up(tiers, asked, concepts)
    first = hits.select(F.col("term_id.__t").alias("term_id"), F.struct(F.col("term_id.position").alias("position"), "id").alias("m")).groupBy("term_id").agg(F.min("m").alias("m"))
    return _named(first.select("term_id", "m.id", F.lit(0).alias("tier"), F.lit(confidence).alias("confidence"), F.lit(via).alias("match_type")), concepts, system, via)


def fuzzy_thresholds(changed: dict[str, float] | None = None) -> dict[str, float]:
    """FUZ08: the thresholds of the fuzzy tiers (difflib, jaccard, cosine) with the changed ones.

    The difflib tier can only be made stricter: below its own threshold its
    candidates would miss pairs.
    """
    own = {k: THRESHOLDS[k] for k in ("difflib", "jaccard", "cosine")}
    for name, value in (changed or {}).items():
        if name not in own or not 0 < value <= 1 or (name == "difflib" and value < own[name]):
            raise ValueError(f"threshold {name}={value} is not supported")
    return own | (changed or {})


def _fuzzy(left: DataFrame, concepts: DataFrame, system: str, least: dict[str, float]) -> DataFrame:
    """FUZ01 on the terms that nothing else found: variations, then difflib and tokens, then cosine."""
    indexed = staged(fuzzy.index(concepts))
    query = nz.clean(F.col("term"))
    exact = staged(fuzzy.by_variation(left, indexed).select("term_id", "code", "display", "score", F.lit("variation").alias("match_type")))
    rest = staged(left.join(exact, "term_id", "left_anti").withColumn("q", query))
    keys = indexed.select(F.col("variation").alias("key"))
    string = fuzzy.scored(rest, keys, {"difflib_ratio": least["difflib"]}, least=least["difflib"]).select("q", "key", (F.col("score") * 100).alias("score"), F.lit("levenshtein").alias("match_type"))
    tokens = fuzzy.token_jaccard(rest, keys, least["jaccard"]).select("q", "key", (F.col("jaccard") * 100).alias("score"), F.lit("token").alias("match_type"))
    angle = fuzzy.cosine(rest, fuzzy.tfidf(concepts.select(F.lower("term").alias("key"))), least["cosine"]).select("q", "key", (F.col("cosine") * 100).alias("score"), F.lit("cosine").alias("match_type"))
    top = string.unionByName(tokens).unionByName(angle).groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("s"), F.when(F.col("match_type") == "levenshtein", 0).when(F.col("match_type") == "token", 1).otherwise(2).alias("place"), "key", "match_type")).alias("m"))
    scored = rest.join(top, "q").select("term_id", F.col("m.key").alias("variation"), (-F.col("m.s")).alias("score"), "m.match_type").join(indexed, "variation").select("term_id", "code", "display", "score", "match_type")
    every = exact.unionByName(scored)
    return every.select("term_id", F.lit(system).alias("system"), F.lit(True).alias("found"), "code", "display", (F.col("score") / 100).alias("confidence"), "match_type", F.lit("fuzzy").alias("via"))


def map_terms(terms: DataFrame, concepts: dict[str, DataFrame], synonyms: DataFrame | None = None, custom: DataFrame | None = None, providers: list[DataFrame] | None = None, include_fuzzy: bool = True, thresholds: dict[str, float] | None = None) -> DataFrame:
    """The best mapping of each term in each vocabulary of ``concepts``; not-found rows included.

    terms: (term_id, term).  concepts: by system, with an id.  custom: (system,
    term, code, display).  providers answer drugs first and others last, as a
    remote service would.  thresholds: those of the fuzzy tiers that differ
    from the defaults, see fuzzy_thresholds.  Blank terms are not found.  Confidence and match
    type are those of the tier that hit.
    """
    if not concepts:
        raise ValueError("no vocabulary is given")
    least = fuzzy_thresholds(thresholds)
    tiers = {"snomed": lk.condition_tiers, "loinc": lk.lab_tiers, "rxnorm": lk.drug_tiers}
    asked = staged(terms.select("term_id", "term", nz.normalize_term(F.col("term")).alias("q")).where("q <> ''"))

    def one(system: str) -> DataFrame:
        own, steps = concepts[system], []
        if custom is not None:
            hits = lk.custom_tier(asked, custom.where(F.col("system") == system))
            steps.append(hits.select("term_id", F.lit(system).alias("system"), F.lit(True).alias("found"), "code", "display", F.lit(1.0).alias("confidence"), F.lit("custom").alias("match_type"), F.lit("custom").alias("via"), F.lit(-3).alias("tier")))
        if system == "snomed":
            expansions = lk.abbreviation_queries(asked, F.lower(F.trim("term"))).select("term_id", "position", F.col("expanded_term").alias("q"))
            steps.append(_through(expansions, tiers[system], own, system, "abbreviation", 0.95).withColumn("tier", F.lit(-2)))
        if synonyms is not None:
            primaries = lk.synonym_queries(asked, synonyms, system, F.col("q")).select("term_id", F.lit(0).alias("position"), F.col("primary").alias("q"))
            steps.append(_through(primaries, tiers[system], own, system, "synonym", 0.95).withColumn("tier", F.lit(-1)))
        if providers:
            from ..sources.remote import lookup

            systems = terms.sparkSession.createDataFrame([(system,)], "system string")
            remote = lookup(asked, providers, systems)
            steps.append(remote.select("term_id", "system", F.lit(True).alias("found"), "code", "display", "confidence", F.lit("exact").alias("match_type"), F.lit("provider").alias("via"), F.lit(-4 if system == "rxnorm" else 90).alias("tier")))
        steps.append(_named(_looked_up(tiers[system], asked, own), own, system, "lookup"))
        hits = staged(lk.best([s.withColumn("id", F.lit(0)) for s in steps]).drop("tier", "id").select(*RESULT))
        if include_fuzzy:
            left = staged(asked.join(hits, "term_id", "left_anti"))
            hits = hits.unionByName(_fuzzy(left, own, system, least).select(*RESULT))
        missing = terms.select("term_id").withColumn("system", F.lit(system)).join(hits.select("term_id"), "term_id", "left_anti")
        none = missing.select("term_id", "system", F.lit(False).alias("found"), *[F.lit(None).cast(t).alias(c) for c, t in zip(RESULT[3:], ("string", "string", "double", "string", "string"))])
        return hits.unionByName(none)

    # the vocabularies don't wait for each other: their steps are many small jobs
    with ThreadPoolExecutor(max(1, len(concepts))) as pool:
        found = list(pool.map(one, concepts))
    return reduce(DataFrame.unionByName, found)
