"""Lookup tiers: how a term finds a concept (LKP01-LKP27).

Every tier is a join of the whole batch of terms with concepts reduced to one
row a key, the lowest id first, so repeated concept names never multiply rows.
``best`` then keeps the first tier's hit for each term.  Tiers are equi-joins;
"contains" joins on the rarest trigram of the term and verifies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv, normalize as nz
from ..functions.staging import staged


def first_by(concepts: DataFrame, key: Column) -> DataFrame:
    """(key, id): the lowest id of each key that isn't null or empty."""
    return concepts.select(key.alias("key"), "id").where("key IS NOT NULL AND key <> ''").groupBy("key").agg(F.min("id").alias("id"))


def equal(terms: DataFrame, concepts: DataFrame, query: Column, key: Column, tier: int, confidence: float, match_type: str) -> DataFrame:
    """(term_id, id, tier, confidence, match_type) of terms whose query equals a concept's key."""
    asked = terms.select("term_id", query.alias("q")).where("q <> ''")
    hits = asked.join(first_by(concepts, key), F.col("q") == F.col("key"))
    return _tagged(hits, tier, confidence, match_type)


def containing(terms: DataFrame, concepts: DataFrame, query: Column, key: Column, tier: int, confidence: float, match_type: str) -> DataFrame:
    """As equal, for keys that contain the query.

    A key that contains the query holds all its trigrams, so the pair meets on
    the query's rarest one.  Shorter queries meet on all their letters' first.
    """
    hits = contains_pairs(terms.select(query.alias("q")), concepts.select(key.alias("key"), "id"))
    least = hits.groupBy("q").agg(F.min("id").alias("id"))
    return _tagged(terms.select("term_id", query.alias("q")).join(least, "q"), tier, confidence, match_type)


def _grams(text: Column, n: int) -> Column:
    count = F.length(text) - n + 1
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def contains_pairs(queries: DataFrame, keyed: DataFrame, ids: tuple[str, ...] = ("id",)) -> DataFrame:
    """(q, key, *ids): the distinct keys, with their lowest ids, that contain each distinct query."""
    keys = keyed.where("key IS NOT NULL AND key <> ''").groupBy("key").agg(*[F.min(c).alias(c) for c in ids])
    asked = queries.select("q").where("q IS NOT NULL AND q <> ''").distinct()
    n = F.least(F.length("q"), F.lit(3))
    key_grams = keys.select("key", *ids, F.explode(F.concat(*(_grams(F.col("key"), k) for k in (1, 2, 3)))).alias("gram"))
    frequency = key_grams.groupBy("gram").agg(F.count("*").alias("n"))
    query_grams = asked.select("q", F.explode(F.when(n == 3, _grams(F.col("q"), 3)).otherwise(F.array("q"))).alias("gram"))
    rarest = query_grams.join(frequency, "gram", "left").groupBy("q").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(key_grams, "gram").where(F.contains("key", "q")).select("q", "key", *ids)


def _tagged(hits: DataFrame, tier: int, confidence: float, match_type: str) -> DataFrame:
    return hits.select("term_id", "id", F.lit(tier).alias("tier"), F.lit(float(confidence)).alias("confidence"), F.lit(match_type).alias("match_type"))


def best(tiers: list[DataFrame], keys: tuple[str, ...] = ("term_id",)) -> DataFrame:
    """One row a term: the first tier's, then the lowest id's.

    A minimum over structs, which tasks combine before the shuffle.
    """
    every = reduce(DataFrame.unionByName, tiers)
    rest = [c for c in every.columns if c not in (*keys, "tier", "id")]
    first = every.groupBy(*keys).agg(F.min(F.struct("tier", "id", *rest)).alias("m"))
    return first.select(*keys, "m.*")


def condition_tiers(terms: DataFrame, concepts: DataFrame, query: Column) -> list[DataFrame]:
    """LKP02, LKP03: active conditions by exact term, then by containing it."""
    active = concepts.where("is_active = 1")
    key = F.lower("term")
    return [equal(terms, active, query, key, 2, 1.0, "exact"), containing(terms, active, query, key, 3, 0.8, "partial")]


def lab_tiers(terms: DataFrame, concepts: DataFrame, query: Column) -> list[DataFrame]:
    """LKP04-LKP08: labs by term, normalised term, component, consumer name, then parts of names."""
    key = lambda c: F.lower(F.col(c))
    terms = staged(terms.select("term_id", query.alias("q"), nz.normalize_lab(query).alias("n")))  # the normaliser runs once a term
    query, normal, none = F.col("q"), F.col("n"), F.lit(None).cast("long")
    # names of both kinds have their trigrams in one index
    names = concepts.select(F.explode(F.array(*[F.struct(key(c).alias("key"), F.when(F.lit(c == "consumer_name"), F.col("id")).otherwise(none).alias("consumer"), F.when(F.lit(c != "consumer_name"), F.col("id")).otherwise(none).alias("part")) for c in ("consumer_name", "component", "display")])).alias("x")).select("x.*")
    held = staged(contains_pairs(terms.select(normal.alias("q")), names, ("consumer", "part")).groupBy("q").agg(F.min("consumer").alias("consumer"), F.min("part").alias("part")))
    met = terms.select("term_id", normal.alias("q")).join(held, "q")
    return [
        equal(terms, concepts, query, key("term"), 4, 1.0, "exact"),
        equal(terms, concepts, F.when(normal != query, normal), key("term"), 5, 0.95, "normalized"),
        equal(terms, concepts, normal, key("component"), 6, 0.9, "component"),
        _tagged(met.where("consumer IS NOT NULL").select("term_id", F.col("consumer").alias("id")), 7, 0.85, "consumer_name"),
        _tagged(met.where("part IS NOT NULL").select("term_id", F.col("part").alias("id")), 8, 0.7, "partial"),
        *lab_pattern_tiers(terms, concepts, normal),
    ]


def lab_pattern_tiers(terms: DataFrame, concepts: DataFrame, query: Column, first_tier: int = 9) -> list[DataFrame]:
    """LKP09: common components measured without a method, then "COMPONENT in SPECIMEN"."""
    no_method = concepts.where("method IS NULL OR method = ''")
    common = F.when(query.isin(*fv.COMMON_LAB_COMPONENTS), query)
    pattern = r"(?U)([\w\s]+) in ([\w\s]+)"
    asked = terms.select("term_id", F.trim(F.regexp_extract(query, pattern, 1)).alias("q"), F.trim(F.regexp_extract(query, pattern, 2)).alias("s"), F.regexp_like(query, F.lit(pattern)).alias("fits")).where("fits AND q <> ''")
    # distinct (component, specimen) pairs, as concepts repeat them
    keyed = concepts.select(F.lower("component").alias("key"), F.lower("specimen").alias("specimen"), "id").groupBy("key", "specimen").agg(F.min("id").alias("id"))
    pairs = contains_pairs(asked.select("q"), keyed.select("key", "id")).select("q", "key").distinct()
    hits = asked.join(pairs, "q").join(keyed, "key").where(F.contains("specimen", "s"))
    return [
        equal(terms, no_method, common, F.lower("component"), first_tier, 0.85, "common_component"),
        _tagged(hits.groupBy("term_id").agg(F.min("id").alias("id")), first_tier + 1, 0.8, "specimen_pattern"),
    ]


def drug_tiers(terms: DataFrame, concepts: DataFrame, query: Column) -> list[DataFrame]:
    """LKP11-LKP16: active drugs by term, normalised term, ingredient, brand, pattern, then parts of names."""
    active = concepts.where("is_active = 1")
    key = lambda c: F.lower(F.col(c))
    terms = staged(terms.select("term_id", query.alias("q"), nz.normalize_drug(query).alias("n")))
    query, normal = F.col("q"), F.col("n")
    partial = active.select("id", F.explode(F.array(key("term"), key("ingredient"), key("brand_name"))).alias("key"))
    return [
        equal(terms, active, query, key("term"), 11, 1.0, "exact"),
        equal(terms, active, normal, key("term"), 12, 0.95, "exact"),
        equal(terms, active, normal, key("ingredient"), 13, 0.9, "ingredient"),
        equal(terms, active, normal, key("brand_name"), 14, 0.9, "brand_name"),
        *drug_pattern_tiers(terms, active, normal, 15),
        containing(terms, partial, normal, F.col("key"), 17, 0.7, "partial"),
    ]


def drug_pattern_tiers(terms: DataFrame, active: DataFrame, query: Column, first_tier: int = 15) -> list[DataFrame]:
    """LKP15: "STRENGTH INGREDIENT", then the first part of a combination."""
    ingredient = F.lower("ingredient")
    strength = F.regexp_extract(query, r"(?U)(\d+\s*(?:mg|g|mcg|ml))\s+(\w+)", 2)
    combined = F.when(F.regexp_like(query, F.lit("[-/]")), F.trim(F.element_at(F.split(query, "[-/]"), 1)))
    return [equal(terms, active, strength, ingredient, first_tier, 0.85, "pattern_strength_ingredient"), containing(terms, active, combined, ingredient, first_tier + 1, 0.75, "pattern_combination")]


def custom_tier(terms: DataFrame, custom: DataFrame) -> DataFrame:
    """LKP01: (term_id, code, display) by the raw term, which is case-sensitive.

    custom: (term, code, display), one row a term.
    """
    return terms.join(custom, "term").select("term_id", "code", "display")


def synonym_queries(terms: DataFrame, synonyms: DataFrame, system: str, query: Column) -> DataFrame:
    """LKP20: (term_id, synonym_set, primary) of terms in a set that concerns the system.

    synonyms: (set_key, position, synonym).  The first set by set_key's place
    ``set_position`` wins; its member at position 0 is looked up instead.
    """
    parts = fv.SYNONYM_KEYS[system]
    concerned = synonyms.where(F.exists(nz.words(parts), lambda p: F.contains(F.lower("set_key"), p)) | F.endswith("set_key", F.lit("_syn")))
    primary = concerned.where("position = 0").select("set_key", F.col("synonym").alias("primary"))
    sets = concerned.join(primary, "set_key").groupBy("synonym").agg(F.min_by(F.struct("set_key", "primary"), F.struct("set_position", "set_key")).alias("m"))
    return terms.select("term_id", query.alias("q")).join(sets, F.col("q") == F.col("synonym")).select("term_id", F.col("m.set_key").alias("synonym_set"), "m.primary")


def abbreviation_queries(terms: DataFrame, query: Column) -> DataFrame:
    """LKP21: (term_id, position, expanded_term) of each expansion, in order of preference."""
    known = F.create_map(*[x for k, v in fv.ABBREVIATIONS.items() for x in (F.lit(k), nz.words(v))])
    return terms.select("term_id", F.posexplode(F.try_element_at(known, query)).alias("position", "expanded_term"))


def by_code(codes: DataFrame, concepts: DataFrame) -> DataFrame:
    """LKP17, LKP18: concepts with the asked codes; inactive ones are not found."""
    return codes.join(concepts.where("is_active = 1") if "is_active" in concepts.columns else concepts, "code")


def by_part(concepts: DataFrame, concept_parts: DataFrame, parts: DataFrame, part_type: str | None = None) -> DataFrame:
    """LKP19: concepts linked to each asked part_number, optionally of one type."""
    links = concept_parts.where(F.col("part_type") == part_type) if part_type else concept_parts
    return parts.join(links, "part_number").join(concepts, F.col("loinc_code") == F.col("code"))


def similar_labs(terms: DataFrame, concepts: DataFrame, limit: int = 10) -> DataFrame:
    """LKP22: (term_id, code, tier, rank): labs whose component contains the term, then those whose display does."""
    query = nz.normalize_lab(F.col("term"))
    found = []
    for tier, column in enumerate(("component", "display"), 1):
        pairs = contains_pairs(terms.select(query.alias("q")), concepts.select(F.lower(column).alias("key"), "id")).select("q", "key")
        rows = pairs.join(concepts.select(F.lower(column).alias("key"), "id", "code"), "key").select("q", "id", "code", F.lit(tier).alias("tier"))
        order = Window.partitionBy("q").orderBy("id")  # the first of each tier suffice
        found.append(rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= 2 * limit).drop("n"))
    once = found[0].unionByName(found[1]).groupBy("q", "code").agg(F.min(F.struct("tier", "id")).alias("m"))
    ranked = once.select("q", "code", "m.*").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("tier", "id"))).where(F.col("rank") <= limit)
    return terms.select("term_id", query.alias("q")).join(ranked, "q").select("term_id", "code", "tier", "rank")
