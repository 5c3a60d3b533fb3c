"""Lookups, cascades, graphs and fuzzy matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv, normalize as nz, similarity as sim
from ..operators import fuzzy as fz, graph as gr, lookup as lk
from ..plans.cascade import map_terms
from ..sources import remote
from . import base as b
from .text import drug_sql, lab_sql, term_sql, tokens_sql, variations_sql

SYNONYMS = [
    ("glucose_test", 0, 0, "glucose"), ("glucose_test", 0, 1, "blood sugar"), ("glucose_test", 0, 2, "ring"),
    ("mi_syn", 1, 0, "myocardial infarction"), ("mi_syn", 1, 1, "heart attack"), ("mi_syn", 1, 2, "myocardial infarct"),
    ("aspirin_drug", 2, 0, "aspirin"), ("aspirin_drug", 2, 1, "asa"),
    ("bolt_syn", 3, 0, "hot bolt"), ("bolt_syn", 3, 1, "zz hot gear"), ("plate_condition", 4, 0, "old plate"), ("plate_condition", 4, 1, "zz hot gear"),
]
CUSTOM = [("snomed", "headache", "X1", "Custom headache"), ("snomed", "HOT BOLT", "X2", "Custom bolt"), ("loinc", "hot bolt", "X3", "Custom lab"), ("rxnorm", "zestril", "X4", "Custom drug")]
SYN = f"synonyms AS (SELECT * FROM {b.values(SYNONYMS, 'set_key, set_position, position, synonym')})"
ASKED = f"{b.TERMS}, asked AS (SELECT term_id, term, {term_sql('term')} AS q FROM terms)"


def synonyms(spark):
    return b.literal(spark, SYNONYMS, "set_key string, set_position int, position int, synonym string")


def custom(spark):
    return b.literal(spark, CUSTOM, "system string, term string, code string, display string")


def asked(spark, d):
    return b.terms(spark, d).select("term_id", "term", nz.normalize_term(F.col("term")).alias("q")).where("q <> ''")


def _shown(hits, concepts):
    return hits.join(concepts.select("id", "code", "display"), "id").select("term_id", "code", "display", "confidence", "match_type")


def cascade_condition_top1(spark, d):
    """LKP02, LKP03, SRT01: each term's best active condition; terms without one stay, not found."""
    concepts, terms = b.conditions(spark, d), asked(spark, d)
    hits = _shown(lk.best(lk.condition_tiers(terms, concepts, F.col("q"))), concepts)
    return b.terms(spark, d).select("term_id").join(hits, "term_id", "left").select("term_id", F.col("code").isNotNull().alias("found"), "code", "display", "confidence", "match_type")


CONDITION_HITS = """condition_keys AS (SELECT lower(term) AS k, min(id) AS id FROM conditions WHERE is_active = 1 GROUP BY 1),
condition_tiers AS (
  SELECT term_id, id, 2 AS tier, 1.0::DOUBLE AS confidence, 'exact' AS match_type FROM asked JOIN condition_keys ON q = k WHERE q <> ''
  UNION ALL SELECT term_id, min(id), 3, 0.8, 'partial' FROM asked JOIN condition_keys ON contains(k, q) WHERE q <> '' GROUP BY term_id),
condition_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY tier, id) AS rn FROM condition_tiers) WHERE rn = 1)"""
CASCADE_SQL = f"""WITH {ASKED}, {b.CONDITIONS}, {CONDITION_HITS}
SELECT t.term_id, h.id IS NOT NULL AS found, c.code, c.display, h.confidence, h.match_type
FROM terms t LEFT JOIN condition_best h ON h.term_id = t.term_id LEFT JOIN conditions c ON c.id = h.id"""


def lkp01_custom(spark, d):
    return lk.custom_tier(b.terms(spark, d), custom(spark).where("system = 'snomed'"))


def lkp04_08_lab_cascade(spark, d):
    concepts, terms = b.labs(spark, d), asked(spark, d)
    return _shown(lk.best(lk.lab_tiers(terms, concepts, F.col("q"))), concepts)


LAB_HITS = f"""lab_asked AS (SELECT term_id, q, {lab_sql('q')} AS n FROM asked WHERE q <> ''),
lab_keys AS (SELECT id, lower(term) AS term, lower(component) AS component, lower(consumer_name) AS consumer, lower(display) AS display, lower(specimen) AS specimen, method FROM labs),
lab_parts AS (SELECT component AS k, min(id) AS id FROM lab_keys GROUP BY 1 UNION ALL SELECT display, min(id) FROM lab_keys GROUP BY 1),
lab_pattern AS (SELECT term_id, trim(regexp_extract(n, '([\\w\\s]+) in ([\\w\\s]+)', 1)) AS c, trim(regexp_extract(n, '([\\w\\s]+) in ([\\w\\s]+)', 2)) AS s FROM lab_asked WHERE regexp_matches(n, '([\\w\\s]+) in ([\\w\\s]+)')),
lab_tiers AS (
  SELECT term_id, min(id) AS id, 4 AS tier, 1.0::DOUBLE AS confidence, 'exact' AS match_type FROM lab_asked JOIN lab_keys ON q = term GROUP BY term_id
  UNION ALL SELECT term_id, min(id), 5, 0.95, 'normalized' FROM lab_asked JOIN lab_keys ON n = term AND n <> q AND n <> '' GROUP BY term_id
  UNION ALL SELECT term_id, min(id), 6, 0.9, 'component' FROM lab_asked JOIN lab_keys ON n = component AND n <> '' GROUP BY term_id
  UNION ALL SELECT term_id, min(id), 7, 0.85, 'consumer_name' FROM lab_asked JOIN (SELECT consumer, min(id) AS id FROM lab_keys GROUP BY 1) ON contains(consumer, n) AND n <> '' GROUP BY term_id
  UNION ALL SELECT term_id, min(id), 8, 0.7, 'partial' FROM lab_asked JOIN lab_parts ON contains(k, n) AND n <> '' GROUP BY term_id
  UNION ALL SELECT term_id, min(id), 9, 0.85, 'common_component' FROM lab_asked JOIN lab_keys ON n = component AND (method IS NULL OR method = '') WHERE n IN ({', '.join(map(b.quoted, fv.COMMON_LAB_COMPONENTS))}) GROUP BY term_id
  UNION ALL SELECT term_id, min(id), 10, 0.8, 'specimen_pattern' FROM lab_pattern JOIN (SELECT component, specimen, min(id) AS id FROM lab_keys GROUP BY 1, 2) ON contains(component, c) AND contains(specimen, s) AND c <> '' GROUP BY term_id),
lab_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY tier, id) AS rn FROM lab_tiers) WHERE rn = 1)"""


def lkp09_lab_patterns(spark, d):
    concepts, terms = b.labs(spark, d), asked(spark, d)
    terms = terms.select("term_id", F.regexp_replace("q", "^zz (.*) (.*)$", "$2 in l").alias("q"))
    return _shown(lk.best(lk.lab_pattern_tiers(terms, concepts, F.col("q"))), concepts)


LKP09_SQL = f"""WITH {b.TERMS}, asked AS (SELECT term_id, regexp_replace({term_sql('term')}, '^zz (.*) (.*)$', '\\2 in l') AS q FROM terms), {b.LABS},
k AS (SELECT id, lower(component) AS component, lower(specimen) AS specimen, method FROM labs),
p AS (SELECT term_id, trim(regexp_extract(q, '([\\w\\s]+) in ([\\w\\s]+)', 1)) AS c, trim(regexp_extract(q, '([\\w\\s]+) in ([\\w\\s]+)', 2)) AS s FROM asked WHERE regexp_matches(q, '([\\w\\s]+) in ([\\w\\s]+)')),
t AS (SELECT term_id, min(id) AS id, 9 AS tier, 0.85::DOUBLE AS confidence, 'common_component' AS match_type FROM asked JOIN k ON q = component AND (method IS NULL OR method = '') WHERE q IN ({', '.join(map(b.quoted, fv.COMMON_LAB_COMPONENTS))}) GROUP BY 1
  UNION ALL SELECT term_id, min(id), 10, 0.8, 'specimen_pattern' FROM p JOIN (SELECT component, specimen, min(id) AS id FROM k GROUP BY 1, 2) ON contains(component, c) AND contains(specimen, s) AND c <> '' GROUP BY term_id),
r AS (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY tier, id) AS rn FROM t)
SELECT r.term_id, c.code, c.display, r.confidence, r.match_type FROM r JOIN labs c ON c.id = r.id WHERE rn = 1"""


def lkp11_16_drug_cascade(spark, d):
    concepts, terms = b.drugs(spark, d), asked(spark, d)
    return _shown(lk.best(lk.drug_tiers(terms, concepts, F.col("q"))), concepts)


DRUG_HITS = f"""drug_asked AS (SELECT term_id, q, {drug_sql('q')} AS n FROM asked WHERE q <> ''),
drug_keys AS (SELECT id, lower(term) AS term, lower(ingredient) AS ingredient, lower(brand_name) AS brand FROM drugs WHERE is_active = 1),
drug_parts AS (SELECT term AS k, min(id) AS id FROM drug_keys GROUP BY 1 UNION ALL SELECT ingredient, min(id) FROM drug_keys GROUP BY 1 UNION ALL SELECT brand, min(id) FROM drug_keys GROUP BY 1),
drug_tiers AS (
  SELECT term_id, min(id) AS id, 11 AS tier, 1.0::DOUBLE AS confidence, 'exact' AS match_type FROM drug_asked JOIN drug_keys ON q = term GROUP BY term_id
  UNION ALL SELECT term_id, min(id), 12, 0.95, 'exact' FROM drug_asked JOIN drug_keys ON n = term AND n <> '' GROUP BY term_id
  UNION ALL SELECT term_id, min(id), 13, 0.9, 'ingredient' FROM drug_asked JOIN drug_keys ON n = ingredient AND n <> '' GROUP BY term_id
  UNION ALL SELECT term_id, min(id), 14, 0.9, 'brand_name' FROM drug_asked JOIN drug_keys ON n = brand AND n <> '' GROUP BY term_id
  UNION ALL SELECT term_id, min(id), 15, 0.85, 'pattern_strength_ingredient' FROM drug_asked JOIN drug_keys ON regexp_extract(n, '(\\d+\\s*(?:mg|g|mcg|ml))\\s+(\\w+)', 2) = ingredient AND ingredient <> '' GROUP BY term_id
  UNION ALL SELECT term_id, min(id), 16, 0.75, 'pattern_combination' FROM drug_asked JOIN drug_keys ON regexp_matches(n, '[-/]') AND contains(ingredient, trim(regexp_split_to_array(n, '[-/]')[1])) AND trim(regexp_split_to_array(n, '[-/]')[1]) <> '' GROUP BY term_id
  UNION ALL SELECT term_id, min(id), 17, 0.7, 'partial' FROM drug_asked JOIN drug_parts ON contains(k, n) AND n <> '' GROUP BY term_id),
drug_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY tier, id) AS rn FROM drug_tiers) WHERE rn = 1)"""


def lkp15_drug_patterns(spark, d):
    """On terms written with strengths and combinations."""
    concepts = b.drugs(spark, d).where("is_active = 1")
    part = b.table(spark, d, "part").selectExpr("p_partkey AS term_id", "CASE WHEN p_partkey % 2 = 0 THEN concat(p_size, ' mg ', p_name) ELSE concat(substr(p_name, 1, 2), '-', p_name) END AS q")
    return _shown(lk.best(lk.drug_pattern_tiers(part, concepts, F.col("q"))), concepts)


LKP15_SQL = f"""WITH {b.DRUGS}, a AS (SELECT p_partkey AS term_id, CASE WHEN p_partkey % 2 = 0 THEN concat(p_size, ' mg ', p_name) ELSE concat(substr(p_name, 1, 2), '-', p_name) END AS q FROM part),
k AS (SELECT lower(ingredient) AS ingredient, min(id) AS id FROM drugs WHERE is_active = 1 GROUP BY 1),
t AS (SELECT term_id, id, 15 AS tier, 0.85::DOUBLE AS confidence, 'pattern_strength_ingredient' AS match_type FROM a JOIN k ON regexp_extract(q, '(\\d+\\s*(?:mg|g|mcg|ml))\\s+(\\w+)', 2) = ingredient AND ingredient <> ''
  UNION ALL SELECT term_id, min(id), 16, 0.75, 'pattern_combination' FROM a JOIN k ON regexp_matches(q, '[-/]') AND contains(ingredient, trim(regexp_split_to_array(q, '[-/]')[1])) GROUP BY term_id),
r AS (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY tier, id) AS rn FROM t)
SELECT r.term_id, c.code, c.display, r.confidence, r.match_type FROM r JOIN drugs c ON c.id = r.id WHERE rn = 1"""


def lkp17_by_code(spark, d):
    codes = b.table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("code")).distinct()
    return lk.by_code(codes, b.conditions(spark, d)).select("code", "display")


def lkp19_by_part(spark, d):
    """Lab concepts by part: the component's word is the part."""
    labs = b.labs(spark, d)
    links = labs.select(F.col("code").alias("loinc_code"), F.col("component").alias("part_number"), F.lit("COMPONENT").alias("part_type")).unionByName(labs.select(F.col("code").alias("loinc_code"), F.col("specimen").alias("part_number"), F.lit("SYSTEM").alias("part_type")))
    parts = links.select("part_number").distinct()
    return lk.by_part(labs, links, parts, "COMPONENT").select("part_number", "code", "display")


def lkp20_synonym(spark, d):
    return lk.synonym_queries(asked(spark, d), synonyms(spark), "snomed", F.col("q"))


LKP20_SQL = f"""WITH {ASKED}, {SYN},
s AS (SELECT * FROM synonyms WHERE len(list_filter({b.lst(fv.SYNONYM_KEYS['snomed'])}, lambda p: contains(lower(set_key), p))) > 0 OR ends_with(set_key, '_syn')),
j AS (SELECT a.term_id, s.set_key, p.synonym AS prim, row_number() OVER (PARTITION BY a.term_id ORDER BY s.set_position, s.set_key) AS rn
      FROM asked a JOIN s ON s.synonym = a.q JOIN s p ON p.set_key = s.set_key AND p.position = 0)
SELECT term_id, set_key AS synonym_set, prim AS "primary" FROM j WHERE rn = 1"""


def lkp21_abbreviation(spark, d):
    rows = lk.abbreviation_queries(b.terms(spark, d), F.lower(F.trim("term")))
    return rows.select("term_id", F.col("position").cast("long").alias("position"), "expanded_term")


ABBREVIATIONS = "abbr AS (SELECT * FROM " + b.values([(k, i, e) for k, v in fv.ABBREVIATIONS.items() for i, e in enumerate(v)], "short, position, expanded_term") + ")"


def lkp22_similar_labs(spark, d):
    found = lk.similar_labs(b.terms(spark, d), b.labs(spark, d), 5)
    return found.select("term_id", "code", F.col("tier").cast("long").alias("tier"), F.col("rank").cast("long").alias("rank"))


LKP22_SQL = f"""WITH {b.TERMS}, {b.LABS}, a AS (SELECT term_id, {lab_sql('term')} AS q FROM terms), u AS (SELECT DISTINCT q FROM a WHERE q <> ''),
h AS (SELECT q, code, id, 1 AS tier FROM u JOIN labs ON contains(lower(component), q) UNION ALL SELECT q, code, id, 2 FROM u JOIN labs ON contains(lower(display), q)),
o AS (SELECT q, code, min(tier) AS tier, arg_min(id, tier) AS id FROM h GROUP BY q, code),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier, id) AS rank FROM o)
SELECT a.term_id, r.code, r.tier::BIGINT AS tier, r.rank FROM a JOIN r ON a.q = r.q WHERE rank <= 5"""


def lkp24_26_all_systems(spark, d):
    """All cascades at once, without the fuzzy tiers."""
    concepts = {"snomed": b.conditions(spark, d), "loinc": b.labs(spark, d), "rxnorm": b.drugs(spark, d)}
    return map_terms(b.terms(spark, d), concepts, None, custom(spark), None, include_fuzzy=False)


#: The tables and tiers of all cascades over ``asked``; ``top`` has the best of each term and vocabulary.
ALL_TIERS = f"""{b.CONDITIONS}, {b.LABS}, {b.DRUGS}, {ABBREVIATIONS}, custom AS (SELECT * FROM {b.values(CUSTOM, 'system, term, code, display')}),
{CONDITION_HITS}, {LAB_HITS}, {DRUG_HITS},
expanded AS (SELECT term_id, position, expanded_term AS e FROM asked JOIN abbr ON lower(trim(term)) = short WHERE q <> ''),
expanded_tiers AS (SELECT term_id, position, id, 2 AS tier FROM expanded JOIN condition_keys ON e = k UNION ALL SELECT term_id, position, min(id), 3 FROM expanded JOIN condition_keys ON contains(k, e) GROUP BY 1, 2),
expanded_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY position, tier, id) AS rn FROM expanded_tiers) WHERE rn = 1),
every AS (
  SELECT a.term_id, c.system, c.code, c.display, 1.0::DOUBLE AS confidence, 'custom' AS match_type, 'custom' AS via, -3 AS tier FROM asked a JOIN custom c ON a.term = c.term WHERE a.q <> ''
  UNION ALL SELECT h.term_id, 'snomed', c.code, c.display, 0.95, 'abbreviation', 'abbreviation', -2 FROM expanded_best h JOIN conditions c ON c.id = h.id
  UNION ALL SELECT h.term_id, 'snomed', c.code, c.display, h.confidence, h.match_type, 'lookup', h.tier FROM condition_best h JOIN conditions c ON c.id = h.id
  UNION ALL SELECT h.term_id, 'loinc', c.code, c.display, h.confidence, h.match_type, 'lookup', h.tier FROM lab_best h JOIN labs c ON c.id = h.id
  UNION ALL SELECT h.term_id, 'rxnorm', c.code, c.display, h.confidence, h.match_type, 'lookup', h.tier FROM drug_best h JOIN drugs c ON c.id = h.id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term_id, system ORDER BY tier) AS rn FROM every) WHERE rn = 1),
systems AS (SELECT unnest(['snomed', 'loinc', 'rxnorm']) AS system)"""
ALL_SQL = f"""WITH {ASKED}, {ALL_TIERS}
SELECT t.term_id, s.system, top.code IS NOT NULL AS found, top.code, top.display, top.confidence, top.match_type, top.via
FROM terms t CROSS JOIN systems s LEFT JOIN top ON top.term_id = t.term_id AND top.system = s.system"""


def lkp24_26_with_fuzzy(spark, d):
    concepts = {"snomed": b.conditions(spark, d), "loinc": b.labs(spark, d), "rxnorm": b.drugs(spark, d)}
    return map_terms(b.terms(spark, d), concepts, synonyms(spark), custom(spark))


def _synonym_tiers() -> str:
    """Terms that are synonyms of a set, looked up as its first member, in each vocabulary."""
    relevant = lambda system: f"SELECT * FROM synonyms WHERE len(list_filter({b.lst(fv.SYNONYM_KEYS[system])}, lambda p: contains(lower(set_key), p))) > 0 OR ends_with(set_key, '_syn')"
    prims = " UNION ALL ".join(f"SELECT a.term_id, '{system}' AS system, p.synonym AS q, row_number() OVER (PARTITION BY a.term_id ORDER BY s.set_position, s.set_key) AS rn FROM cased a JOIN ({relevant(system)}) s ON s.synonym = a.q JOIN synonyms p ON p.set_key = s.set_key AND p.position = 0" for system in ("snomed", "loinc", "rxnorm"))
    return f"primaries AS (SELECT * FROM ({prims}) WHERE rn = 1)"


def _with_fuzzy_sql() -> str:
    """All cascades, synonyms first looked up as terms of their own with negative ids, and the fuzzy tiers for what is left."""
    systems = ("snomed", "loinc", "rxnorm")
    tables = dict(zip(systems, ("conditions", "labs", "drugs")))
    names = " UNION ALL ".join(f"SELECT '{s}' AS system, lower(term) AS t, max(id) AS id FROM {t} GROUP BY 2" for s, t in tables.items())
    shown = " UNION ALL ".join(f"SELECT '{s}' AS system, id, code, display FROM {t}" for s, t in tables.items())
    grams = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"
    tiers = ALL_TIERS.replace("asked", "looked").replace("lab_looked", "lab_asked").replace("drug_looked", "drug_asked")
    return f"""WITH RECURSIVE {b.TERMS}, cased AS (SELECT term_id, term, {term_sql('term')} AS q FROM terms), {SYN}, {_synonym_tiers()},
words AS (SELECT DISTINCT q FROM primaries), numbered AS (SELECT q, -row_number() OVER (ORDER BY q) AS n FROM words),
looked AS (SELECT * FROM cased UNION ALL SELECT n, NULL, q FROM numbered), {tiers},
custom_hits AS (SELECT * FROM top WHERE via IN ('custom', 'abbreviation')),
synonym_hits AS (SELECT p.term_id, p.system, x.code, x.display FROM primaries p JOIN numbered n ON n.q = p.q JOIN top x ON x.term_id = n.n AND x.system = p.system AND x.via = 'lookup'),
found AS (SELECT term_id, system, code, display, confidence, match_type, via FROM custom_hits WHERE term_id >= 0
  UNION ALL SELECT term_id, system, code, display, 0.95::DOUBLE, 'synonym', 'synonym' FROM synonym_hits s WHERE NOT EXISTS (SELECT 1 FROM custom_hits c WHERE c.term_id = s.term_id AND c.system = s.system)
  UNION ALL SELECT term_id, system, code, display, confidence, match_type, via FROM top t WHERE via = 'lookup' AND term_id >= 0 AND NOT EXISTS (SELECT 1 FROM synonym_hits s WHERE s.term_id = t.term_id AND s.system = t.system)),
names AS ({names}), shown AS ({shown}),
idx AS (SELECT system, v AS key, max(id) AS id FROM (SELECT system, id, unnest({variations_sql('t')}) AS v FROM names) GROUP BY 1, 2),
rest AS (SELECT term_id, s.system, {b.collapse_sql('lower(term)')} AS t FROM cased c CROSS JOIN systems s WHERE c.q <> '' AND NOT EXISTS (SELECT 1 FROM found f WHERE f.term_id = c.term_id AND f.system = s.system)),
spread AS (SELECT term_id, system, t, unnest({variations_sql('t')}) AS v FROM rest),
varied AS (SELECT * FROM (SELECT s.term_id, s.system, i.id, row_number() OVER (PARTITION BY s.term_id, s.system ORDER BY s.v <> s.t, s.v) AS rn FROM spread s JOIN idx i ON i.system = s.system AND i.key = s.v) WHERE rn = 1),
hard AS (SELECT DISTINCT r.system, r.t AS q FROM rest r WHERE NOT EXISTS (SELECT 1 FROM varied v WHERE v.term_id = r.term_id AND v.system = r.system)),
near AS (SELECT DISTINCT q, key FROM hard h JOIN idx i ON i.system = h.system WHERE 2 * least(length(q), length(key)) >= 0.8 * (length(q) + length(key)) AND 2 * {bag_sql('q', 'key')} >= 0.8 * (length(q) + length(key))), {matched_sql('near')},
kt AS (SELECT system, t AS key, {tokens_sql('t')} AS t FROM (SELECT system, t FROM names)), kg AS (SELECT system, key, g, count(*) AS tf FROM (SELECT system, key, unnest({grams}) AS g FROM kt) GROUP BY 1, 2, 3),
sizes AS (SELECT system, count(*) AS n FROM names GROUP BY 1), idf AS (SELECT g.system, g, ln((1 + any_value(n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM kg g JOIN sizes z ON z.system = g.system GROUP BY 1, 2),
kw AS (SELECT k.system, key, k.g, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY k.system, key)) AS n FROM kg k JOIN idf i ON i.system = k.system AND i.g = k.g),
qg AS (SELECT system, q, g, count(*) AS tf FROM (SELECT system, q, unnest({grams}) AS g FROM (SELECT system, q, {tokens_sql('q')} AS t FROM hard)) GROUP BY 1, 2, 3),
qw AS (SELECT k.system, q, k.g, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY k.system, q)) AS n FROM qg k JOIN idf i ON i.system = k.system AND i.g = k.g),
angles AS (SELECT a.system, q, key, round(sum(a.w / a.n * k.w / k.n), 6) AS c FROM qw a JOIN kw k ON k.system = a.system AND k.g = a.g GROUP BY 1, 2, 3),
split AS (SELECT system, q, list_distinct({tokens_of_sql('q')}) AS x FROM hard), cut AS (SELECT system, key, list_distinct({tokens_of_sql('key')}) AS y FROM idx),
tokens AS (SELECT s.system, q, key, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE AS j FROM split s JOIN cut c ON c.system = s.system AND list_has_any(x, y)),
rated AS (SELECT h.system, h.q, m.key, 2.0::DOUBLE * m.n / (length(m.q) + length(m.key)) * 100 AS score, 0 AS place, 'levenshtein' AS match_type FROM hard h JOIN matched m ON m.q = h.q JOIN idx i ON i.system = h.system AND i.key = m.key WHERE 2.0::DOUBLE * m.n / (length(m.q) + length(m.key)) >= 0.8
  UNION ALL SELECT system, q, key, j * 100, 1, 'token' FROM tokens WHERE j >= 0.7 UNION ALL SELECT system, q, key, c * 100, 2, 'cosine' FROM angles WHERE c >= 0.7),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system, q ORDER BY score DESC, place, key) AS rn FROM rated) WHERE rn = 1),
every_one AS (SELECT * FROM found
  UNION ALL SELECT v.term_id, v.system, s.code, s.display, 1.0::DOUBLE, 'variation', 'fuzzy' FROM varied v JOIN shown s ON s.system = v.system AND s.id = v.id
  UNION ALL SELECT r.term_id, r.system, s.code, s.display, b.score / 100, b.match_type, 'fuzzy' FROM rest r JOIN best b ON b.system = r.system AND b.q = r.t JOIN idx i ON i.system = b.system AND i.key = b.key JOIN shown s ON s.system = i.system AND s.id = i.id
    WHERE NOT EXISTS (SELECT 1 FROM varied v WHERE v.term_id = r.term_id AND v.system = r.system))
SELECT t.term_id, s.system, e.code IS NOT NULL AS found, e.code, e.display, e.confidence, e.match_type, e.via
FROM terms t CROSS JOIN systems s LEFT JOIN every_one e ON e.term_id = t.term_id AND e.system = s.system"""


def con03_common_conditions(spark, d):
    terms = b.terms(spark, d)
    known = remote.common_conditions(spark).withColumn("system", F.lit("snomed"))
    return remote.lookup(terms, [known], b.literal(spark, [("snomed",)], "system string"))


CON03_SQL = f"""WITH {b.TERMS}, known AS (SELECT * FROM {b.values([(t, c, n) for t, (c, n) in fv.COMMON_CONDITIONS.items()], 'term, code, display')})
SELECT t.term_id, 'snomed' AS system, k.code, k.display, 0.95::DOUBLE AS confidence, 'provider_0' AS source FROM terms t JOIN known k ON lower(trim(t.term)) = k.term"""


def con07_request_key(spark, d):
    return b.table(spark, d, "events").select("event_id", remote.request_key(F.col("event_type"), F.lit("search"), F.struct(F.col("user_id").cast("string").alias("term"))).alias("key"))


def _edges(spark, d):
    """Customers and suppliers are in nations, nations in regions; parts are due to suppliers by their orders' lines."""
    t = lambda n: b.table(spark, d, n)
    e = lambda df, s, o, k: df.selectExpr(f"concat({s}) AS source", f"concat({o}) AS destination", f"'{k}' AS kind", "1 AS is_active")
    return (
        e(t("customer"), "'C', c_custkey", "'N', c_nationkey", fv.IS_A)
        .union(e(t("supplier"), "'S', s_suppkey", "'N', s_nationkey", fv.IS_A))
        .union(e(t("nation"), "'N', n_nationkey", "'R', n_regionkey", fv.IS_A))
        .union(e(t("orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority").distinct(), "'C', o_custkey", "'P', o_orderpriority", "42752001"))
    )


def _nodes(spark, d):
    t = lambda n: b.table(spark, d, n)
    return (
        t("customer").selectExpr("concat('C', c_custkey) AS code", "c_name AS display")
        .union(t("supplier").selectExpr("concat('S', s_suppkey)", "s_name")).union(t("nation").selectExpr("concat('N', n_nationkey)", "n_name"))
        .union(t("region").selectExpr("concat('R', r_regionkey)", "r_name")).union(t("orders").selectExpr("concat('P', o_orderpriority)", "o_orderpriority").distinct())
    )


GRAPH = f"""edges AS (
  SELECT 'C' || c_custkey AS source, 'N' || c_nationkey AS destination, '{fv.IS_A}' AS kind FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, '{fv.IS_A}' FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, '{fv.IS_A}' FROM nation
  UNION ALL SELECT DISTINCT 'C' || o_custkey, 'P' || o_orderpriority, '42752001' FROM orders WHERE o_orderstatus = 'F'),
nodes AS (SELECT 'C' || c_custkey AS code, c_name AS display FROM customer UNION ALL SELECT 'S' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'R' || r_regionkey, r_name FROM region UNION ALL SELECT DISTINCT 'P' || o_orderpriority, o_orderpriority FROM orders)"""


def _codes(column):
    return F.array_join(F.transform(F.coalesce(column, F.array().cast("array<struct<code:string,display:string>>")), lambda x: x.code), ",")


def hie01_hierarchy_info(spark, d):
    info = gr.hierarchy_info(_nodes(spark, d), _edges(spark, d))
    related = F.array_join(F.transform(F.coalesce(F.map_entries("relationships"), F.array().cast("array<struct<key:string,value:array<struct<code:string,display:string>>>>")), lambda e: F.concat(e.key, F.lit(":"), F.array_join(F.transform(e.value, lambda x: x.code), ","))), ";")
    return info.select("code", "display", _codes(F.col("parents")).alias("parents"), _codes(F.col("children")).alias("children"), related.alias("related"))


HIE01_SQL = f"""WITH {GRAPH},
p AS (SELECT source AS code, string_agg(destination, ',' ORDER BY destination) AS x FROM edges JOIN nodes ON destination = code WHERE kind = '{fv.IS_A}' GROUP BY 1),
c AS (SELECT destination AS code, string_agg(source, ',' ORDER BY source) AS x FROM edges JOIN nodes ON source = code WHERE kind = '{fv.IS_A}' GROUP BY 1),
r AS (SELECT source AS code, '42752001:' || string_agg(destination, ',' ORDER BY destination) AS x FROM edges JOIN nodes ON destination = code WHERE kind <> '{fv.IS_A}' GROUP BY 1)
SELECT n.code, n.display, coalesce(p.x, '') AS parents, coalesce(c.x, '') AS children, coalesce(r.x, '') AS related
FROM nodes n LEFT JOIN p ON p.code = n.code LEFT JOIN c ON c.code = n.code LEFT JOIN r ON r.code = n.code"""


def hie02_ancestors(spark, d):
    return gr.reach(_nodes(spark, d).select("code"), _edges(spark, d)).select("code", "reached", F.col("depth").cast("long").alias("depth"))


def hie03_descendants(spark, d):
    return gr.reach(_nodes(spark, d).select("code"), _edges(spark, d), up=False).select("code", "reached", F.col("depth").cast("long").alias("depth"))


def _reach_sql(near, far):
    return f"""WITH RECURSIVE {GRAPH}, w AS (SELECT code, code AS reached, 0 AS depth FROM nodes UNION ALL
  SELECT w.code, e.{far}, w.depth + 1 FROM w JOIN edges e ON e.{near} = w.reached AND e.kind = '{fv.IS_A}' WHERE w.depth < 10)
SELECT code, reached, min(depth)::BIGINT AS depth FROM w WHERE depth > 0 GROUP BY 1, 2"""


def hie04_related(spark, d):
    return gr.related(_nodes(spark, d), _edges(spark, d))


HIE04_SQL = f"""WITH {GRAPH} SELECT source AS code, destination AS other_code, display AS other_display, kind, 'outgoing' AS direction FROM edges JOIN nodes ON destination = code
UNION ALL SELECT destination, source, display, kind, 'incoming' FROM edges JOIN nodes ON source = code"""


def _panels(spark, d):
    return b.table(spark, d, "lineitem").selectExpr("concat('L', l_partkey) AS parent_code", "concat('L', l_suppkey) AS child_code", "CASE WHEN l_linestatus = 'O' THEN 'HAS_MEMBER' ELSE 'CALCULATED_FROM' END AS hierarchy_type").distinct()


PANELS = "panels AS (SELECT DISTINCT 'L' || l_partkey AS parent_code, 'L' || l_suppkey AS child_code, CASE WHEN l_linestatus = 'O' THEN 'HAS_MEMBER' ELSE 'CALCULATED_FROM' END AS hierarchy_type FROM lineitem)"


def hie05_lab_details(spark, d):
    labs = b.labs(spark, d)
    parts = labs.select(F.col("component").alias("part_number"), F.upper("component").alias("part_name")).distinct()
    links = labs.select(F.col("code").alias("loinc_code"), F.col("component").alias("part_number"), F.lit("COMPONENT").alias("part_type"))
    found = gr.lab_details(labs.select("code", "display"), links, parts, _panels(spark, d).where("hierarchy_type = 'HAS_MEMBER'"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return found.select("code", F.array_join(F.transform("parts", lambda p: p.part_name), ",").alias("parts"), F.greatest(n("parent_groups"), F.lit(0)).alias("n_parents"), F.greatest(n("child_items"), F.lit(0)).alias("n_children"))


HIE05_SQL = f"""WITH {b.LABS}, {PANELS}, m AS (SELECT * FROM panels WHERE hierarchy_type = 'HAS_MEMBER'),
a AS (SELECT child_code AS code, count(*) AS n FROM m JOIN labs l ON l.code = parent_code GROUP BY 1), c AS (SELECT parent_code AS code, count(*) AS n FROM m JOIN labs l ON l.code = child_code GROUP BY 1)
SELECT l.code, upper(l.component) AS parts, coalesce(a.n, 0)::BIGINT AS n_parents, coalesce(c.n, 0)::BIGINT AS n_children FROM labs l LEFT JOIN a ON a.code = l.code LEFT JOIN c ON c.code = l.code"""


def hie06_panel(spark, d):
    return gr.panel(b.labs(spark, d), _panels(spark, d), "HAS_MEMBER")


HIE06_SQL = f"""WITH {b.LABS}, {PANELS}, m AS (SELECT * FROM panels WHERE hierarchy_type = 'HAS_MEMBER')
SELECT child_code AS code, parent_code AS other_code, hierarchy_type, 'parent' AS relation, display AS other_display FROM m JOIN labs ON code = parent_code
UNION ALL SELECT parent_code, child_code, hierarchy_type, 'child', display FROM m JOIN labs ON code = child_code"""


def hie07_drug_details(spark, d):
    edges = b.table(spark, d, "lineitem").selectExpr("concat('R', l_partkey) AS source", "concat('R', l_suppkey) AS destination", "'has_ingredient' AS kind", "1 AS is_active").distinct()
    found = gr.drug_details(b.drugs(spark, d).select("code", "display", "brand_name"), edges)
    return found.select("code", _codes(F.col("ingredients")).alias("ingredients"), _codes(F.col("brand_alternatives")).alias("brands"))


HIE07_SQL = f"""WITH {b.DRUGS}, e AS (SELECT DISTINCT 'R' || l_partkey AS s, 'R' || l_suppkey AS t FROM lineitem),
i AS (SELECT s AS code, string_agg(t, ',' ORDER BY t) AS x FROM e JOIN drugs g ON g.code = t GROUP BY 1), r AS (SELECT t AS code, string_agg(s, ',' ORDER BY s) AS x FROM e JOIN drugs g ON g.code = s AND g.brand_name IS NOT NULL GROUP BY 1)
SELECT d.code, coalesce(i.x, '') AS ingredients, coalesce(r.x, '') AS brands FROM drugs d LEFT JOIN i ON i.code = d.code LEFT JOIN r ON r.code = d.code"""


def fuz01_variation(spark, d):
    return fz.by_variation(b.terms(spark, d), fz.index(b.conditions(spark, d)))


FUZ01_SQL = f"""WITH {b.TERMS}, {b.CONDITIONS},
i AS (SELECT v, max(id) AS id FROM (SELECT id, unnest(vs) AS v FROM conditions JOIN (SELECT t, {variations_sql('t')} AS vs FROM (SELECT DISTINCT lower(term) AS t FROM conditions)) ON t = lower(term)) GROUP BY v),
a AS (SELECT term_id, {b.collapse_sql('lower(term)')} AS t FROM terms),
s AS (SELECT term_id, t, unnest({variations_sql('t')}) AS v FROM a),
h AS (SELECT s.term_id, s.v, c.code, c.display, row_number() OVER (PARTITION BY s.term_id ORDER BY s.v <> s.t, s.v) AS rn FROM s JOIN i ON i.v = s.v JOIN conditions c ON c.id = i.id)
SELECT term_id, v AS variation, code, display, 100.0::DOUBLE AS score FROM h WHERE rn = 1"""


def _names(spark, d):
    queries = b.terms(spark, d).select(nz.clean(F.col("term")).alias("q")).where("q <> ''").distinct()
    keys = b.conditions(spark, d).select(F.lower("term").alias("key")).distinct()
    return queries, keys


NAMES = f"{b.TERMS}, {b.CONDITIONS}, qs AS (SELECT DISTINCT {b.collapse_sql('lower(term)')} AS q FROM terms WHERE trim(term) <> ''), ks AS (SELECT DISTINCT lower(term) AS key FROM conditions)"


def lcs_sql(x: str, y: str) -> str:
    """The length of the longest common subsequence: a row of the table for each letter of x, each cell the largest so far."""
    step = f"list_transform(range(1, length({y}) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(row[i + 1], row[i] + CASE WHEN substr({y}, i, 1) = chr(c[1]) THEN 1 ELSE 0 END))))"
    return f"list_reduce(list_prepend(list_transform(range(0, length({y}) + 1), lambda i: 0), list_transform(range(1, length({x}) + 1), lambda i: [unicode(substr({x}, i, 1))])), lambda row, c: list_prepend(0, {step}))[-1]"


def bag_sql(x: str, y: str) -> str:
    """How many letters, counted with repeats, two texts share: no fewer than any common subsequence has."""
    return f"list_sum(list_transform(list_distinct(string_split({x}, '')), lambda c: least(length({x}) - length(replace({x}, c, '')), length({y}) - length(replace({y}, c, '')))))"


def tokens_of_sql(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def sorted_sql(x: str) -> str:
    return f"array_to_string(list_sort({tokens_of_sql(x)}), ' ')"


def fuz02_library_scorers(spark, d):
    queries, keys = _names(spark, d)
    return fz.best_of(fz.scored(queries, keys, fz.library_scorers()))


_RATIO = "100.0::DOUBLE * 2 * {m} / (length({x}) + length({y}))"
_ONE = "trim(c || ' ' || array_to_string(list_sort(list_filter({own}, lambda t: NOT list_contains({other}, t))), ' '))"
FUZ02_SQL = f"""WITH {NAMES},
p AS (SELECT q, key, CASE WHEN length(q) > length(key) THEN key ELSE q END AS s, CASE WHEN length(q) > length(key) THEN q ELSE key END AS l, {sorted_sql('q')} AS x, {sorted_sql('key')} AS y,
        list_distinct({tokens_of_sql('q')}) AS tq, list_distinct({tokens_of_sql('key')}) AS tk FROM qs CROSS JOIN ks WHERE key <> ''),
t AS (SELECT *, array_to_string(list_sort(list_filter(tq, lambda t: list_contains(tk, t))), ' ') AS c, len(list_filter(tq, lambda t: list_contains(tk, t))) AS n FROM p),
o AS (SELECT *, {_ONE.format(own='tq', other='tk')} AS one, {_ONE.format(own='tk', other='tq')} AS two FROM t),
e AS (
  SELECT q, key, 0 AS place, 'ratio' AS method, {_RATIO.format(m=lcs_sql('q', 'key'), x='q', y='key')} AS score, 90 AS least FROM p WHERE 2 * {bag_sql('q', 'key')} >= 0.9 * (length(q) + length(key))
  UNION ALL SELECT q, key, 1, 'partial_ratio', 100.0::DOUBLE * list_max(list_transform(range(0, length(l) - length(s) + 1), lambda w: {lcs_sql('s', 'substr(l, w + 1, length(s))')})) / length(s), 95 FROM p WHERE {bag_sql('s', 'l')} >= 0.95 * length(s)
  UNION ALL SELECT q, key, 2, 'token_sort_ratio', {_RATIO.format(m=lcs_sql('x', 'y'), x='x', y='y')}, 85 FROM p WHERE 2 * {bag_sql('x', 'y')} >= 0.85 * (length(x) + length(y))
  UNION ALL SELECT q, key, 3, 'token_set_ratio', CASE WHEN n > 0 AND n IN (len(tq), len(tk)) THEN 100.0::DOUBLE
      ELSE greatest(CASE WHEN n > 0 THEN {_RATIO.format(m='length(c)', x='c', y='one')} ELSE 0 END, CASE WHEN n > 0 THEN {_RATIO.format(m='length(c)', x='c', y='two')} ELSE 0 END,
                    CASE WHEN 2 * {bag_sql('one', 'two')} >= 0.85 * (length(one) + length(two)) THEN {_RATIO.format(m=lcs_sql('one', 'two'), x='one', y='two')} ELSE 0 END) END, 85 FROM o)
SELECT q, key, method, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, place, key) AS rn FROM e WHERE score >= least) WHERE rn = 1"""


def matched_sql(pairs: str) -> str:
    """Letters in matching blocks of pairs (q, key): the longest block, the first in q, then in key, and so on to its left and right."""
    run = "list_min(list_transform(range(1, least(ahi - i, bhi - j) + 2), lambda k: CASE WHEN k <= least(ahi - i, bhi - j) AND substr(q, i + k, 1) = substr(key, j + k, 1) THEN 1000 ELSE k - 1 END))"
    best = f"list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: [{run}, -i, -j]))))"
    return f"""blocks AS (
  SELECT q, key, 0::BIGINT AS alo, length(q)::BIGINT AS ahi, 0::BIGINT AS blo, length(key)::BIGINT AS bhi, 0::BIGINT AS size FROM {pairs}
  UNION ALL
  SELECT q, key, CASE side WHEN 1 THEN alo WHEN 2 THEN m[1] - m[2] ELSE 0 END, CASE side WHEN 1 THEN -m[2] WHEN 2 THEN ahi ELSE 0 END, CASE side WHEN 1 THEN blo WHEN 2 THEN m[1] - m[3] ELSE 0 END, CASE side WHEN 1 THEN -m[3] WHEN 2 THEN bhi ELSE 0 END, CASE WHEN side = 0 THEN m[1] ELSE 0 END
  FROM (SELECT *, unnest([0, 1, 2]) AS side FROM (SELECT q, key, alo, ahi, blo, bhi, {best} AS m FROM blocks WHERE ahi > alo AND bhi > blo) WHERE m[1] > 0)),
matched AS (SELECT q, key, sum(size)::BIGINT AS n FROM blocks GROUP BY q, key)"""


def fuz03_difflib(spark, d):
    queries, keys = _names(spark, d)
    return fz.best_of(fz.scored(queries, keys, {"difflib_ratio": fv.THRESHOLDS["difflib"]}, least=0.8))


_NEAR = "{pairs} WHERE 2 * " + bag_sql("q", "key") + " >= 0.8 * (length(q) + length(key))"
FUZ03_DIFFLIB_SQL = f"""WITH RECURSIVE {NAMES}, near AS (SELECT q, key FROM {_NEAR.format(pairs='qs CROSS JOIN ks')}), {matched_sql('near')},
r AS (SELECT q, key, 2.0::DOUBLE * n / (length(q) + length(key)) AS ratio FROM matched)
SELECT q, key, 'difflib_ratio' AS method, ratio * 1 AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ratio DESC, key) AS rn FROM r WHERE ratio >= 0.8) WHERE rn = 1"""


def fuz03_jaccard(spark, d):
    queries, keys = _names(spark, d)
    return fz.token_jaccard(queries, keys).select("q", "key", F.round("jaccard", 6).alias("jaccard"))


FUZ03_SQL = f"""WITH {NAMES}, a AS (SELECT q, list_distinct(string_split(q, ' ')) AS x FROM qs), k AS (SELECT key, list_distinct(string_split(key, ' ')) AS y FROM ks),
j AS (SELECT q, key, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE AS j FROM a JOIN k ON list_has_any(x, y))
SELECT q, key, round(j, 6) AS jaccard FROM j WHERE j >= 0.7"""


def fuz05_tfidf_cosine(spark, d):
    queries, keys = _names(spark, d)
    return fz.cosine(queries, fz.tfidf(keys))


FUZ05_SQL = f"""WITH {NAMES},
kt AS (SELECT key, {tokens_sql('key')} AS t FROM ks), qt AS (SELECT q, {tokens_sql('q')} AS t FROM qs),
kg AS (SELECT key, g, count(*) AS tf FROM (SELECT key, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS g FROM kt) GROUP BY 1, 2),
idf AS (SELECT g, ln((1 + (SELECT count(*) FROM ks)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM kg GROUP BY g),
kw AS (SELECT key, g, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY key)) AS n FROM kg JOIN idf USING (g)),
qg AS (SELECT q, g, count(*) AS tf FROM (SELECT q, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS g FROM qt) GROUP BY 1, 2),
qw AS (SELECT q, g, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY q)) AS n FROM qg JOIN idf USING (g)),
c AS (SELECT q, key, round(sum(qw.w / qw.n * kw.w / kw.n), 6) AS cosine FROM qw JOIN kw USING (g) GROUP BY 1, 2)
SELECT q, key, cosine FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, key) AS rn FROM c WHERE cosine >= 0.7) WHERE rn = 1"""


def fuz07_search(spark, d):
    return fz.search(b.terms(spark, d), b.conditions(spark, d))


FUZ07_SQL = f"""WITH RECURSIVE {b.TERMS}, {b.CONDITIONS}, a AS (SELECT term_id, {b.collapse_sql('lower(term)')} AS q FROM terms),
v AS (SELECT term_id, q, unnest({variations_sql('q')}) AS v FROM a), k AS (SELECT lower(term) AS key, min(id) AS id FROM conditions GROUP BY 1),
h AS (SELECT v, key, row_number() OVER (PARTITION BY v ORDER BY id) AS n FROM (SELECT DISTINCT v FROM v WHERE length(v) >= 3) JOIN k ON contains(key, v)),
pairs AS (SELECT DISTINCT term_id, q, key FROM v JOIN h ON h.v = v.v AND n <= 20), near AS (SELECT DISTINCT q, key FROM {_NEAR.format(pairs='pairs')}), {matched_sql('near')},
r AS (SELECT term_id, code, max(round(2.0::DOUBLE * n / (length(m.q) + length(m.key)), 6)) AS score FROM matched m JOIN pairs p ON p.q = m.q AND p.key = m.key JOIN conditions c ON lower(c.term) = m.key WHERE round(2.0::DOUBLE * n / (length(m.q) + length(m.key)), 6) >= 0.8 GROUP BY 1, 2)
SELECT term_id, code, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY score DESC, code) AS rank FROM r) WHERE rank <= 10"""


def fuz09_add_synonyms(spark, d):
    sets = synonyms(spark).groupBy("set_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "synonym"))), lambda x: x.synonym).alias("synonyms"))
    added = b.literal(spark, [("aspirin", ["acetylsalicylic acid", "asa"]), ("new term", ["fresh term"])], "term string, synonyms array<string>")
    return fz.add_synonyms(sets, added).select("set_key", F.array_join("synonyms", "|").alias("synonyms"))


def fuz10_levenshtein(spark, d):
    queries, keys = _names(spark, d)
    return fz.levenshtein_within(queries, keys, 2).select("q", "key", F.col("distance").cast("long").alias("distance"))


def fuz10_jaro_winkler(spark, d):
    queries, keys = _names(spark, d)
    return fz.jaro_winkler_candidates(queries, keys).select("q", "key", F.round(sim.scorer("jaro_winkler")("q", "key"), 6).alias("similarity")).where("similarity >= 0.9")


QUERIES = {
    f.__name__: f
    for f in (
        cascade_condition_top1, lkp01_custom, lkp04_08_lab_cascade, lkp09_lab_patterns, lkp11_16_drug_cascade, lkp15_drug_patterns, lkp17_by_code, lkp19_by_part, lkp20_synonym, lkp21_abbreviation, lkp22_similar_labs,
        lkp24_26_all_systems, lkp24_26_with_fuzzy, con03_common_conditions, con07_request_key, hie01_hierarchy_info, hie02_ancestors, hie03_descendants, hie04_related, hie05_lab_details, hie06_panel, hie07_drug_details,
        fuz01_variation, fuz02_library_scorers, fuz03_difflib, fuz03_jaccard, fuz05_tfidf_cosine, fuz07_search, fuz09_add_synonyms, fuz10_levenshtein, fuz10_jaro_winkler,
    )
}
SQL = {
    "cascade_condition_top1": CASCADE_SQL,
    "lkp01_custom": f"WITH {b.TERMS} SELECT t.term_id, c.code, c.display FROM terms t JOIN {b.values(CUSTOM, 'system, term, code, display').replace(' AS v(', ' AS c(')} ON t.term = c.term WHERE c.system = 'snomed'",
    "lkp04_08_lab_cascade": f"WITH {ASKED}, {b.LABS}, {LAB_HITS} SELECT h.term_id, c.code, c.display, h.confidence, h.match_type FROM lab_best h JOIN labs c ON c.id = h.id",
    "lkp09_lab_patterns": LKP09_SQL,
    "lkp11_16_drug_cascade": f"WITH {ASKED}, {b.DRUGS}, {DRUG_HITS} SELECT h.term_id, c.code, c.display, h.confidence, h.match_type FROM drug_best h JOIN drugs c ON c.id = h.id",
    "lkp15_drug_patterns": LKP15_SQL,
    "lkp17_by_code": f"WITH {b.CONDITIONS} SELECT code, display FROM conditions WHERE is_active = 1 AND code IN (SELECT l_partkey::VARCHAR FROM lineitem)",
    "lkp19_by_part": f"WITH {b.LABS} SELECT component AS part_number, code, display FROM labs",
    "lkp20_synonym": LKP20_SQL,
    "lkp21_abbreviation": f"WITH {b.TERMS}, {ABBREVIATIONS} SELECT term_id, position::BIGINT AS position, expanded_term FROM terms JOIN abbr ON lower(trim(term)) = short",
    "lkp22_similar_labs": LKP22_SQL,
    "lkp24_26_all_systems": ALL_SQL,
    "lkp24_26_with_fuzzy": _with_fuzzy_sql(),
    "con03_common_conditions": CON03_SQL,
    "con07_request_key": "SELECT event_id, md5(event_type || '_search_{\"term\":\"' || user_id || '\"}') AS key FROM events",
    "hie01_hierarchy_info": HIE01_SQL,
    "hie02_ancestors": _reach_sql("source", "destination"),
    "hie03_descendants": _reach_sql("destination", "source"),
    "hie04_related": HIE04_SQL,
    "hie05_lab_details": HIE05_SQL,
    "hie06_panel": HIE06_SQL,
    "hie07_drug_details": HIE07_SQL,
    "fuz01_variation": FUZ01_SQL,
    "fuz02_library_scorers": FUZ02_SQL,
    "fuz03_difflib": FUZ03_DIFFLIB_SQL,
    "fuz07_search": FUZ07_SQL,
    "fuz03_jaccard": FUZ03_SQL,
    "fuz05_tfidf_cosine": FUZ05_SQL,
    "fuz10_levenshtein": f"WITH {NAMES} SELECT q, key, levenshtein(q, key)::BIGINT AS distance FROM qs JOIN ks ON levenshtein(q, key) <= 2",
    "fuz10_jaro_winkler": f"WITH {NAMES}, j AS (SELECT q, key, round(jaro_winkler_similarity(q, key), 6) AS similarity FROM qs CROSS JOIN ks) SELECT * FROM j WHERE similarity >= 0.9",
}
