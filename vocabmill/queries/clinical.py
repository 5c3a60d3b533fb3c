"""Context, negation, rules and the enhanced pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import context as cx, rules as ru
from ..plans.cascade import map_terms
from ..plans.enhanced import enhanced
from . import base as b

RULES = [
    ("r1", "exact", 2, "chest pain", "29857009", "snomed", "Chest pain", "{}", "2024-01-01 00:00:00", True),
    ("r2", "pattern", 3, "blood", "75367002", "snomed", "Blood pressure", '{"pattern": "blood\\\\s+pressure|bp"}', "2024-01-02 00:00:00", True),
    ("r3", "context", 2, "pain", "22253000", "snomed", "Pain", '{"required:domain": "cardiology"}', "2024-01-03 00:00:00", True),
    ("r4", "domain", 4, "murmur", "88610006", "snomed", "Heart murmur", '{"domain": "cardiology"}', "2024-01-04 00:00:00", True),
    ("r5", "override", 1, "Headache", "999999", "snomed", "Override", "{}", "2024-01-05 00:00:00", True),
    ("r6", "exact", 2, "asthma", "195967001", "snomed", "Asthma", '{"min_confidence": "1.5"}', "2024-01-06 00:00:00", True),
    ("r7", "exact", 2, "copd", "1", "snomed", "Off", "{}", "2024-01-07 00:00:00", False),
    ("r8", "pattern", 2, "^mi$|infarct", "22298006", "snomed", "Infarction", "{}", "2024-01-08 00:00:00", True),
    ("r9", "pattern", 2, "((", "2", "loinc", "", "{}", "2024-01-09 00:00:00", False),
    ("r10", "context", 2, "x", "3", "loinc", "No context", "{}", "2024-01-10 00:00:00", False),
]
RULE_COLUMNS = "rule_id, rule_type, priority, source_term, target_code, target_system, target_display, conditions, created_at, is_active"


def rules(spark):
    rows = b.literal(spark, RULES, "rule_id string, rule_type string, priority int, source_term string, target_code string, target_system string, target_display string, conditions string, created_at string, is_active boolean")
    return rows.withColumn("conditions", F.from_json("conditions", "map<string,string>")).withColumn("created_at", F.to_timestamp_ntz(F.col("created_at")))


def _read(spark, d):
    text = F.lower(F.concat(F.col("context"), F.lit(" "), F.col("term")))
    rows = b.notes(spark, d).select("note_id", "term", "context", text.alias("text"))
    return rows.withColumn("modifiers", cx.modifiers(F.col("text"))).withColumn("domain", cx.domain(F.col("text")))


MODIFIERS_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {b.quoted('|'.join(p))}) THEN '{k}' END" for k, p in fv.MODIFIER_PATTERNS.items()) + "], lambda m: m IS NOT NULL)"
_counts = {k: " + ".join(f"len(regexp_extract_all(text, {b.quoted(p)}))" for p in ps) for k, ps in fv.DOMAIN_PATTERNS.items()}
DOMAIN_SQL = f"CASE greatest({', '.join(_counts.values())}) WHEN 0 THEN 'general' " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in _counts.items()) + " END"
READ = f"{b.NOTES}, texts AS (SELECT *, lower(context || ' ' || term) AS text FROM notes), read AS (SELECT *, {MODIFIERS_SQL} AS modifiers, {DOMAIN_SQL} AS domain FROM texts)"
WORDS_SQL = "len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"


def ctx01_enhancers(spark, d):
    kinds = list(fv.CONTEXT_KEYWORDS)
    rows = b.notes(spark, d).select("note_id", "context", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    return rows.select("note_id", "kind", cx.enhanced_score(F.lit(88.0), F.col("context"), F.col("kind")).alias("score"))


CTX01_SQL = f"WITH {b.NOTES} " + " UNION ALL ".join(
    f"SELECT note_id, '{k}' AS kind, CASE WHEN context <> '' AND len(list_filter({b.lst(ws)}, lambda k: contains(lower(context), k))) > 0 THEN least(100.0::DOUBLE, 88.0 + {delta})::DOUBLE ELSE 88.0::DOUBLE END AS score FROM notes" for k, (delta, ws) in fv.CONTEXT_KEYWORDS.items()
)


def ctx03_modifiers(spark, d):
    return _read(spark, d).select("note_id", F.array_join("modifiers", ",").alias("modifiers"))


def ctx04_domain(spark, d):
    return _read(spark, d).select("note_id", "domain")


def ctx05_confidence(spark, d):
    return _read(spark, d).select("note_id", F.round(cx.context_confidence(F.col("text"), F.col("domain"), F.col("modifiers")), 6).alias("confidence"))


CTX05_SQL = f"WITH {READ} SELECT note_id, round(least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN domain <> 'general' THEN 0.2::DOUBLE ELSE 0 END + least(0.2::DOUBLE, len(modifiers) * 0.1::DOUBLE) + least(1.0::DOUBLE, {WORDS_SQL.format(x='text')} / 20.0::DOUBLE) * 0.1::DOUBLE), 6) AS confidence FROM read"


def ctx06_semantic(spark, d):
    found = cx.semantic_features(F.col("text"), F.col("term"))
    kinds = {"word_count": "long", "term_position": "long", "medical_terms_count": "long", "numeric_values": "long", "has_dosage": "boolean", "has_measurement": "boolean"}
    return _read(spark, d).select("note_id", *[found[k].cast(t).alias(k) for k, t in kinds.items()])


CTX06_SQL = f"""WITH {READ} SELECT note_id, {WORDS_SQL.format(x='text')}::BIGINT AS word_count, (instr(text, lower(term)) - 1)::BIGINT AS term_position,
len(regexp_extract_all(text, '\\b\\w+(?:ology|itis|osis|pathy|graphy|scopy)\\b'))::BIGINT AS medical_terms_count, len(regexp_extract_all(text, '\\b\\d+(?:\\.\\d+)?\\s*(?:mg|ml|cm|mm|%|units?)\\b'))::BIGINT AS numeric_values,
regexp_matches(text, '\\b\\d+\\s*(?:mg|ml|units?)\\b') AS has_dosage, regexp_matches(text, '\\b\\d+(?:\\.\\d+)?\\s*(?:cm|mm|inches?|feet)\\b') AS has_measurement FROM read"""

SYSTEM = "element_at(array('snomed', 'loinc', 'rxnorm'), CAST(note_id % 3 + 1 AS INT))"
MATCH = "element_at(array('exact', 'partial', 'synonym', 'pattern', 'fuzzy'), CAST(note_id % 5 + 1 AS INT))"
DUCK_SYSTEM, DUCK_MATCH = "(['snomed', 'loinc', 'rxnorm'])[note_id % 3 + 1]", "(['exact', 'partial', 'synonym', 'pattern', 'fuzzy'])[note_id % 5 + 1]"
FACTOR_SQL = "CASE " + " ".join(f"WHEN domain = '{k}' AND system IN ({', '.join(map(b.quoted, s))}) THEN {f}::DOUBLE" for k, (s, f) in fv.DOMAIN_BOOSTS.items()) + " END"


def _mapped(spark, d):
    return _read(spark, d).withColumn("system", F.expr(SYSTEM)).withColumn("match_type", F.expr(MATCH)).withColumn("found", F.col("note_id") % 7 != 0)


MAPPED = f"{READ}, mapped AS (SELECT *, {DUCK_SYSTEM} AS system, {DUCK_MATCH} AS match_type, note_id % 7 <> 0 AS found FROM read)"


def ctx07_enhance(spark, d):
    rows = _mapped(spark, d)
    new = cx.enhanced_mapping(F.lit(0.9), F.col("match_type"), F.col("system"), F.col("domain"), F.col("modifiers"))
    return rows.select("note_id", F.round(new["confidence"], 6).alias("confidence"), new["match_type"].alias("match_type"))


CTX07_SQL = f"""WITH {MAPPED}, f AS (SELECT *, {FACTOR_SQL} AS factor, list_contains(modifiers, 'negation') AS neg, list_contains(modifiers, 'uncertainty') AS unc FROM mapped)
SELECT note_id, round(CASE WHEN factor IS NULL THEN 0.9::DOUBLE ELSE least(1.0::DOUBLE, 0.9::DOUBLE * factor) END * CASE WHEN neg THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN unc THEN 0.9::DOUBLE ELSE 1 END, 6) AS confidence,
  CASE WHEN unc THEN 'uncertain_' ELSE '' END || CASE WHEN neg THEN 'negated_' ELSE '' END || CASE WHEN factor IS NOT NULL THEN 'domain_enhanced_' ELSE '' END || match_type AS match_type FROM f"""


def ctx09_11_scores(spark, d):
    rows, x = _mapped(spark, d), F.col
    features = cx.semantic_features(x("text"), x("term"))
    return rows.select(
        "note_id", F.round(cx.context_score(x("found"), x("domain"), F.lit(0.8), x("modifiers")), 6).alias("context_score"),
        F.round(cx.semantic_score(x("found"), x("match_type"), features["has_dosage"], features["has_measurement"]), 6).alias("semantic_score"), cx.domain_relevance(x("found"), x("system"), x("domain")).alias("relevance"),
    )


CTX09_SQL = f"""WITH {MAPPED}, f AS (SELECT *, {FACTOR_SQL} AS factor FROM mapped)
SELECT note_id, CASE WHEN found THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN domain <> 'general' THEN 0.2::DOUBLE ELSE 0 END + 0.8::DOUBLE * 0.2::DOUBLE - CASE WHEN list_contains(modifiers, 'negation') THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN list_contains(modifiers, 'uncertainty') THEN 0.1::DOUBLE ELSE 0 END)), 6) ELSE 0.0::DOUBLE END AS context_score,
  CASE WHEN found THEN CASE WHEN match_type = 'exact' THEN 1.0::DOUBLE WHEN match_type IN ('fuzzy', 'partial') THEN 0.8::DOUBLE WHEN match_type = 'synonym' THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END ELSE 0.0::DOUBLE END AS semantic_score,
  CASE WHEN NOT found THEN 0.0::DOUBLE WHEN factor IS NOT NULL THEN 0.9::DOUBLE WHEN system = 'loinc' AND domain = 'laboratory' THEN 0.95::DOUBLE WHEN system = 'snomed' AND domain IN ('cardiology', 'endocrinology') THEN 0.85::DOUBLE WHEN system = 'rxnorm' AND domain = 'general' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS relevance FROM f"""


def neg01_negation(spark, d):
    cue = cx.negation_cue(F.col("context"), F.col("term"))
    return b.notes(spark, d).select("note_id", cue.alias("cue"), F.round(cx.negated_confidence(F.lit(0.9), cue), 6).alias("confidence"))


_DASHES = "- - - - - - - - - "
NEGATED = f"""a AS (SELECT *, CASE WHEN term = '' THEN 1 ELSE instr(lower(context), lower(term)) END AS pos FROM notes),
w AS (SELECT note_id, pos, regexp_split_to_array('{_DASHES}' || regexp_split_to_array(lower(substr(context, 1, greatest(pos - 1, 0))), '[.;]')[-1], '\\s+') AS ws FROM a),
c AS (SELECT note_id, pos, regexp_extract(regexp_split_to_array(array_to_string(ws[-{cx.SCOPE_WORDS + 4}:], ' '), '\\b{cx._STOP}\\b')[-1], '\\b({cx._CUE})\\b(?:\\s+\\S+){{0,{cx.SCOPE_WORDS}}}\\s*$', 1) AS found_cue FROM w),
negated AS (SELECT note_id, CASE WHEN pos > 0 AND found_cue <> '' THEN found_cue END AS cue FROM c)"""
NEG01_SQL = f"WITH {b.NOTES}, {NEGATED} SELECT note_id, cue, round(CASE WHEN cue IS NOT NULL THEN 0.9 * 0.3 ELSE 0.9 END::DOUBLE, 6) AS confidence FROM negated"
#: The fixture's own invalid pattern and context rule.
VAL03_SQL = f"""SELECT rule_id, array_to_string(list_filter([CASE WHEN trim(coalesce(target_display, '')) = '' THEN 'missing target_display' END,
CASE WHEN rule_type = 'pattern' AND coalesce(conditions::JSON ->> '$.pattern', source_term) = '((' THEN 'pattern doesn''t compile' END,
CASE WHEN rule_type = 'context' AND NOT contains(conditions, 'required:') THEN 'no required context' END, CASE WHEN rule_type = 'domain' AND conditions::JSON ->> '$.domain' IS NULL THEN 'no domain' END], lambda e: e IS NOT NULL), '; ') AS errors FROM {b.values(RULES, RULE_COLUMNS)}"""


def fuz06_context_adjust(spark, d):
    systems = list(fv.SUPPORTING_CONTEXT)
    rows = b.notes(spark, d).select("note_id", "term", "context", F.explode(F.array(*map(F.lit, systems))).alias("system"))
    new = cx.supported_score(F.lit(85.0), F.col("term"), F.col("context"), F.col("system"))
    return rows.select("note_id", "system", new["score"].alias("score"), new["context_term"].alias("context_term"))


def _fuz06() -> str:
    out = []
    for s, table in fv.SUPPORTING_CONTEXT.items():
        hits = [f"CASE WHEN contains(lower(term), {b.quoted(k)}) THEN list_filter({b.lst(h)}, lambda h: contains(lower(context), h))[1] END" for k, h in table.items()]
        out.append(f"SELECT note_id, '{s}' AS system, list_filter([{', '.join(hits)}], lambda h: h IS NOT NULL) AS hits FROM notes")
    return f"WITH {b.NOTES}, h AS ({' UNION ALL '.join(out)}) SELECT note_id, system, least(100.0::DOUBLE, 85.0 + 10 * len(hits))::DOUBLE AS score, hits[-1] AS context_term FROM h"


def _asked(spark, d):
    return _read(spark, d).select(F.col("note_id").alias("term_id"), "term", F.create_map(F.lit("domain"), F.col("domain")).alias("context"))


def rul01_evaluate(spark, d):
    return ru.matches(_asked(spark, d), rules(spark))


def rul02_rank(spark, d):
    order = ru.ranked(ru.matches(_asked(spark, d), rules(spark)), rules(spark))
    return order.select("term_id", "rule_id", F.col("rank").cast("long").alias("rank"))


def rul03_apply(spark, d):
    base = b.notes(spark, d).select(F.col("note_id").alias("term_id"), F.array(F.struct(F.lit("B").alias("code"), F.lit("snomed").alias("system"), F.col("term").alias("display"), F.lit(0.5).alias("confidence"), F.lit("exact").alias("match_type"))).alias("mappings"))
    order = ru.ranked(ru.matches(_asked(spark, d), rules(spark)), rules(spark))
    return ru.apply(base, order).select("term_id", F.array_join(F.transform("mappings", lambda m: F.concat(m.code, F.lit(":"), m.match_type)), ",").alias("mappings"))


RULE_MATCHES = f"""{READ}, rules AS (SELECT * FROM {b.values(RULES, RULE_COLUMNS)}),
rated AS (SELECT *, CASE rule_type WHEN 'exact' THEN 1.0 WHEN 'pattern' THEN 0.8 WHEN 'context' THEN 0.9 WHEN 'domain' THEN 0.85 ELSE 1.0 END::DOUBLE AS confidence,
  coalesce(conditions::JSON ->> '$.pattern', source_term) AS pattern FROM rules WHERE is_active),
kept AS (SELECT * FROM rated WHERE confidence >= coalesce((conditions::JSON ->> '$.min_confidence')::DOUBLE, 0)),
matches AS (SELECT r.note_id AS term_id, k.rule_id, k.confidence FROM read r JOIN kept k ON
  (rule_type IN ('exact', 'override') AND lower(r.term) = lower(k.source_term)) OR (rule_type = 'pattern' AND regexp_matches(r.term, '(?i)' || pattern))
  OR (rule_type = 'context' AND r.domain = (k.conditions::JSON ->> '$."required:domain"')) OR (rule_type = 'domain' AND r.domain = (k.conditions::JSON ->> '$.domain'))),
ranked AS (SELECT m.*, k.rule_type, k.priority, k.target_code, row_number() OVER (PARTITION BY m.term_id ORDER BY k.priority, m.confidence DESC, k.created_at, m.rule_id) AS rank FROM matches m JOIN kept k USING (rule_id))"""


def rul04_latest(spark, d):
    """Order lines as versions of their part's rule."""
    log = b.table(spark, d, "lineitem").selectExpr("CAST(l_partkey AS STRING) AS rule_id", "CAST(l_quantity AS INT) AS priority", "concat(l_orderkey, '-', l_linenumber, '-', l_suppkey) AS source_term", "l_shipdate AS updated_at")
    return ru.latest(log).select("rule_id", F.col("priority").cast("long").alias("priority"), "source_term")


RUL04_SQL = """SELECT l_partkey::VARCHAR AS rule_id, l_quantity::BIGINT AS priority, l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS source_term FROM (
SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_quantity DESC, l_orderkey || '-' || l_linenumber || '-' || l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1"""


def val03_validate(spark, d):
    r = rules(spark)
    return r.select("rule_id", F.array_join(ru.errors(r), "; ").alias("errors"))


def enh04_validate_mapping(spark, d):
    """Whether an order's largest line is of the expected supplier."""
    lines = b.table(spark, d, "lineitem").selectExpr("l_orderkey AS term_id", "'snomed' AS system", "CAST(l_suppkey AS STRING) AS code", "l_extendedprice AS confidence")
    expected = b.table(spark, d, "orders").selectExpr("o_orderkey AS term_id", "CAST(o_custkey % 100 AS STRING) AS code", "'snomed' AS system")
    return ru.validated(expected, lines)


ENH04_SQL = """WITH e AS (SELECT o_orderkey AS term_id, (o_custkey % 100)::VARCHAR AS code, 'snomed' AS system FROM orders),
j AS (SELECT e.*, l_suppkey::VARCHAR AS c, l_extendedprice AS p, coalesce(l_suppkey::VARCHAR = e.code, FALSE) AS hit FROM e LEFT JOIN lineitem ON l_orderkey = term_id)
SELECT term_id, code, system, bool_or(hit) AS exact_match, arg_max(c, {'hit': hit, 'p': p, 'c': c}) AS best_code FROM j GROUP BY 1, 2, 3"""


def enh01_enhanced(spark, d):
    """The whole pipeline on the clinical notes and all turns of conversations."""
    notes = b.notes(spark, d).select(F.col("note_id").alias("term_id"), "term", "context")
    concepts = {"snomed": b.conditions(spark, d), "loinc": b.labs(spark, d), "rxnorm": b.drugs(spark, d)}
    found = enhanced(notes, map_terms(notes, concepts, include_fuzzy=False), rules(spark))
    shown = F.array_join(F.transform("mappings", lambda m: F.concat(m.code, F.lit(":"), m.match_type, F.lit(":"), F.round(m.confidence, 4).cast("string"))), ",")
    return found.select("term_id", "is_negated", "negation_cue", "domain", F.round("context_score", 6).alias("context_score"), shown.alias("mappings"))


def _base_mappings(spark, d):
    """Up to three mappings of a note: snomed and loinc tie, rxnorm has more confidence."""
    systems = F.array(*[F.struct(F.lit(s).alias("system"), F.expr(on).alias("on"), F.lit(c).alias("confidence")) for s, on, c in (("snomed", "note_id % 7 <> 0", 0.9), ("loinc", "note_id % 5 = 0", 0.9), ("rxnorm", "note_id % 4 = 0", 0.95))])
    rows = b.notes(spark, d).select("note_id", F.explode(systems).alias("s")).where("s.on")
    return rows.select(F.col("note_id").alias("term_id"), "s.system", F.lit(True).alias("found"), F.concat("s.system", F.col("note_id")).alias("code"), F.lit("d").alias("display"), "s.confidence", F.expr(MATCH).alias("match_type"))


def _enhanced(spark, d, **options):
    notes = b.notes(spark, d).select(F.col("note_id").alias("term_id"), "term", "context")
    found = enhanced(notes, _base_mappings(spark, d), rules(spark), **options)
    shown = F.array_join(F.transform("mappings", lambda m: F.concat(m.code, F.lit(":"), m.match_type, F.lit(":"), F.round(m.confidence, 4).cast("string"))), ",")
    m = lambda c: F.col(f"metadata.{c}")
    return found.select(
        "term_id", "is_negated", "negation_cue", "domain", F.round("context_score", 6).alias("context_score"), shown.alias("mappings"), F.round(m("semantic_score"), 6).alias("semantic_score"), m("domain_relevance").alias("relevance"), F.array_join(m("modifiers"), ",").alias("modifiers"),
        F.round(m("context_confidence"), 6).alias("context_confidence"), m("features.word_count").cast("long").alias("word_count"), F.array_join(F.transform(m("alternatives"), lambda x: x.system), ",").alias("alternatives"), m("rule_type").alias("rule_type"),
    )


def enh01_metadata(spark, d):
    """ENH01, CTX12, CTX13: context, negation and rules over notes with up to three mappings, with all metadata."""
    return _enhanced(spark, d)


def enh02_basic(spark, d):
    """ENH02: neither rules nor negation."""
    return _enhanced(spark, d, negation=False, use_rules=False)


def _enhanced_sql(negation: bool, use_rules: bool) -> str:
    words = WORDS_SQL.format(x="text")
    relevance = "CASE WHEN {s} IS NULL THEN 0.0 " + " ".join(f"WHEN domain = '{k}' AND {{s}} IN ({', '.join(map(b.quoted, s))}) THEN 0.9" for k, (s, _) in fv.DOMAIN_BOOSTS.items()) + " WHEN {s} = 'loinc' AND domain = 'laboratory' THEN 0.95 WHEN {s} = 'snomed' AND domain IN ('cardiology', 'endocrinology') THEN 0.85 WHEN {s} = 'rxnorm' AND domain = 'general' THEN 0.8 ELSE 0.5 END::DOUBLE"
    times = "* CASE WHEN g.cue IS NOT NULL THEN 0.3::DOUBLE ELSE 1 END" if negation else ""
    rule = f"r.target_code || ':rule_' || r.rule_type || ':' || round(r.confidence {times}, 4)::VARCHAR"
    own = f"e.code || ':' || e.mt || ':' || round(e.conf {times}, 4)::VARCHAR"
    lists = f"CASE WHEN r.rule_id IS NULL THEN CASE WHEN e.system IS NULL THEN '' ELSE {own} END WHEN e.system IS NULL OR r.rule_type = 'override' OR r.priority = 1 THEN {rule} ELSE {rule} || ',' || {own} END" if use_rules else f"CASE WHEN e.system IS NULL THEN '' ELSE {own} END"
    return f"""WITH {RULE_MATCHES}, {NEGATED},
based AS (SELECT *, CASE WHEN note_id % 4 = 0 THEN 'rxnorm' WHEN note_id % 7 <> 0 THEN 'snomed' WHEN note_id % 5 = 0 THEN 'loinc' END AS system, {DUCK_MATCH} AS match_type, CASE WHEN note_id % 4 = 0 THEN 0.95 ELSE 0.9 END::DOUBLE AS c FROM read),
f AS (SELECT *, {FACTOR_SQL} AS factor, list_contains(modifiers, 'negation') AS neg, list_contains(modifiers, 'uncertainty') AS unc FROM based),
e AS (SELECT *, system || note_id AS code, CASE WHEN factor IS NULL THEN c ELSE least(1.0::DOUBLE, c * factor) END * CASE WHEN neg THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN unc THEN 0.9::DOUBLE ELSE 1 END AS conf,
  CASE WHEN unc THEN 'uncertain_' ELSE '' END || CASE WHEN neg THEN 'negated_' ELSE '' END || CASE WHEN factor IS NOT NULL THEN 'domain_enhanced_' ELSE '' END || match_type AS mt FROM f),
others AS (SELECT note_id, domain, unnest(list_filter([CASE WHEN note_id % 7 <> 0 THEN 'snomed' END, CASE WHEN note_id % 5 = 0 THEN 'loinc' END], lambda s: s IS NOT NULL AND s <> coalesce(system, ''))) AS s FROM e),
alt AS (SELECT note_id, string_agg(s, ',' ORDER BY {relevance.format(s='s')} DESC, s) AS alternatives FROM others GROUP BY 1)
SELECT e.note_id AS term_id, {"g.cue IS NOT NULL" if negation else "FALSE"} AS is_negated, {"g.cue" if negation else "NULL::VARCHAR"} AS negation_cue, e.domain,
  CASE WHEN e.system IS NULL THEN 0.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN domain <> 'general' THEN 0.2::DOUBLE ELSE 0 END + conf * 0.2::DOUBLE - CASE WHEN neg THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN unc THEN 0.1::DOUBLE ELSE 0 END)), 6) END AS context_score,
  {lists} AS mappings,
  CASE WHEN e.system IS NULL THEN 0.0::DOUBLE WHEN match_type = 'exact' THEN 1.0::DOUBLE WHEN match_type IN ('fuzzy', 'partial') THEN 0.8::DOUBLE WHEN match_type = 'synonym' THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS semantic_score, {relevance.format(s='e.system')} AS relevance,
  array_to_string(modifiers, ',') AS modifiers, round(least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN domain <> 'general' THEN 0.2::DOUBLE ELSE 0 END + least(0.2::DOUBLE, len(modifiers) * 0.1::DOUBLE) + least(1.0::DOUBLE, {words} / 20.0::DOUBLE) * 0.1::DOUBLE), 6) AS context_confidence,
  {words}::BIGINT AS word_count, coalesce(alt.alternatives, CASE WHEN e.system IS NOT NULL THEN '' END) AS alternatives, {"r.rule_type" if use_rules else "NULL::VARCHAR"} AS rule_type
FROM e LEFT JOIN negated g ON g.note_id = e.note_id LEFT JOIN ranked r ON r.term_id = e.note_id AND r.rank = 1 LEFT JOIN alt ON alt.note_id = e.note_id"""


QUERIES = {
    f.__name__: f
    for f in (ctx01_enhancers, ctx03_modifiers, ctx04_domain, ctx05_confidence, ctx06_semantic, ctx07_enhance, ctx09_11_scores, neg01_negation, fuz06_context_adjust, rul01_evaluate, rul02_rank, rul03_apply, rul04_latest, val03_validate, enh04_validate_mapping, enh01_enhanced, enh01_metadata, enh02_basic)
}
SQL = {
    "ctx01_enhancers": CTX01_SQL,
    "ctx03_modifiers": f"WITH {READ} SELECT note_id, array_to_string(modifiers, ',') AS modifiers FROM read",
    "ctx04_domain": f"WITH {READ} SELECT note_id, domain FROM read",
    "ctx05_confidence": CTX05_SQL,
    "ctx06_semantic": CTX06_SQL,
    "ctx07_enhance": CTX07_SQL,
    "ctx09_11_scores": CTX09_SQL,
    "fuz06_context_adjust": _fuz06(),
    "neg01_negation": NEG01_SQL,
    "enh01_metadata": _enhanced_sql(True, True),
    "enh02_basic": _enhanced_sql(False, False),
    "val03_validate": VAL03_SQL,
    "rul01_evaluate": f"WITH {RULE_MATCHES} SELECT * FROM matches",
    "rul02_rank": f"WITH {RULE_MATCHES} SELECT term_id, rule_id, rank FROM ranked",
    "rul03_apply": f"WITH {RULE_MATCHES} SELECT n.note_id AS term_id, CASE WHEN r.rule_id IS NULL THEN 'B:exact' WHEN r.rule_type = 'override' OR r.priority = 1 THEN r.target_code || ':rule_' || r.rule_type ELSE r.target_code || ':rule_' || r.rule_type || ',B:exact' END AS mappings FROM notes n LEFT JOIN ranked r ON r.term_id = n.note_id AND r.rank = 1",
    "rul04_latest": RUL04_SQL,
    "enh04_validate_mapping": ENH04_SQL,
}
