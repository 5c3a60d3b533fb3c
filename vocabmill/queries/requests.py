"""Requests that name their vocabularies, terms mapped from free text, cached answers and scores in context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import documents as do, fuzzy as fz, stats as st
from ..plans import enhanced as en, requests as rq
from ..sources import remote
from . import base as b
from .clinical import READ, _read
from .match import ALL_TIERS, ASKED, NAMES, _names, bag_sql, custom, lcs_sql, sorted_sql
from .text import EXT01_SQL, term_sql


def _concepts(spark, d):
    return {"snomed": b.conditions(spark, d), "loinc": b.labs(spark, d), "rxnorm": b.drugs(spark, d)}


_ASKS = ("snomed", "LOINC", fv.SYSTEM_URIS["rxnorm"], "all", "icd10", None, " Snomed ")


def lkp27_routed(spark, d):
    """Each term asks for the vocabularies that its number picks; some ask for a high confidence."""
    asks = F.array(*map(F.lit, _ASKS))
    asked = b.terms(spark, d).select("term_id", "term", F.get(asks, (F.col("term_id") % len(_ASKS)).cast("int")).alias("system"), F.when(F.col("term_id") % 4 == 0, 0.9).alias("threshold"))
    found = rq.routed(asked, _concepts(spark, d), custom=custom(spark), include_fuzzy=False)
    return found.withColumn("attempted", F.array_join("attempted", ","))


LKP27_SQL = f"""WITH {ASKED}, {ALL_TIERS},
r AS (SELECT term_id, term, {b.lst(_ASKS)}[term_id % {len(_ASKS)} + 1] AS ask, CASE WHEN term_id % 4 = 0 THEN 0.9::DOUBLE ELSE 0 END AS least FROM terms),
n AS (SELECT *, CASE coalesce(lower(trim(ask)), 'all') WHEN {b.quoted(fv.SYSTEM_URIS['rxnorm'].lower())} THEN 'rxnorm' ELSE coalesce(lower(trim(ask)), 'all') END AS name FROM r),
e AS (SELECT term_id, term, ask, least, unnest(CASE WHEN name = 'all' THEN ['snomed', 'loinc', 'rxnorm'] ELSE [name] END) AS system FROM n),
j AS (SELECT e.*, top.code, top.display, top.confidence, top.match_type, top.via, coalesce(top.confidence >= least, false) AS found,
        CASE WHEN trim(term) = '' THEN 'Empty term' WHEN e.system NOT IN ('snomed', 'loinc', 'rxnorm') THEN 'Unsupported system: ' || ask END AS error
      FROM e LEFT JOIN top ON top.term_id = e.term_id AND top.system = e.system)
SELECT term_id, system, found, CASE WHEN found THEN code END AS code, CASE WHEN found THEN display END AS display, CASE WHEN found THEN confidence END AS confidence, CASE WHEN found THEN match_type END AS match_type, CASE WHEN found THEN via END AS via,
  error, CASE WHEN NOT found AND error IS NULL THEN 'exact' END AS attempted FROM j"""


def ext01_mapped(spark, d):
    """The known terms in all notes, mapped in all vocabularies from a confidence of 0.8 on."""
    notes = b.notes(spark, d).select("note_id", F.col("context").alias("text"))
    found = rq.extracted_and_mapped(notes, _concepts(spark, d), "note_id", 0.8, custom=custom(spark), include_fuzzy=False)
    return found.select("note_id", "term", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "entity_confidence", "system", "found", "code", "display", "confidence", "match_type")


_SPANS = EXT01_SQL.removeprefix("WITH ")
EXT01_MAPPED_SQL = f"""WITH extracted AS (WITH {_SPANS}), terms AS (SELECT DISTINCT term AS term_id, term FROM extracted), asked AS (SELECT term_id, term, {term_sql('term')} AS q FROM terms), {ALL_TIERS},
j AS (SELECT x.note_id, x.term, x.start, x."end", x.confidence AS entity_confidence, s.system, top.code, top.display, top.confidence, top.match_type, coalesce(top.confidence >= 0.8, false) AS found
      FROM extracted x CROSS JOIN systems s LEFT JOIN top ON top.term_id = x.term AND top.system = s.system)
SELECT note_id, term, start, "end", entity_confidence, system, found, CASE WHEN found THEN code END AS code, CASE WHEN found THEN display END AS display, CASE WHEN found THEN confidence END AS confidence, CASE WHEN found THEN match_type END AS match_type FROM j"""

_VIAS, _SYSTEMS = ("lookup", "synonym", "fuzzy", "fuzzy", "none"), ("snomed", "loinc", "rxnorm")
_PICK = lambda xs, of: F.get(F.array(*map(F.lit, xs)), F.pmod(of, F.lit(len(xs))).cast("int"))


def ctx02_scored(spark, d):
    """Every note's term as mapped in a vocabulary and a way that its number picks; the term is the display."""
    notes = b.notes(spark, d).withColumnRenamed("note_id", "term_id")
    via = _PICK(_VIAS, F.col("term_id"))
    mapped = notes.select("term_id", _PICK(_SYSTEMS, F.floor(F.col("term_id") / 5)).alias("system"), (via != "none").alias("found"), F.col("term").alias("display"), F.when(via != "none", 0.7 + F.pmod("term_id", F.lit(3)) / 10).alias("confidence"), F.when(F.pmod("term_id", F.lit(5)) == 2, "variation").otherwise("token").alias("match_type"), via.alias("via"))
    found = en.scored_in_context(notes, mapped)
    return found.select("term_id", F.round("confidence", 6).alias("confidence"), F.round("score", 6).alias("score"), "context_enhanced", "context_term")


def _supported(system: str) -> str:
    hits = [f"CASE WHEN contains(lower(display), {b.quoted(k)}) THEN list_filter({b.lst(h)}, lambda h: contains(lower(context), h))[1] END" for k, h in fv.SUPPORTING_CONTEXT[system].items()]
    return f"WHEN '{system}' THEN list_filter([{', '.join(hits)}], lambda h: h IS NOT NULL)"


_KEYWORDS = " ".join(f"WHEN '{k}' THEN CASE WHEN len(list_filter({b.lst(ws)}, lambda k: contains(lower(context), k))) > 0 THEN {delta} ELSE 0 END" for k, (delta, ws) in fv.CONTEXT_KEYWORDS.items())
CTX02_SQL = f"""WITH {b.NOTES}, m AS (SELECT note_id AS term_id, term AS display, context, {b.lst(_SYSTEMS)}[(note_id // 5) % 3 + 1] AS system, {b.lst(_VIAS)}[note_id % 5 + 1] AS via, 0.7::DOUBLE + note_id % 3 / 10.0::DOUBLE AS c,
    len(list_filter({b.lst(fv.LAB_KEYWORDS)}, lambda k: contains({term_sql('term')}, k))) > 0 AS lab FROM notes),
s AS (SELECT *, CASE via WHEN 'synonym' THEN 95.0::DOUBLE WHEN 'fuzzy' THEN c * 100 END AS base, CASE WHEN via = 'fuzzy' AND term_id % 5 <> 2 THEN CASE system {' '.join(map(_supported, _SYSTEMS))} END ELSE [] END AS hits,
    CASE system WHEN 'snomed' THEN 'condition' WHEN 'rxnorm' THEN 'medication' ELSE CASE WHEN lab THEN 'lab' ELSE 'measurement' END END AS kind FROM m),
k AS (SELECT *, CASE kind {_KEYWORDS} END AS more FROM s),
f AS (SELECT *, CASE WHEN len(hits) > 0 THEN least(100.0::DOUBLE, base + 10 * len(hits)) ELSE least(100.0::DOUBLE, base + more) END AS score FROM k)
SELECT term_id, round(CASE WHEN base IS NOT NULL THEN score / 100 WHEN via = 'none' THEN NULL ELSE c END, 6) AS confidence, round(CASE WHEN base IS NOT NULL THEN score END, 6) AS score,
  len(hits) > 0 OR (via <> 'none' AND more > 0) AS context_enhanced, hits[-1] AS context_term FROM f"""


def _fuzzy_hits(spark, d):
    """Two hits of each note in two vocabularies, with scores that its number picks."""
    one = lambda i, system: F.struct(F.lit(system).alias("system"), F.concat(F.lit(f"{system}-{i}-"), "note_id").alias("code"), (F.pmod(F.col("note_id") * (7 + 4 * i), F.lit(60)) + 41.0).alias("score"))
    return b.notes(spark, d).select(F.col("note_id").alias("term_id"), F.explode(F.array(one(0, "snomed"), one(1, "snomed"), one(2, "loinc"), one(3, "loinc"))).alias("x")).select("term_id", "x.system", "x.code", F.col("x.code").alias("display"), "x.score")


def _domains(spark, d):
    """The domain of each note; where its text shows none, one by its number."""
    own = _read(spark, d).select(F.col("note_id").alias("term_id"), "domain")
    return own.withColumn("domain", F.when(F.col("domain") == "general", _PICK(("laboratory", "cardiology", "endocrinology", "pulmonology"), F.col("term_id"))).otherwise(F.col("domain")))


def ctx08_fallback(spark, d):
    return en.fallback(_domains(spark, d), _fuzzy_hits(spark, d)).select("term_id", "system", "code", F.round("confidence", 6).alias("confidence"))


CTX08_SQL = f"""WITH {READ}, p AS (SELECT * FROM {b.values([(k, s, i, f) for k, (ss, f) in fv.DOMAIN_BOOSTS.items() for i, s in enumerate(ss)], 'domain, system, place, factor')}),
x AS (SELECT note_id AS term_id, CASE WHEN domain = 'general' THEN (['laboratory', 'cardiology', 'endocrinology', 'pulmonology'])[note_id % 4 + 1] ELSE domain END AS domain FROM read),
h AS (SELECT term_id, domain, i, (['snomed', 'snomed', 'loinc', 'loinc'])[i + 1] AS system, (term_id * (7 + 4 * i)) % 60 + 41.0::DOUBLE AS score FROM (SELECT *, unnest(range(4)) AS i FROM x)),
r AS (SELECT h.*, p.factor::DOUBLE AS factor, row_number() OVER (PARTITION BY term_id ORDER BY p.place, score DESC, i) AS n FROM h JOIN p ON p.domain = h.domain AND p.system = h.system WHERE score >= 60)
SELECT term_id, system, system || '-' || i || '-' || term_id AS code, round(least(1.0::DOUBLE, score / 100 * factor), 6) AS confidence FROM r WHERE n = 1"""


def ctx13_with_fallback(spark, d):
    """Every third note is mapped; the others fall back on fuzzy hits by their domain, given as a hint."""
    terms = b.notes(spark, d).withColumnRenamed("note_id", "term_id").join(_domains(spark, d).withColumnRenamed("domain", "domain_hint"), "term_id")
    mapped = terms.where("term_id % 3 = 0").select("term_id", F.lit("loinc").alias("system"), F.lit(True).alias("found"), F.concat(F.lit("M"), "term_id").alias("code"), F.col("term").alias("display"), F.lit(0.5).alias("confidence"), F.lit("partial").alias("match_type"))
    found = en.with_context(terms, mapped, _fuzzy_hits(spark, d))
    return found.select("term_id", "found", "system", "code", F.round("confidence", 6).alias("confidence"), "match_type")


CTX13_SQL = f"""WITH fell AS ({CTX08_SQL}), {READ},
x AS (SELECT *, CASE WHEN domain = 'general' THEN (['laboratory', 'cardiology', 'endocrinology', 'pulmonology'])[note_id % 4 + 1] ELSE domain END AS dom FROM read),
f AS (SELECT *, CASE WHEN dom IN ({', '.join(b.quoted(k) for k, (ss, _) in fv.DOMAIN_BOOSTS.items() if 'loinc' in ss)}) THEN true ELSE false END AS liked, CASE dom {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, (_, v) in fv.DOMAIN_BOOSTS.items())} END AS factor, list_contains(modifiers, 'negation') AS neg, list_contains(modifiers, 'uncertainty') AS unc FROM x)
SELECT f.note_id AS term_id, f.note_id % 3 = 0 OR fell.code IS NOT NULL AS found, CASE WHEN f.note_id % 3 = 0 THEN 'loinc' ELSE fell.system END AS system, CASE WHEN f.note_id % 3 = 0 THEN 'M' || f.note_id ELSE fell.code END AS code,
  CASE WHEN f.note_id % 3 = 0 THEN round(CASE WHEN liked THEN 0.5::DOUBLE * factor ELSE 0.5::DOUBLE END * CASE WHEN neg THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN unc THEN 0.9::DOUBLE ELSE 1 END, 6) ELSE fell.confidence END AS confidence,
  CASE WHEN f.note_id % 3 = 0 THEN CASE WHEN unc THEN 'uncertain_' ELSE '' END || CASE WHEN neg THEN 'negated_' ELSE '' END || CASE WHEN liked THEN 'domain_enhanced_' ELSE '' END || 'partial' WHEN fell.code IS NOT NULL THEN 'context_aware_fuzzy' END AS match_type
FROM f LEFT JOIN fell ON fell.term_id = f.note_id"""


def agg06_jobs(spark, d):
    """Customers are jobs of as many terms as their nation's number; their orders are the chunks."""
    jobs = b.table(spark, d, "customer").selectExpr("c_custkey AS job_id", "CAST(c_nationkey AS BIGINT) AS total", "TIMESTAMP '1990-01-01 00:00:00' AS created")
    chunks = b.table(spark, d, "orders").selectExpr("o_custkey AS job_id", "CAST(o_orderdate AS TIMESTAMP) AS at", "o_orderkey % 4 AS successful", "o_orderkey % 2 AS failed", "CASE WHEN o_orderkey % 41 = 0 THEN concat('chunk ', o_orderkey) END AS error")
    return st.job_summary(jobs, chunks)


AGG06_SQL = """WITH c AS (SELECT o_custkey AS job_id, sum(o_orderkey % 4)::BIGINT AS s, sum(o_orderkey % 2)::BIGINT AS f, max(o_orderdate::TIMESTAMP) AS u FROM orders GROUP BY 1),
x AS (SELECT o_custkey AS job_id, 'chunk ' || o_orderkey AS error, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, 'chunk ' || o_orderkey) AS n FROM orders WHERE o_orderkey % 41 = 0),
j AS (SELECT c_custkey AS job_id, c_nationkey::BIGINT AS total, coalesce(s, 0) AS successful, coalesce(f, 0) AS failed, u, error FROM customer LEFT JOIN c ON c.job_id = c_custkey LEFT JOIN x ON x.job_id = c_custkey AND n = 1)
SELECT job_id, total, successful, failed, CASE WHEN u IS NULL THEN 'pending' WHEN error IS NOT NULL THEN 'failed' WHEN successful + failed >= total THEN 'completed' ELSE 'processing' END AS status,
  CASE WHEN total > 0 THEN round(least(100.0::DOUBLE, 100.0::DOUBLE * (successful + failed) / total), 6) ELSE 100.0::DOUBLE END AS progress,
  CASE WHEN u IS NULL THEN 0.0::DOUBLE ELSE (epoch_us(u) - epoch_us(TIMESTAMP '1990-01-01 00:00:00')) / 1e6::DOUBLE END AS seconds, error FROM j"""


def agg08_batch_summary(spark, d):
    """Orders are documents of their customer's batch, lines the entities found in them."""
    docs = b.table(spark, d, "orders").selectExpr("o_custkey AS batch_id", "o_orderkey AS document_id", "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status", "CAST(o_orderdate AS TIMESTAMP) AS started", "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 3 SECONDS AS ended")
    lines = b.table(spark, d, "lineitem").join(docs.select("batch_id", F.col("document_id").alias("l_orderkey")), "l_orderkey")
    entities = lines.selectExpr("batch_id", "l_orderkey AS document_id", "l_returnflag AS kind", "CASE WHEN l_suppkey % 3 = 0 THEN 'loinc' ELSE 'snomed' END AS system", "CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_partkey AS STRING) END AS code")
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e.key, F.lit(":"), e.value)), ";")
    found = do.batch_summary(docs, entities)
    return found.select("batch_id", "total", "successful", "failed", "progress", "total_entities", shown("entities_by_type").alias("by_type"), shown("mappings_by_system").alias("by_system"))


AGG08_SQL = """WITH e AS (SELECT o_custkey AS batch_id, l_returnflag AS kind, CASE WHEN l_suppkey % 3 = 0 THEN 'loinc' ELSE 'snomed' END AS system, l_partkey % 4 <> 0 AS mapped FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'),
k AS (SELECT batch_id, string_agg(kind || ':' || n, ';' ORDER BY kind) AS x, sum(n)::BIGINT AS total FROM (SELECT batch_id, kind, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT batch_id, string_agg(system || ':' || n, ';' ORDER BY system) AS x FROM (SELECT batch_id, system, count(*) AS n FROM e WHERE mapped GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT o_custkey AS batch_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS successful, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS failed, round(100.0::DOUBLE * count(*) FILTER (o_orderstatus <> 'O') / count(*), 6) AS progress FROM orders GROUP BY 1)
SELECT o.*, coalesce(k.total, 0)::BIGINT AS total_entities, coalesce(k.x, '') AS by_type, coalesce(s.x, '') AS by_system FROM o LEFT JOIN k ON k.batch_id = o.batch_id LEFT JOIN s ON s.batch_id = o.batch_id"""


def con07_cached(spark, d):
    """Events are responses to their user's requests of a type; all users ask for all types a little after the last one."""
    key = lambda kind, user: remote.request_key(kind, F.lit("search"), F.struct(user.cast("string").alias("term")))
    events = b.table(spark, d, "events")
    responses = events.select(key(F.col("event_type"), F.col("user_id")).alias("key"), F.concat("props", F.col("event_id").cast("string")).alias("body"), F.col("ts").cast("timestamp").alias("fetched_at"))
    asked = events.select("user_id", "event_type").distinct().select("user_id", "event_type", key(F.col("event_type"), F.col("user_id")).alias("key"))
    now = events.agg(F.max("ts").cast("timestamp").alias("now"))
    found = remote.cached(asked, responses, now.select(F.col("now") + F.expr("INTERVAL 10 MINUTES")).scalar())
    return found.select("user_id", "event_type", "body")


CON07_SQL = """WITH n AS (SELECT max(ts) + INTERVAL 10 MINUTE AS now FROM events), a AS (SELECT DISTINCT user_id, event_type FROM events),
r AS (SELECT user_id, event_type, props || event_id AS body, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, props || event_id DESC) AS k FROM events, n WHERE ts > now - INTERVAL 1 HOUR)
SELECT a.user_id, a.event_type, r.body FROM a LEFT JOIN r ON r.user_id = a.user_id AND r.event_type = a.event_type AND k = 1"""

def _best_keys(spark, d, names):
    found = fz.by_algorithms(*_names(spark, d), names, 0.7, 5)
    return found.select("q", "key", "algorithm", "score", F.col("rank").cast("long").alias("rank"))


def fuz10_edits(spark, d):
    """The five best condition names of each term by Levenshtein and Jaro-Winkler similarity of 0.7 or more."""
    return _best_keys(spark, d, ("levenshtein", "jaro_winkler"))


FUZ10_EDITS_SQL = f"""WITH {NAMES}, p AS (SELECT q, key, round(1 - levenshtein(q, key) / greatest(length(q), length(key))::DOUBLE, 6) AS l, round(jaro_winkler_similarity(q, key), 6) AS j FROM qs CROSS JOIN ks),
r AS (SELECT q, key, CASE WHEN l >= j THEN 'levenshtein' ELSE 'jaro_winkler' END AS algorithm, greatest(l, j) AS score FROM p WHERE greatest(l, j) >= 0.7)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS rank FROM r) WHERE rank <= 5"""


def fuz10_tokens(spark, d):
    """The five best condition names of each term by the ratio of their sorted tokens."""
    return _best_keys(spark, d, ("token_sort_ratio",))


FUZ10_TOKENS_SQL = f"""WITH {NAMES}, p AS (SELECT q, key, {sorted_sql('q')} AS x, {sorted_sql('key')} AS y FROM qs CROSS JOIN ks),
n AS (SELECT * FROM p WHERE 2 * {bag_sql('x', 'y')} >= 0.7 * (length(x) + length(y))),
r AS (SELECT q, key, 'token_sort_ratio' AS algorithm, round(2 * {lcs_sql('x', 'y')} / (length(x) + length(y))::DOUBLE, 6) AS score FROM n)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS rank FROM r WHERE score >= 0.7) WHERE rank <= 5"""

QUERIES = {f.__name__: f for f in (lkp27_routed, ext01_mapped, ctx02_scored, ctx08_fallback, ctx13_with_fallback, agg06_jobs, agg08_batch_summary, con07_cached, fuz10_edits, fuz10_tokens)}
SQL = {
    "lkp27_routed": LKP27_SQL,
    "ext01_mapped": EXT01_MAPPED_SQL,
    "ctx02_scored": CTX02_SQL,
    "ctx08_fallback": CTX08_SQL,
    "ctx13_with_fallback": CTX13_SQL,
    "agg06_jobs": AGG06_SQL,
    "agg08_batch_summary": AGG08_SQL,
    "con07_cached": CON07_SQL,
    "fuz10_edits": FUZ10_EDITS_SQL,
    "fuz10_tokens": FUZ10_TOKENS_SQL,
}
