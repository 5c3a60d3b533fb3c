"""Normalisers, extraction and similarity of single texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv, normalize as nz, similarity as sim
from ..operators import extract as ex
from . import base as b


def term_sql(x: str) -> str:
    return f"replace(replace({b.collapse_sql('regexp_replace(' + b.strip_prefix_sql(f'trim(lower({x}))', fv.TERM_PREFIXES) + ', ' + b.quoted('[,.;:!?()]') + ', ' + b.quoted(' ') + ', ' + b.quoted('g') + ')')}, '%', ' percent'), '&', ' and ')"


def lab_sql(x: str) -> str:
    bare = b.strip_suffix_sql(b.strip_prefix_sql(f"lower({x})", [p + " " for p in fv.LAB_PREFIXES]), [" " + s for s in fv.LAB_SUFFIXES])
    return b.collapse_sql(b.case_sql(bare, fv.LAB_SHORT_NAMES, bare))


def drug_sql(x: str) -> str:
    bare = f"regexp_replace(lower({x}), '\\b\\d+\\s*(?:mg|g|mcg|ml|mEq)\\b', '', 'g')"
    bare = f"list_reduce(list_prepend({bare}, {b.lst(fv.DOSAGE_FORMS)}), lambda acc, p: replace(acc, p, ''))"
    bare = b.strip_suffix_sql(f"regexp_replace({bare}, '\\([^)]*\\)', '', 'g')", fv.BRAND_SUFFIXES)
    return b.collapse_sql(b.plain_sql(bare))


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split({b.collapse_sql(f'lower({b.plain_sql(x)})')}, ' '), lambda t: t <> '' AND NOT list_contains({b.lst(fv.STOPWORDS)}, t))"


def variations_sql(t: str) -> str:
    """Over a column named t."""
    bare = b.plain_sql(t)
    expand = b.case_sql(f"upper({t})", {k.upper(): [e.lower() for e in v] for k, v in fv.VARIATION_ABBREVIATIONS.items()}, "[]::VARCHAR[]", b.lst)
    shorten: dict = {}
    for k, v in fv.VARIATION_ABBREVIATIONS.items():
        for e in v:
            shorten.setdefault(e.lower(), []).append(k.lower())
    shorter = b.case_sql(f"lower({t})", shorten, "[]::VARCHAR[]", b.lst)
    ws = f"string_split({b.collapse_sql(t)}, ' ')"
    swaps = b.case_sql(f"lower({ws}[i])", fv.WORD_REPLACEMENTS, "[]::VARCHAR[]", b.lst)
    swapped = f"flatten(list_transform(range(1, len({ws}) + 1), lambda i: list_transform({swaps}, lambda r: array_to_string(list_transform(range(1, len({ws}) + 1), lambda j: CASE WHEN i = j THEN r ELSE {ws}[j] END), ' '))))"
    meanings = "[" + ", ".join(f"{{'s': {b.quoted(s)}, 'm': {b.quoted(m)}}}" for s, m in fv.SUFFIX_MEANINGS.items()) + "]"
    rewritten = f"list_transform(list_filter({meanings}, lambda x: ends_with({t}, x.s)), lambda x: substr({t}, 1, length({t}) - length(x.s)) || ' ' || x.m)"
    prefixed = f"list_transform(list_filter({b.lst(fv.VARIATION_PREFIXES)}, lambda p: starts_with({t}, p)), lambda p: substr({t}, length(p) + 1))"
    every = f"list_concat([{t}, {bare}, {b.collapse_sql(bare)}], {prefixed}, {expand}, {shorter}, {swapped}, {rewritten})"
    return f"list_sort(list_distinct(list_filter({every}, lambda v: v <> '')))"


def nrm01_term(spark, d):
    return b.terms(spark, d).select("term_id", nz.normalize_term(F.col("term")).alias("q"))


def nrm02_lab(spark, d):
    return b.terms(spark, d).select("term_id", nz.normalize_lab(F.col("term")).alias("q"))


def nrm03_drug(spark, d):
    return b.terms(spark, d).select("term_id", nz.normalize_drug(F.col("term")).alias("q"))


def nrm04_clean(spark, d):
    return b.terms(spark, d).select("term_id", nz.clean(F.col("term")).alias("q"))


def nrm05_tokens(spark, d):
    return b.notes(spark, d).select("note_id", F.array_join(nz.tokenize(F.col("context")), "|").alias("tokens"))


def nrm07_variations(spark, d):
    return b.terms(spark, d).select("term_id", F.array_join(nz.variations(F.lower("term")), "|").alias("variations"))


def nrm09_is_lab(spark, d):
    return b.terms(spark, d).select("term_id", nz.is_lab_term(F.col("term")).alias("is_lab"))


def nrm10_system_uri(spark, d):
    return b.table(spark, d, "events").select("event_id", nz.system_uri(F.element_at(F.array(*map(F.lit, ("snomed", "LOINC", "RxNorm", "icd10"))), (F.col("event_id") % 4 + 1).cast("int"))).alias("uri"))


def nrm11_clean_text(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.md5(nz.clean_text(b.ascii_text(F.col("text")))).alias("cleaned"))


def nrm12_context_slice(spark, d):
    docs = b.table(spark, d, "documents").withColumn("at", F.instr("text", " ").cast("long"))
    return docs.select("doc_id", nz.context_slice(F.col("text"), F.col("at").cast("int"), (F.col("at") + 5).cast("int")).alias("slice"))


def nrm13_calibrate(spark, d):
    score = (F.col("value") - F.floor("value")) * 0.9 + 0.05
    return b.table(spark, d, "events").select("event_id", F.round(nz.calibrate(score), 6).alias("calibrated"))


def nrm14_bands(spark, d):
    score = F.col("value") - F.floor("value")
    return b.table(spark, d, "events").select("event_id", nz.confidence_band(score).alias("band"), nz.percentage(score).alias("percentage"))


def ext01_terms(spark, d):
    found = ex.extracted_terms(b.notes(spark, d).select("note_id", F.col("context").alias("text")), "note_id")
    return found.select("note_id", "term", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "confidence")


def ext02_entities(spark, d):
    found = ex.has_entity(F.col("context"))
    return b.notes(spark, d).select("note_id", *[c.alias(f"has_{k}") for k, c in found.items()])


def ext02_entity_spans(spark, d):
    spans = b.notes(spark, d).select("note_id", F.explode(ex.entity_spans(F.col("context"))).alias("s"))
    return spans.select("note_id", "s.kind", "s.text", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def ext03_merge(spark, d):
    """Line items as spans of their order: quantity is the length, discount, part and quantity the confidence."""
    items = b.table(spark, d, "lineitem").select("l_orderkey", F.struct((F.col("l_linenumber") * 20).cast("int").alias("start"), (F.col("l_linenumber") * 20 + F.col("l_quantity")).cast("int").alias("end"), (F.round(F.col("l_discount") * 100) * 1000000.0 + F.col("l_partkey") + F.col("l_quantity") / 64).alias("confidence")).alias("s"))
    kept = items.groupBy("l_orderkey").agg(F.collect_list("s").alias("spans")).select("l_orderkey", ex.merged(F.col("spans")).alias("spans"))
    return kept.select("l_orderkey", F.size("spans").cast("long").alias("kept"), F.array_join(F.transform("spans", lambda s: s.start.cast("string")), ",").alias("starts"))


EXT03_SQL = """
WITH RECURSIVE s AS (
  SELECT l_orderkey, (l_linenumber * 20)::INT AS st, (l_linenumber * 20 + l_quantity)::INT AS en, round(l_discount * 100) * 1000000 + l_partkey + l_quantity / 64 AS c,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 20, -(round(l_discount * 100) * 1000000 + l_partkey + l_quantity / 64)) AS rn FROM lineitem),
f AS (
  SELECT l_orderkey, rn, [st] AS starts, en, c FROM s WHERE rn = 1
  UNION ALL
  SELECT s.l_orderkey, s.rn,
         CASE WHEN s.st >= f.en THEN list_append(f.starts, s.st) WHEN s.c > f.c THEN list_append(f.starts[:-2], s.st) ELSE f.starts END,
         CASE WHEN s.st >= f.en OR s.c > f.c THEN s.en ELSE f.en END, CASE WHEN s.st >= f.en OR s.c > f.c THEN s.c ELSE f.c END
  FROM f JOIN s ON s.l_orderkey = f.l_orderkey AND s.rn = f.rn + 1)
SELECT l_orderkey, len(starts)::BIGINT AS kept, array_to_string(starts, ',') AS starts
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rn DESC) AS last FROM f) WHERE last = 1
"""


def ext04_windows(spark, d):
    rows = b.table(spark, d, "documents").select("doc_id", F.explode(ex.windows(F.col("text"))).alias("w"))
    return rows.select("doc_id", F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"), F.md5("w.text").alias("hash"))


EXT04_SQL = """
WITH n AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, text, n, unnest(range(0, CASE WHEN n <= 100 THEN 1 ELSE ceil((n - 100) / 80.0)::BIGINT + 1 END)) * 80 AS st FROM n)
SELECT doc_id, st::BIGINT AS start, least(st + 100, n)::BIGINT AS "end", md5(substr(text, st + 1, 100)) AS hash FROM w
"""


def fuz10_phonetic(spark, d):
    return b.terms(spark, d).select("term_id", F.soundex("term").alias("soundex"), sim.phonetic(F.col("term")).alias("phonetic"))


def _spans_sql(patterns, confidence: str) -> str:
    """Spans of each pattern: where a match starts follows from the pieces between matches and the matches before it."""
    each = " UNION ALL ".join(f"SELECT note_id, {i} AS p, {b.quoted(kind)} AS kind, regexp_extract_all(context, {b.quoted('(?i)' + p)}) AS m, regexp_split_to_array(context, {b.quoted('(?i)' + p)}) AS gaps FROM notes" for i, (kind, p) in enumerate(patterns))
    return f"""found AS (SELECT note_id, p, kind, m, gaps, unnest(range(1, len(m) + 1)) AS i FROM ({each}) WHERE len(m) > 0),
spans AS (SELECT note_id, p, kind, m[i] AS text, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start, {confidence} AS confidence FROM found)"""


EXT01_SQL = f"""WITH {b.NOTES}, {_spans_sql([('PATTERN_MATCH', p) for p in fv.TERM_PATTERNS], '0.7::DOUBLE')}
SELECT note_id, text AS term, start, start + length(text) AS "end", confidence FROM (SELECT *, row_number() OVER (PARTITION BY note_id, text ORDER BY p, start) AS n FROM spans) WHERE n = 1"""
EXT02_SPANS_SQL = f"""WITH {b.NOTES}, {_spans_sql([(k, p) for k, ps in fv.ENTITY_PATTERNS.items() for p in ps], '1.0::DOUBLE')}
SELECT note_id, kind, text, start, start + length(text) AS "end" FROM spans"""


QUERIES = {f.__name__: f for f in (nrm01_term, nrm02_lab, nrm03_drug, nrm04_clean, nrm05_tokens, nrm07_variations, nrm09_is_lab, nrm10_system_uri, nrm11_clean_text, nrm12_context_slice, nrm13_calibrate, nrm14_bands, ext01_terms, ext02_entities, ext02_entity_spans, ext03_merge, ext04_windows, fuz10_phonetic)}

SQL = {
    "nrm01_term": f"WITH {b.TERMS} SELECT term_id, {term_sql('term')} AS q FROM terms",
    "nrm02_lab": f"WITH {b.TERMS} SELECT term_id, {lab_sql('term')} AS q FROM terms",
    "nrm03_drug": f"WITH {b.TERMS} SELECT term_id, {drug_sql('term')} AS q FROM terms",
    "nrm04_clean": f"WITH {b.TERMS} SELECT term_id, {b.collapse_sql('lower(term)')} AS q FROM terms",
    "nrm05_tokens": f"WITH {b.NOTES} SELECT note_id, array_to_string({tokens_sql('context')}, '|') AS tokens FROM notes",
    "nrm07_variations": f"WITH {b.TERMS} SELECT term_id, array_to_string({variations_sql('t')}, '|') AS variations FROM (SELECT term_id, lower(term) AS t FROM terms)",
    "nrm09_is_lab": f"WITH {b.TERMS} SELECT term_id, len(list_filter({b.lst(fv.LAB_KEYWORDS)}, lambda k: contains(lower(term), k))) > 0 AS is_lab FROM terms",
    "nrm10_system_uri": f"SELECT event_id, {b.case_sql('lower((' + b.lst(('snomed', 'LOINC', 'RxNorm', 'icd10')) + ')[event_id % 4 + 1])', fv.SYSTEM_URIS, b.quoted('unknown'))} AS uri FROM events",
    "nrm11_clean_text": f"SELECT doc_id, md5(regexp_replace(t, '[^\\w\\s\\-.,:;()%/]', '', 'g')) AS cleaned FROM (SELECT doc_id, {b.ASCII_SQL} AS t FROM documents)",
    "nrm12_context_slice": "SELECT doc_id, substr(text, greatest(a - 50, 0) + 1, least(a + 5 + 50, length(text)) - greatest(a - 50, 0)) AS slice FROM (SELECT doc_id, text, instr(text, ' ') AS a FROM documents)",
    "nrm13_calibrate": "SELECT event_id, round(1 / (1 + exp(-ln(s / (1 - s + 1e-8)) / 1.5)), 6) AS calibrated FROM (SELECT event_id, (value - floor(value)) * 0.9::DOUBLE + 0.05::DOUBLE AS s FROM events)",
    "nrm14_bands": "SELECT event_id, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.6 THEN 'medium' WHEN s >= 0.4 THEN 'low' ELSE 'very_low' END AS band, round(s * 100)::BIGINT AS percentage FROM (SELECT event_id, value - floor(value) AS s FROM events)",
    "ext02_entities": f"WITH {b.NOTES} SELECT note_id, " + ", ".join(f"regexp_matches(context, {b.quoted('(?i)' + '|'.join(p))}) AS has_{k}" for k, p in fv.ENTITY_PATTERNS.items()) + " FROM notes",
    "ext01_terms": EXT01_SQL,
    "ext02_entity_spans": EXT02_SPANS_SQL,
    "ext03_merge": EXT03_SQL,
    "ext04_windows": EXT04_SQL,
}
