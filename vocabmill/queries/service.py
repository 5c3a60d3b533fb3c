"""Statistics, pagination, documents and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as do, stats as st
from . import base as b
from .match import SYN, synonyms


def agg01_concept_counts(spark, d):
    every = b.conditions(spark, d).select(F.lit("snomed").alias("system"), "term").unionByName(b.labs(spark, d).select(F.lit("loinc").alias("system"), "term")).unionByName(b.drugs(spark, d).select(F.lit("rxnorm").alias("system"), "term"))
    return st.concept_counts(every)


def agg02_synonym_counts(spark, d):
    return st.synonym_counts(synonyms(spark))


def _results(spark, d):
    """Order lines as mapping results."""
    return b.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_quantity > 5 AS found", "l_discount * 10 AS confidence", "l_tax * 10 AS context_score", "l_linenumber - 1 AS alternatives", "l_linenumber AS mappings", "l_extendedprice / 1000 AS seconds", "l_returnflag", "array(l_returnflag, l_linestatus) AS modifiers")


def agg03_context_stats(spark, d):
    return st.context_statistics(_results(spark, d))


AGG03_SQL = """SELECT count(*) AS total, count(*) FILTER (l_quantity > 5) AS successful, round(count(*) FILTER (l_quantity > 5) / count(*)::DOUBLE, 6) AS success_rate, round(avg(l_discount * 10) FILTER (l_quantity > 5), 6) AS avg_confidence,
round(avg(l_tax * 10) FILTER (l_quantity > 5), 6) AS avg_context_score, count(*) FILTER (l_linenumber > 1) AS with_alternatives FROM lineitem"""


def agg03_modifier_histogram(spark, d):
    return st.histogram(_results(spark, d), "modifiers")


def agg04_mapping_stats(spark, d):
    return st.mapping_statistics(_results(spark, d))


AGG04_SQL = """SELECT count(*) AS total_terms, sum(l_linenumber)::BIGINT AS total_mappings, round(avg(l_linenumber), 6) AS avg_mappings, round(avg(l_discount * 10), 3) AS avg_confidence, round(avg(l_extendedprice / 1000), 4) AS avg_seconds,
count(*) FILTER (l_discount * 10 >= 0.8) AS high, count(*) FILTER (l_discount * 10 >= 0.5 AND l_discount * 10 < 0.8) AS medium, count(*) FILTER (l_discount * 10 < 0.5) AS low FROM lineitem"""


def agg05_batch_totals(spark, d):
    rows = b.table(spark, d, "events").selectExpr("user_id AS job_id", "event_id AS term_id", "CAST(floor(value) AS BIGINT) % 4 AS n_matches", "ts AS started", "ts AS ended")
    return st.batch_totals(rows)


AGG05_SQL = """SELECT user_id AS job_id, count(*) AS total, count(*) FILTER (floor(value)::BIGINT % 4 > 0) AS successful, count(*) FILTER (floor(value)::BIGINT % 4 = 0) AS failed, sum(floor(value)::BIGINT % 4)::BIGINT AS total_matches,
(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS seconds FROM events GROUP BY 1"""


def agg07_document_batches(spark, d):
    rows = b.table(spark, d, "events").selectExpr("user_id AS batch_id", "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status", "ts AS started", "ts + INTERVAL 90 SECONDS AS ended")
    return do.batch_status(rows)


AGG07_SQL = """SELECT user_id AS batch_id, count(*) AS total, count(*) FILTER (event_type NOT IN ('view', 'click')) AS processed, count(*) FILTER (event_type IN ('signup', 'purchase')) AS successful, count(*) FILTER (event_type = 'error') AS failed,
round(100.0::DOUBLE * count(*) FILTER (event_type NOT IN ('view', 'click')) / count(*), 6) AS progress, CASE WHEN count(*) FILTER (event_type NOT IN ('view', 'click')) > 0 THEN 90.0::DOUBLE END AS avg_seconds FROM events GROUP BY 1"""


def agg09_term_status(spark, d):
    return b.table(spark, d, "events").select("event_id", st.term_status(F.floor("value").cast("long") % 3, F.when(F.col("event_type") == "error", "boom")).alias("status"))


def srt03_list_documents(spark, d):
    """A page is the feature: the third page of 50, by largest text."""
    docs = b.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return st.page(docs, [F.desc("n_chars"), F.col("doc_id")], 3, 50)


def srt04_job_results(spark, d):
    rows = b.table(spark, d, "events").selectExpr("user_id AS job_id", "event_id")
    return st.job_results(rows, ["event_id"], 20, 5).select("job_id", "event_id", F.col("rn").cast("long").alias("rn"))


SRT04_SQL = """SELECT user_id AS job_id, event_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
WHERE rn > 5 AND rn <= CASE WHEN n <= 100 THEN n ELSE 25 END"""


def snk04_flatten(spark, d):
    """Orders as results: a map of line status to lists of matches; orders of status P have none."""
    lines = b.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.sort_array(F.collect_list(F.struct(F.col("l_partkey").cast("string").alias("code"), F.concat(F.lit("part "), F.col("l_partkey")).alias("display"), F.col("l_discount").alias("confidence")))).alias("m"))
    maps = lines.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "m"))).alias("results"))
    orders = b.table(spark, d, "orders").join(maps, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    shaped = orders.select(F.col("o_orderkey").alias("term_id"), F.col("o_orderpriority").alias("term"), F.when(F.col("o_orderstatus") != "P", F.col("results")).alias("results"))
    return st.flattened(shaped)


SNK04_SQL = """SELECT o_orderkey AS term_id, o_orderpriority AS term, l_linestatus AS system, l_partkey::VARCHAR AS code, 'part ' || l_partkey AS display, l_discount AS confidence
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND o_orderstatus <> 'P'"""


def snk05_export(spark, d):
    rows = b.table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.format_string("%.3f", F.col("l_discount") + 0.0004).alias("confidence"))


def snk06_document_export(spark, d):
    docs = b.table(spark, d, "documents").selectExpr("doc_id", "text", "CASE WHEN doc_id % 9 = 0 THEN 'failed' ELSE 'completed' END AS status")
    return do.exported(docs, False, False).select("doc_id", "status", F.md5("text").alias("text_hash"))


def val01_clean(spark, d):
    rows = b.table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END AS code", "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS display", "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'snomed' END AS system")
    return st.valid(rows)


VAL01_SQL = "SELECT c_custkey, c_name AS code, c_mktsegment AS display, 'snomed' AS system FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0"


def val04_legacy_filter(spark, d):
    rows = b.table(spark, d, "lineitem").selectExpr("l_orderkey AS term_id", "'snomed' AS system", "concat(l_partkey, '-', l_suppkey, '-', l_linenumber) AS code", "l_quantity / 50 AS confidence")
    return st.legacy_filter(rows, "snomed", 0.5, 2).select("term_id", "code", F.col("rank").cast("long").alias("rank"))


VAL04_SQL = """SELECT term_id, code, rank FROM (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY confidence DESC, code) AS rank FROM
(SELECT l_orderkey AS term_id, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS code, l_quantity / 50 AS confidence FROM lineitem) WHERE confidence >= 0.5) WHERE rank <= 2"""


def val06_size_limit(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", (F.col("n_chars") * 10000).alias("size"), F.element_at(F.array(*map(F.lit, ("pdf", "docx", "txt", "hl7", "exe"))), (F.col("doc_id") % 5 + 1).cast("int")).alias("kind"))
    return docs.select("doc_id", do.fits_size(F.col("size"), F.col("kind")).alias("fits"))


def val09_unsupported(spark, d):
    system = F.element_at(F.array(*map(F.lit, ("snomed", "ICD10", "loinc"))), (F.col("term_id") % 3 + 1).cast("int"))
    return st.unsupported(b.terms(spark, d), system, ("snomed", "loinc", "rxnorm"))


VAL09_SQL = f"WITH {b.TERMS} SELECT term_id, FALSE AS found, CASE WHEN trim(term) = '' THEN 'Empty term' ELSE 'Unsupported system: ICD10' END AS error FROM terms WHERE trim(term) = '' OR term_id % 3 = 1"


def doc01_progress(spark, d):
    status = F.element_at(F.array(*map(F.lit, ("pending", "processing", "extracted", "completed", "failed", "odd"))), (F.col("event_id") % 6 + 1).cast("int"))
    p = do.progress(status)
    return b.table(spark, d, "events").select("event_id", p["progress"].cast("long").alias("progress"), p["step"].alias("step"))


def doc02_metadata(spark, d):
    return b.table(spark, d, "events").withColumnRenamed("props", "metadata").select("event_id", do.metadata(F.col("metadata"), "$.k").cast("long").alias("k"))


def doc03_update(spark, d):
    docs = b.table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), "c_name", "c_mktsegment")
    changes = b.table(spark, d, "supplier").selectExpr("s_suppkey AS document_id", "s_name AS c_name", "CAST(NULL AS STRING) AS c_mktsegment")
    return do.updated(docs, changes)


def doc05_delete(spark, d):
    docs = b.table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), "c_name")
    return do.deleted(docs, b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("document_id")))


def doc06_checksum(spark, d):
    return do.first_of_checksum(b.table(spark, d, "documents"), F.col("text"))


DOC06_SQL = "SELECT doc_id, c AS checksum, CASE WHEN f <> doc_id THEN f END AS duplicate_of FROM (SELECT doc_id, sha256(text) AS c, min(doc_id) OVER (PARTITION BY sha256(text)) AS f FROM documents)"


QUERIES = {
    f.__name__: f
    for f in (
        agg01_concept_counts, agg02_synonym_counts, agg03_context_stats, agg03_modifier_histogram, agg04_mapping_stats, agg05_batch_totals, agg07_document_batches, agg09_term_status, srt03_list_documents, srt04_job_results,
        snk04_flatten, snk05_export, snk06_document_export, val01_clean, val04_legacy_filter, val06_size_limit, val09_unsupported, doc01_progress, doc02_metadata, doc03_update, doc05_delete, doc06_checksum,
    )
}
SQL = {
    "agg01_concept_counts": f"WITH {b.CONDITIONS}, {b.LABS}, {b.DRUGS} SELECT system, count(*) AS n_concepts, count(DISTINCT term) AS n_terms FROM (SELECT 'snomed' AS system, term FROM conditions UNION ALL SELECT 'loinc', term FROM labs UNION ALL SELECT 'rxnorm', term FROM drugs) GROUP BY 1",
    "agg02_synonym_counts": f"WITH {SYN} SELECT count(DISTINCT set_key) AS n_sets, count(synonym) AS n_terms FROM synonyms",
    "agg03_context_stats": AGG03_SQL,
    "agg03_modifier_histogram": "SELECT value, count(*) AS n FROM (SELECT l_returnflag AS value FROM lineitem UNION ALL SELECT l_linestatus FROM lineitem) GROUP BY 1",
    "agg04_mapping_stats": AGG04_SQL,
    "agg05_batch_totals": AGG05_SQL,
    "agg07_document_batches": AGG07_SQL,
    "agg09_term_status": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN floor(value)::BIGINT % 3 > 0 THEN 'success' ELSE 'no_mappings' END AS status FROM events",
    "srt03_list_documents": "SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 100",
    "srt04_job_results": SRT04_SQL,
    "snk04_flatten": SNK04_SQL,
    "snk05_export": "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, printf('%.3f', l_discount + 0.0004::DOUBLE) AS confidence FROM lineitem",
    "snk06_document_export": "SELECT doc_id, 'completed' AS status, md5(substr(text, 1, 1000)) AS text_hash FROM documents WHERE doc_id % 9 <> 0",
    "val01_clean": VAL01_SQL,
    "val04_legacy_filter": VAL04_SQL,
    "val06_size_limit": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN n_chars * 10000 <= 52428800 WHEN 1 THEN n_chars * 10000 <= 26214400 WHEN 2 THEN n_chars * 10000 <= 10485760 WHEN 3 THEN n_chars * 10000 <= 5242880 ELSE FALSE END AS fits FROM documents",
    "val09_unsupported": VAL09_SQL,
    "doc01_progress": "SELECT event_id, ([0, 50, 80, 100, 100, 0])[event_id % 6 + 1]::BIGINT AS progress, (['queued', 'extracting', 'mapping', 'done', 'failed', 'unknown'])[event_id % 6 + 1] AS step FROM events",
    "doc02_metadata": "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events",
    "doc03_update": "SELECT c_custkey AS document_id, coalesce(s_name, c_name) AS c_name, c_mktsegment FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
    "doc05_delete": "SELECT c_custkey AS document_id, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "doc06_checksum": DOC06_SQL,
}
