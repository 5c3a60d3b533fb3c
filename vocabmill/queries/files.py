"""Sources and sinks: the driver's tables written by a sink or as a user's file would be, and read back by a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.staging import new_folder
from ..operators import documents as do, rules as ru, stats as st
from ..sources import readers, writers
from ..streaming import jobs
from . import base as b


def _one_object_a_file(df, column: str, spark, name: str) -> str:
    """The path of files that hold one value of the column each."""
    path = new_folder(spark, name)
    df.select(F.monotonically_increasing_id().alias("n"), column).write.partitionBy("n").text(path)
    return path


def src01_table(spark, d):
    """A table that is there and one that isn't."""
    there = readers.table(spark, f"{d}/nation.parquet", "n_nationkey int, n_name string, n_regionkey int")
    return there.unionByName(readers.table(spark, new_folder(spark, "nothing"), "n_nationkey int, n_name string, n_regionkey int"))


def src02_contract(spark, d):
    """Lines by their key, lines by their order, and parts with a column too few."""
    lines, parts = b.table(spark, d, "lineitem"), b.table(spark, d, "part")
    asked = (("lines", lines, "l_orderkey long, l_linenumber int", ["l_orderkey", "l_linenumber"]), ("orders", lines, "l_orderkey long", ["l_orderkey"]), ("parts", parts, "p_partkey long, p_nothing string", ["p_partkey"]))
    every = [readers.contract(rows, schema, key).withColumn("name", F.lit(name)) for name, rows, schema, key in asked]
    return every[0].unionByName(every[1]).unionByName(every[2])


SRC02_SQL = """WITH l AS (SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS k, count(DISTINCT l_orderkey) AS o FROM lineitem)
SELECT 'lines' AS name, n::BIGINT AS n_rows, k::BIGINT AS n_keys, 0::BIGINT AS null_keys, '' AS missing, n = k AS fits FROM l UNION ALL SELECT 'orders', n::BIGINT, o::BIGINT, 0, '', n = o FROM l
UNION ALL SELECT 'parts', count(*)::BIGINT, count(DISTINCT p_partkey)::BIGINT, 0, 'p_nothing', FALSE FROM part"""


def src04_csv_terms(spark, d):
    """Turns of conversations as a CSV column, with commas, quotes and line ends; null and empty ones are dropped."""
    path = new_folder(spark, "csv")
    rows = b.table(spark, d, "conversations").selectExpr("conv_id AS first", "CASE WHEN turn % 5 = 4 THEN NULL WHEN turn % 5 = 3 THEN '' ELSE concat(text, ', \"quoted\"\nnext') END AS term")
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.terms(spark, path, "csv").groupBy("term").agg(F.count("*").alias("n"))


def _json_terms(spark, d, item):
    grouped = b.table(spark, d, "part").groupBy((F.col("p_partkey") % 7).alias("g")).agg(F.to_json(F.collect_list(item)).alias("value"))
    return readers.terms(spark, _one_object_a_file(grouped, "value", spark, "json"), "json").groupBy("term").agg(F.count("*").alias("n"))


def src05_json_strings(spark, d):
    return _json_terms(spark, d, F.concat(F.col("p_name"), F.lit(' "é", {x}')))


def src05_json_objects(spark, d):
    return _json_terms(spark, d, F.struct(F.when(F.col("p_size") > 5, F.col("p_name")).alias("term"), F.col("p_type").alias("context")))


def src07_text_terms(spark, d):
    """Lines of text; blank ones are dropped."""
    path = new_folder(spark, "txt")
    b.table(spark, d, "part").selectExpr("CASE WHEN p_partkey % 9 = 0 THEN '   ' ELSE concat('  ', p_name, ' ') END AS value").write.text(path)
    return readers.terms(spark, path, "txt").groupBy("term").agg(F.count("*").alias("n"))


def src09_custom_mappings(spark, d):
    """A JSON object of objects: brands as vocabularies, parts as terms."""
    entry = F.struct(F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey")).alias("key"), F.struct(F.col("p_partkey").cast("string").alias("code"), F.col("p_type").alias("display"), F.lit(True).alias("found")).alias("value"))
    by_brand = b.table(spark, d, "part").groupBy("p_brand").agg(F.map_from_entries(F.collect_list(entry)).alias("terms"))
    whole = by_brand.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", "terms")))).alias("value"))
    return readers.custom_mappings(spark, _one_object_a_file(whole, "value", spark, "custom"))


SRC09_SQL = "SELECT p_brand AS system, p_name || ' ' || p_partkey AS term, p_partkey::VARCHAR AS code, p_type AS display FROM part"


def _sets(spark, d):
    return b.table(spark, d, "part").groupBy(F.concat(F.lit("set_"), F.col("p_size")).alias("set_key")).agg(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x.p_name).alias("synonyms"))


def snk03_synonyms(spark, d):
    """Synonym sets written by the sink and read by the source."""
    path = new_folder(spark, "synonyms")
    writers.synonyms_json(_sets(spark, d), path)
    return readers.synonym_sets(spark, path).select("set_key", F.col("position").cast("long").alias("position"), "synonym")


SNK03_SQL = "SELECT 'set_' || p_size AS set_key, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS position, p_name AS synonym FROM part"


def src12_abbreviations(spark, d):
    """The second of three files is there: segments as abbreviations of their nations' customers."""
    longer = F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x.c_name)
    entries = b.table(spark, d, "customer").groupBy(F.concat(F.upper("c_mktsegment"), F.col("c_nationkey")).alias("key")).agg(longer.alias("value"))
    whole = entries.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("abbreviations"))).alias("value"))
    path = _one_object_a_file(whole, "value", spark, "abbreviations")
    return readers.abbreviations(spark, [new_folder(spark, "none"), path, "file:///nothing"]).select("short", F.col("position").cast("long").alias("position"), "expanded_term")


SRC12_SQL = "SELECT lower(c_mktsegment || c_nationkey) AS short, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) - 1 AS position, c_name AS expanded_term FROM customer"


def fuz08_thresholds(spark, d):
    """A configuration that sets two thresholds by the number of nations, and one that nothing knows."""
    own = b.table(spark, d, "nation").agg(F.to_json(F.struct(F.struct((F.count("*") * 3.0).alias("ratio"), (F.count("*") / 50.0).alias("jaccard"), F.lit(1.0).alias("other")).alias("matching"), F.lit("x").alias("version"))).alias("value"))
    return readers.thresholds(spark, _one_object_a_file(own, "value", spark, "config"))


FUZ08_SQL = f"SELECT name, CASE name WHEN 'ratio' THEN 3.0 * (SELECT count(*) FROM nation) WHEN 'jaccard' THEN (SELECT count(*) FROM nation) / 50.0 ELSE built_in END::DOUBLE AS value FROM {b.values(list(fv.THRESHOLDS.items()), 'name, built_in')}"


def _part_rules(spark, d):
    """Parts as rules; those of size 13 have no display, patterns of size 14 don't compile."""
    rows = b.table(spark, d, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS rule_id", "element_at(array('exact', 'pattern', 'context', 'domain', 'override'), p_size % 5 + 1) AS rule_type", "p_size % 4 + 1 AS priority", "p_name AS source_term", "p_brand AS target_code",
        "'snomed' AS target_system", "CASE WHEN p_size = 13 THEN ' ' ELSE p_type END AS target_display", "CASE WHEN p_size % 5 = 3 AND p_size < 40 THEN map('domain', p_brand) WHEN p_size % 5 = 2 AND p_size < 30 THEN map('required:place', 'x') WHEN p_size % 10 = 1 THEN map('pattern', '((') ELSE map('note', 'n') END AS conditions",
        "CAST(NULL AS STRING) AS metadata", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(p_partkey % 100) AS created_at", "TIMESTAMP_NTZ '2024-06-01 00:00:00' AS updated_at", "'me' AS created_by", "p_partkey % 6 <> 0 AS is_active",
    )
    return rows


PART_RULES = """rules AS (SELECT p_partkey::VARCHAR AS rule_id, (['exact', 'pattern', 'context', 'domain', 'override'])[p_size % 5 + 1] AS rule_type, p_size % 4 + 1 AS priority, p_name AS source_term, p_partkey % 100 AS day, p_partkey % 6 <> 0 AS is_active,
  CASE WHEN p_size = 13 THEN 'missing target_display' END AS e1, CASE WHEN p_size % 5 = 1 AND p_size % 10 = 1 THEN 'pattern doesn''t compile' END AS e2,
  CASE WHEN p_size % 5 = 2 AND NOT p_size < 30 THEN 'no required context' END AS e3, CASE WHEN p_size % 5 = 3 AND NOT p_size < 40 THEN 'no domain' END AS e4 FROM part),
checked AS (SELECT *, array_to_string(list_filter([e1, e2, e3, e4], lambda e: e IS NOT NULL), '; ') AS errors FROM rules)"""


def snk01_src14_rules(spark, d):
    """Rules written by the sink and read by the source, which parts valid from invalid ones."""
    path = new_folder(spark, "rules")
    writers.rules_json(_part_rules(spark, d), path)
    valid, invalid = readers.rules_json(spark, path)
    both = valid.withColumn("errors", F.lit("")).unionByName(invalid.withColumn("errors", F.array_join("errors", "; ")))
    return both.select("rule_id", "rule_type", F.col("priority").cast("long").alias("priority"), "source_term", "errors")


def rul06_rules_array(spark, d):
    """Rules as one JSON list a file, inactive ones among them."""
    listed = _part_rules(spark, d).withColumn("conditions", F.to_json("conditions")).groupBy("rule_type").agg(F.to_json(F.collect_list(F.struct("rule_id", "rule_type", "priority", "source_term", "target_code", "target_system", "target_display", "conditions", "is_active"))).alias("value"))
    valid, _ = readers.rules_json(spark, _one_object_a_file(listed, "value", spark, "rules"))
    return valid.select("rule_id", F.array_join(F.map_values("conditions"), ",").alias("conditions"), "is_active")


RUL06_SQL = f"""WITH {PART_RULES} SELECT c.rule_id, CASE WHEN p_size % 5 = 3 AND p_size < 40 THEN p_brand WHEN p_size % 5 = 2 AND p_size < 30 THEN 'x' WHEN p_size % 10 = 1 THEN '((' ELSE 'n' END AS conditions, c.is_active
FROM checked c JOIN part ON p_partkey::VARCHAR = rule_id WHERE errors = ''"""


def src13_active_rules(spark, d):
    """The rule table's scan; the order is shown as each rule's place."""
    path = new_folder(spark, "rules")
    _part_rules(spark, d).write.parquet(path)
    placed = readers.active_rules(spark, path).select("rule_id", F.monotonically_increasing_id().alias("at"))
    least = placed.withColumn("partition", F.shiftright("at", 33))
    sizes = least.groupBy("partition").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("c"), F.col("c.partition") < F.col("a.partition"), "left").groupBy("a.partition").agg(F.coalesce(F.sum("c.n"), F.lit(0)).alias("before"))
    return least.join(before, "partition").select("rule_id", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"))


SRC13_SQL = f"WITH {PART_RULES} SELECT rule_id, row_number() OVER (ORDER BY priority, day, rule_id) AS place FROM rules WHERE is_active"


def val03_part_rules(spark, d):
    return _part_rules(spark, d).select("rule_id", F.array_join(ru.errors(_part_rules(spark, d)), "; ").alias("errors"))


def snk02_upsert(spark, d):
    """Every part is a custom mapping; those of the first brand are mapped anew, and suppliers are added."""
    custom = b.table(spark, d, "part").selectExpr("'snomed' AS system", "concat(p_name, ' ', p_partkey) AS term", "CAST(p_partkey AS STRING) AS code", "p_type AS display")
    again = b.table(spark, d, "part").where("p_brand < 'Brand#3'").selectExpr("'snomed' AS system", "concat(p_name, ' ', p_partkey) AS term", "'new' AS code", "p_brand AS display")
    return writers.upserted(custom, again.unionByName(b.table(spark, d, "supplier").selectExpr("'snomed' AS system", "s_name AS term", "'s' AS code", "s_name AS display")))


SNK02_SQL = """SELECT 'snomed' AS system, p_name || ' ' || p_partkey AS term, CASE WHEN p_brand < 'Brand#3' THEN 'new' ELSE p_partkey::VARCHAR END AS code, CASE WHEN p_brand < 'Brand#3' THEN p_brand ELSE p_type END AS display FROM part
UNION ALL SELECT 'snomed', s_name, 's', s_name FROM supplier"""


def snk05_quoted_csv(spark, d):
    """The export's file as text: all values quoted, confidences to three decimals."""
    path = new_folder(spark, "quoted")
    flat = b.table(spark, d, "lineitem").where("l_linenumber = 1").selectExpr("concat('term \"', l_orderkey, '\", x') AS term", "CAST(l_partkey AS STRING) AS code", "l_discount + 0.0004 AS confidence")
    writers.quoted_csv(flat, path)
    return spark.read.text(path).select(F.col("value").alias("line")).where("line <> '\"term\",\"code\",\"confidence\"'")


SNK05_SQL = """SELECT '"term \\"' || l_orderkey || '\\", x","' || l_partkey || '","' || printf('%.3f', l_discount + 0.0004::DOUBLE) || '"' AS line FROM lineitem WHERE l_linenumber = 1"""


def src15_catalogue(spark, d):
    """Names of nations as files: how many, and their bytes."""
    path = _one_object_a_file(b.table(spark, d, "nation").select(F.col("n_name").alias("value")), "value", spark, "files")
    return readers.file_catalogue(spark, f"{path}/*/*.txt").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def snk07_received(spark, d):
    """Names of nations as files of a folder, received as documents; every second one claims to be a PDF."""
    path = _one_object_a_file(b.table(spark, d, "nation").select(F.col("n_name").alias("value")), "value", spark, "files")
    kind = F.when(F.length("content") % 2 == 0, "pdf").otherwise("txt")
    rows = do.received(spark.read.format("binaryFile").load(f"{path}/*/*.txt"), kind)
    return rows.select("document_type", "file_size", "checksum", "status", (F.length("document_id") == 36).alias("has_id"))


SNK07_SQL = "SELECT CASE WHEN (length(n_name) + 1) % 2 = 0 THEN 'pdf' ELSE 'txt' END AS document_type, (length(n_name) + 1)::BIGINT AS file_size, sha256(n_name || chr(10)) AS checksum, CASE WHEN (length(n_name) + 1) % 2 = 0 THEN 'failed' ELSE 'pending' END AS status, TRUE AS has_id FROM nation"

_HEADS = ("%PDF-1.7 ", "PK\x03\x04", "{\\rtf1 ", "plain ")


def val05_file_type(spark, d):
    """Documents behind the first bytes of four types, each claimed to be of one of six."""
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.col("doc_id") % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("pdf", "docx", "rtf", "txt", "hl7", "exe"))), (F.floor(F.col("doc_id") / 4) % 6 + 1).cast("int"))
    return b.table(spark, d, "documents").select("doc_id", do.fits_type(F.encode(F.concat(head, F.col("text")), "UTF-8"), kind).alias("fits"))


VAL05_SQL = """SELECT doc_id, CASE (doc_id // 4) % 6 WHEN 0 THEN doc_id % 4 = 0 WHEN 1 THEN doc_id % 4 = 1 WHEN 2 THEN doc_id % 4 = 2 WHEN 3 THEN doc_id % 4 = 3 WHEN 4 THEN doc_id % 4 = 3 ELSE FALSE END AS fits FROM documents"""


def val07_confidence(spark, d):
    return b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", do.checked_confidence(F.col("l_discount")).alias("confidence"))


def agg10_observed(spark, d):
    """Counters that are filled as results pass to a sink."""
    rows, seen = st.observed(b.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_quantity > 5 AS found"))
    rows.write.parquet(new_folder(spark, "observed"))
    return spark.createDataFrame([(seen.get["processed"], seen.get["found"])], "processed long, found long")


def str01_first_seen(spark, d):
    """Terms as a stream of files: each is let through once."""
    path, out, cp = (new_folder(spark, x) for x in ("stream", "out", "progress"))
    rows = b.table(spark, d, "part").selectExpr("p_partkey AS term_id", "CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE concat(' ', p_name) END AS term", "TIMESTAMP '2024-01-01 00:00:00' AS ts")
    rows.repartition(3).write.json(path)
    jobs.run(jobs.first_seen(jobs.term_stream(spark, path, 1)), lambda df: df.select("key"), out, cp).awaitTermination()
    return spark.read.parquet(out).select("key")


QUERIES = {
    f.__name__: f
    for f in (
        src01_table, src02_contract, src04_csv_terms, src05_json_strings, src05_json_objects, src07_text_terms, src09_custom_mappings, snk03_synonyms, src12_abbreviations, fuz08_thresholds, snk01_src14_rules, rul06_rules_array, src13_active_rules, val03_part_rules,
        snk02_upsert, snk05_quoted_csv, src15_catalogue, snk07_received, val05_file_type, val07_confidence, agg10_observed, str01_first_seen,
    )
}
SQL = {
    "src01_table": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "src02_contract": SRC02_SQL,
    "src04_csv_terms": "SELECT text || ', \"quoted\"' || chr(10) || 'next' AS term, count(*) AS n FROM conversations WHERE turn % 5 < 3 AND text IS NOT NULL GROUP BY 1",
    "src05_json_strings": "SELECT p_name || ' \"é\", {x}' AS term, count(*) AS n FROM part GROUP BY 1",
    "src05_json_objects": "SELECT p_name AS term, count(*) AS n FROM part WHERE p_size > 5 GROUP BY 1",
    "src07_text_terms": "SELECT p_name AS term, count(*) AS n FROM part WHERE p_partkey % 9 <> 0 GROUP BY 1",
    "src09_custom_mappings": SRC09_SQL,
    "snk03_synonyms": SNK03_SQL,
    "src12_abbreviations": SRC12_SQL,
    "fuz08_thresholds": FUZ08_SQL,
    "snk01_src14_rules": f"WITH {PART_RULES} SELECT rule_id, rule_type, priority::BIGINT AS priority, source_term, errors FROM checked WHERE is_active",
    "rul06_rules_array": RUL06_SQL,
    "src13_active_rules": SRC13_SQL,
    "val03_part_rules": f"WITH {PART_RULES} SELECT rule_id, errors FROM checked",
    "snk02_upsert": SNK02_SQL,
    "snk05_quoted_csv": SNK05_SQL,
    "src15_catalogue": "SELECT count(*) AS files, sum(length(n_name) + 1)::BIGINT AS bytes FROM nation",
    "snk07_received": SNK07_SQL,
    "val05_file_type": VAL05_SQL,
    "val07_confidence": "SELECT l_orderkey, l_linenumber, l_discount AS confidence FROM lineitem",
    "agg10_observed": "SELECT count(*) AS processed, count(*) FILTER (l_quantity > 5) AS found FROM lineitem",
    "str01_first_seen": "SELECT DISTINCT lower(trim(p_name)) AS key FROM part",
}
