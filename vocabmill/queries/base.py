"""The engine's tables over the driver's, in Spark and in SQL.

Concepts come from ``part`` and from literal clinical rows; terms are part
names as users would write them, and literal clinical terms with context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CLINICAL_CONDITIONS = [
    (1000000001, "73211009", "diabetes mellitus", "Diabetes mellitus (disorder)", "disorder", 1),
    (1000000002, "44054006", "type 2 diabetes mellitus", "Diabetes mellitus type 2 (disorder)", "disorder", 1),
    (1000000003, "38341003", "hypertension", "Hypertensive disorder (disorder)", "disorder", 1),
    (1000000004, "22298006", "myocardial infarction", "Myocardial infarction (disorder)", "disorder", 1),
    (1000000005, "195967001", "asthma", "Asthma (disorder)", "disorder", 1),
    (1000000006, "233604007", "pneumonia", "Pneumonia (disorder)", "disorder", 1),
    (1000000007, "29857009", "chest pain", "Chest pain (finding)", "finding", 1),
    (1000000008, "13645005", "chronic obstructive pulmonary disease", "COPD (disorder)", "disorder", 1),
    (1000000009, "84114007", "heart failure", "Heart failure (disorder)", "disorder", 1),
    (1000000010, "25064002", "headache", "Headache (finding)", "finding", 0),
]
CLINICAL_LABS = [
    (1000000001, "2339-0", "glucose [mass/volume] in blood", "Glucose [Mass/volume] in Blood", "Glucose", "Blood", None, "Glucose, blood"),
    (1000000002, "2951-2", "sodium [moles/volume] in serum", "Sodium [Moles/volume] in Serum", "Sodium", "Serum", None, "Sodium, serum"),
    (1000000003, "4548-4", "hemoglobin a1c", "Hemoglobin A1c in Blood", "Hemoglobin A1c", "Blood", None, "Hemoglobin A1c"),
    (1000000004, "2160-0", "creatinine [mass/volume] in serum", "Creatinine in Serum", "Creatinine", "Serum", "Jaffe", "Creatinine, serum"),
    (1000000005, "718-7", "hemoglobin [mass/volume] in blood", "Hemoglobin in Blood", "Hemoglobin", "Blood", None, "Hemoglobin, blood"),
]
CLINICAL_DRUGS = [
    (1000000001, "29046", "lisinopril", "lisinopril", "IN", None, "lisinopril", None, 1),
    (1000000002, "6809", "metformin", "metformin", "IN", None, "metformin", None, 1),
    (1000000003, "1191", "aspirin", "aspirin", "IN", None, "aspirin", None, 1),
    (1000000004, "203644", "zestril", "Zestril", "BN", "Zestril", "lisinopril", "10 mg", 1),
    (1000000005, "5640", "ibuprofen", "ibuprofen", "IN", None, "ibuprofen", None, 0),
]
CLINICAL_TERMS = [
    (1000000001, "Diabetes Mellitus", "patient diagnosed with diabetes, glucose elevated"),
    (1000000002, "HTN", "history of high blood pressure"),
    (1000000003, "history of hypertension", "patient has a history of hypertension, bp 150"),
    (1000000004, "chest pain", "patient denies chest pain"),
    (1000000005, "serum sodium level", "lab results: sodium 140"),
    (1000000006, "hba1c", "hba1c test for diabetes"),
    (1000000007, "glucose in blood", "blood glucose level measurement 110"),
    (1000000008, "Lisinopril 10mg", "taking lisinopril 10 mg daily"),
    (1000000009, "ibuprofen 200mg oral tablet", "no known drug allergy"),
    (1000000010, "metformin 500 mg tablet", "metformin for diabetes"),
    (1000000011, "zestril", "prescribed zestril"),
    (1000000012, "myocardial infarct", "possible myocardial infarction, heart cath and ecg"),
    (1000000013, "asthma", "asthma is unlikely; no wheeze"),
    (1000000014, "acute chronic asthma", "ongoing asthma, lung exam normal"),
    (1000000015, "heart failure, severe", "no evidence of acute heart failure, severe dyspnea today"),
    (1000000016, "COPD", "copd with pneumonia and bronchitis"),
    (1000000017, "mi", "previous mi in 2010"),
    (1000000018, "   ", "blank"),
    (1000000019, "unknown thing", ""),
    (1000000020, "H2O & salt 5%", "solution"),
    (1000000021, "lisinopril/hctz", "combination drug"),
    (1000000022, "pneumonitis", "may be pneumonitis"),
    (1000000023, "headache", "patient without headache but has chest pain"),
    (1000000024, "Creatinine", "creatinine 1.2, kidney function"),
    (1000000025, "thyroid test", "tsh and t4 test, 3 cm nodule"),
]

def ascii_text(text: Column) -> Column:
    """Everything that isn't ASCII becomes a letter, so that word boundaries agree in all engines."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "x")


ASCII_SQL = "regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')"


def quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    """A FROM item that both engines read."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS v({columns})"


def lst(xs) -> str:
    return "[" + ", ".join(map(quoted, xs)) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


_TERM = """CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN concat('history of ', p_name) WHEN 2 THEN upper(p_name)
  WHEN 3 THEN substr(p_name, 1, 6) WHEN 4 THEN replace(p_name, 'e', '') ELSE concat('zz ', p_name) END"""
_CONDITION = "p_partkey AS id, CAST(p_partkey AS STRING) AS code, lower(p_name) AS term, concat(p_name, ' (', p_type, ')') AS display, p_type AS concept_type, CAST(CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1 END AS INT) AS is_active"
_FIRST, _LAST = "substr(p_name, 1, instr(p_name, ' ') - 1)", "substr(p_name, instr(p_name, ' ') + 1)"
_LAB = f"p_partkey AS id, concat('L', CAST(p_partkey AS STRING)) AS code, lower(concat(p_name, ' in ', p_type)) AS term, concat(p_name, ' in ', p_type) AS display, {_LAST} AS component, p_type AS specimen, CASE WHEN p_size % 2 = 0 THEN NULL ELSE 'manual' END AS method, concat(p_name, ' test') AS consumer_name"
_DRUG = f"p_partkey AS id, concat('R', CAST(p_partkey AS STRING)) AS code, lower(concat(p_name, ' ', CAST(p_size AS STRING))) AS term, p_name AS display, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'SCD' END AS tty, p_brand AS brand_name, {_FIRST} AS ingredient, concat(CAST(p_size AS STRING), ' mg') AS strength, CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS INT) AS is_active"


def _both(spark, sf_dir, select: str, rows, schema: str) -> DataFrame:
    columns = [c.strip().split()[0] for c in schema.split(",")]
    part = table(spark, sf_dir, "part").selectExpr(*_split(select)).select(columns)
    return part.unionByName(literal(spark, rows, schema))


def _split(select: str) -> list[str]:
    out, depth, held = [], 0, ""
    for c in select:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(held)
            held = ""
        else:
            held += c
    return [*out, held]


def conditions(spark, sf_dir) -> DataFrame:
    return _both(spark, sf_dir, _CONDITION, CLINICAL_CONDITIONS, "id long, code string, term string, display string, concept_type string, is_active int")


def labs(spark, sf_dir) -> DataFrame:
    return _both(spark, sf_dir, _LAB, CLINICAL_LABS, "id long, code string, term string, display string, component string, specimen string, method string, consumer_name string")


def drugs(spark, sf_dir) -> DataFrame:
    return _both(spark, sf_dir, _DRUG, CLINICAL_DRUGS, "id long, code string, term string, display string, tty string, brand_name string, ingredient string, strength string, is_active int")


def terms(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").selectExpr("p_partkey AS term_id", f"{_TERM} AS term", "CAST(NULL AS STRING) AS context")
    return part.unionByName(literal(spark, CLINICAL_TERMS, "term_id long, term string, context string"))


def notes(spark, sf_dir) -> DataFrame:
    """(note_id, term, context): clinical terms with context, and all turns of conversations."""
    talk = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("note_id"), ascii_text(F.col("text")).alias("context")).selectExpr("note_id", "split_part(context, ' ', 1) AS term", "context")
    return literal(spark, CLINICAL_TERMS, "note_id long, term string, context string").unionByName(talk)


def _duck(x: str) -> str:
    return x.replace("AS STRING", "AS VARCHAR")


CONDITIONS = f"conditions AS (SELECT {_duck(_CONDITION)} FROM part UNION ALL SELECT * FROM {values(CLINICAL_CONDITIONS, 'id, code, term, display, concept_type, is_active')})"
LABS = f"labs AS (SELECT {_duck(_LAB)} FROM part UNION ALL SELECT * FROM {values(CLINICAL_LABS, 'id, code, term, display, component, specimen, method, consumer_name')})"
DRUGS = f"drugs AS (SELECT {_duck(_DRUG)} FROM part UNION ALL SELECT * FROM {values(CLINICAL_DRUGS, 'id, code, term, display, tty, brand_name, ingredient, strength, is_active')})"
TERMS = f"terms AS (SELECT p_partkey AS term_id, {_TERM} AS term, CAST(NULL AS VARCHAR) AS context FROM part UNION ALL SELECT * FROM {values(CLINICAL_TERMS, 'term_id, term, context')})"
NOTES = f"notes AS (SELECT * FROM {values(CLINICAL_TERMS, 'note_id, term, context')} UNION ALL SELECT note_id, split_part(context, ' ', 1), context FROM (SELECT conv_id * 100000 + turn AS note_id, {ASCII_SQL} AS context FROM conversations))"


def strip_prefix_sql(x: str, prefixes) -> str:
    return f"list_reduce(list_prepend({x}, {lst(prefixes)}), lambda acc, p: CASE WHEN starts_with(acc, p) THEN substr(acc, length(p) + 1) ELSE acc END)"


def strip_suffix_sql(x: str, suffixes) -> str:
    return f"list_reduce(list_prepend({x}, {lst(suffixes)}), lambda acc, p: CASE WHEN ends_with(acc, p) THEN substr(acc, 1, length(acc) - length(p)) ELSE acc END)"


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def plain_sql(x: str) -> str:
    return f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"


def case_sql(x: str, table: dict, default: str, show=quoted) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {quoted(k)} THEN {show(v)}" for k, v in table.items()) + f" ELSE {default} END"
