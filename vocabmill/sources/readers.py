"""Sources (SRC01-SRC15) as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FORMATS = ("csv", "json", "excel", "txt")

CONCEPTS = "id long, code string, term string, display string, concept_type string, is_active int"
LABS = "id long, code string, term string, display string, component string, property string, time string, specimen string, scale string, method string, long_common_name string, class string, consumer_name string, status string"
DRUGS = "id long, code string, term string, display string, tty string, brand_name string, ingredient string, strength string, dose_form string, route string, ndc string, atc string, is_active int"
EDGES = "source string, destination string, kind string, is_active int"
RULES = "rule_id string, rule_type string, priority int, source_term string, target_code string, target_system string, target_display string, conditions map<string,string>, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz, created_by string, is_active boolean"


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC01, SRC02: a Parquet table; an empty one of that schema if there is none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def concepts_csv(spark: SparkSession, path: str, schema: str, renamed: dict[str, str] | None = None) -> DataFrame:
    """A vocabulary's CSV: codes stay strings, ids follow the order of lines in one file."""
    rows = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    for old, new in (renamed or {}).items():
        rows = rows.withColumnRenamed(old, new)
    types = dict(c.strip().split(" ", 1) for c in schema.split(","))
    numbered = rows.withColumn("id", F.monotonically_increasing_id() + 1)
    return numbered.select(*[F.col(c).cast(t).alias(c) if c in numbered.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()])


def terms(spark: SparkSession, path: str, fmt: str, column: str = "term") -> DataFrame:
    """SRC04-SRC08: (term_id, term) from a file; term_ids ascend in the order of the file.

    Only null and empty values are dropped: "NA" is a term.
    """
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"unsupported file format: {fmt}")
    if fmt == "csv":
        rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
        if column not in rows.columns:
            raise ValueError(f"column '{column}' not found")
        rows = rows.select(F.col(column).alias("term"))
    elif fmt == "txt":
        rows = spark.read.text(path).select(F.trim("value").alias("term"))
    elif fmt == "json":
        whole = spark.read.text(path, wholetext=True)
        items = whole.select(F.explode(F.from_json("value", "array<string>")).alias("x"), F.json_array_length("value").alias("n"))
        bad = whole.where(F.json_array_length("value").isNull()).limit(1).count()
        if bad:
            raise ValueError("JSON must be a list of strings or of objects with 'term'")
        is_object = F.startswith("x", F.lit("{"))
        mixed = items.agg(F.countDistinct(is_object)).first()[0] > 1
        if mixed:
            raise ValueError("JSON mixes strings and objects")
        rows = items.select(F.when(is_object, F.get_json_object("x", f"$.{column}")).otherwise(F.col("x")).alias("term"))
    else:
        try:
            import openpyxl  # noqa: F401
            import pandas as pd
        except ImportError as e:
            raise ValueError("reading Excel files needs openpyxl") from e
        sheet = pd.read_excel(path, dtype=str, keep_default_na=False)
        if column not in sheet.columns:
            raise ValueError(f"column '{column}' not found")
        rows = spark.createDataFrame([(x,) for x in sheet[column]], "term string")
    return rows.where("term IS NOT NULL AND term <> ''").select(F.monotonically_increasing_id().alias("term_id"), "term")


def _objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the JSON objects of text files, one a file or one a line, as the sinks write them."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    by_line = (F.size(lines) > 0) & F.forall(lines, lambda x: F.startswith(F.ltrim(x), F.lit("{")) & F.endswith(F.rtrim(x), F.lit("}")))
    return whole.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.when(by_line, lines).otherwise(F.array("value")).alias("objects"))


def synonym_sets(spark: SparkSession, path: str) -> DataFrame:
    """SRC10, SRC11: (set_key, set_position, position, synonym) of JSON objects of lists; later files win a key."""
    entries = F.flatten(F.transform("objects", lambda x: F.map_entries(F.from_json(x, "map<string,array<string>>"))))
    spread = _objects(spark, path).select("file", F.posexplode(entries).alias("set_position", "e")).select("file", "set_position", F.col("e.key").alias("set_key"), F.col("e.value").alias("synonyms"))
    last = spread.groupBy("set_key").agg(F.max_by(F.struct("set_position", "synonyms"), F.struct("file", "set_position")).alias("m")).select("set_key", "m.*")
    return last.select("set_key", "set_position", F.posexplode("synonyms").alias("position", "synonym"))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop)


def abbreviations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SRC12: (short, position, expanded_term) of the first of the JSON files that exists; the built-in ones if none does."""
    from ..functions.fixed_values import ABBREVIATIONS

    for path in paths:
        if _exists(spark, path):
            found = _objects(spark, path).select(F.explode("objects").alias("x")).select(F.explode(F.from_json(F.get_json_object("x", "$.abbreviations"), "map<string,array<string>>")).alias("short", "terms"))
            return found.select(F.lower("short").alias("short"), F.posexplode("terms").alias("position", "expanded_term"))
    return spark.createDataFrame([(k, i, t) for k, v in ABBREVIATIONS.items() for i, t in enumerate(v)], "short string, position int, expanded_term string")


def thresholds(spark: SparkSession, path: str | None = None) -> DataFrame:
    """FUZ08: (name, value) of the match thresholds, those in the file's ``matching`` object in place of the built-in ones."""
    from ..functions.fixed_values import THRESHOLDS

    own = spark.createDataFrame(list(THRESHOLDS.items()), "name string, built_in double")
    if path is None:
        return own.withColumnRenamed("built_in", "value")
    given = _objects(spark, path).select(F.explode("objects").alias("x")).select(F.explode(F.from_json(F.get_json_object("x", "$.matching"), "map<string,double>")).alias("name", "given"))
    return own.join(given, "name", "left").select("name", F.coalesce("given", "built_in").alias("value"))


def active_rules(spark: SparkSession, path: str) -> DataFrame:
    """SRC13, SRT05: the active rules of a Parquet table, by priority and age; none if there is no table."""
    from ..operators.rules import all_rules

    return all_rules(table(spark, path, RULES))


def contract(rows: DataFrame, schema: str, key: list[str]) -> DataFrame:
    """SRC02: (n_rows, n_keys, null_keys, missing, fits): whether rows have the schema's columns and a unique, non-null key."""
    have = dict(rows.dtypes)
    missing = [c for c in (x.strip().split(" ")[0] for x in schema.split(",")) if c not in have]
    null = F.lit(False)
    for c in key:
        null = null | F.col(c).isNull()
    by_key = rows.groupBy(*key).agg(F.count("*").alias("n"))
    counted = by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"), F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("null_keys"))
    return counted.select("*", F.lit(",".join(missing)).alias("missing"), ((F.col("n_rows") == F.col("n_keys")) & (F.col("null_keys") == 0) & F.lit(not missing)).alias("fits"))


def custom_mappings(spark: SparkSession, path: str) -> DataFrame:
    """SRC09: (system, term, code, display) of a JSON object of objects."""
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.explode(F.from_json("value", "map<string,map<string,struct<code:string,display:string>>>")).alias("system", "terms"))
    return parsed.select("system", F.explode("terms").alias("term", "m")).select("system", "term", "m.code", "m.display")


def rules_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC14, RUL06: (valid, invalid) rules of JSON lists, or of objects a line as the sink writes them; invalid ones carry their errors."""
    from ..operators.rules import errors

    raw = "rule_id string, rule_type string, priority int, source_term string, target_code string, target_system string, target_display string, conditions string, metadata string, created_at string, updated_at string, created_by string, is_active boolean"
    struct = f"struct<{', '.join(c.strip().replace(' ', ':', 1) for c in raw.split(','))}>"
    listed = lambda x: F.when(F.startswith(F.ltrim(x), F.lit("[")), F.from_json(x, f"array<{struct}>")).otherwise(F.array(F.from_json(x, struct)))
    rows = _objects(spark, path).select(F.inline(F.flatten(F.transform("objects", listed))))
    parsed = rows.withColumn("conditions", F.from_json(F.coalesce("conditions", F.lit("{}")), "map<string,string>"))
    for c in ("created_at", "updated_at"):
        parsed = parsed.withColumn(c, F.to_timestamp_ntz(F.col(c)))
    checked = parsed.withColumn("errors", errors(parsed))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def file_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """SRC15: (name, bytes) of the files in a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))

