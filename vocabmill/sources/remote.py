"""Remote vocabularies as cached responses (CON01-CON08).

The engine never calls a network.  A provider is a table of responses; a
response answers a request if its key is equal and it is young enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.fixed_values import COMMON_CONDITIONS

TTL = "INTERVAL 1 HOUR"
CONFIDENCE = 0.95


def request_key(api: Column, endpoint: Column, params: Column) -> Column:
    """CON07: the MD5 that names a request."""
    return F.md5(F.concat_ws("_", api, endpoint, F.to_json(params)))


def fresh(responses: DataFrame, now: Column | None = None) -> DataFrame:
    """CON07: responses (key, fetched_at, ...) not older than an hour."""
    return responses.where(F.col("fetched_at") > (now if now is not None else F.current_timestamp()) - F.expr(TTL))


def cached(requests: DataFrame, responses: DataFrame, now: Column | None = None) -> DataFrame:
    """CON07: requests (key, ...) with body and fetched_at of the latest response that is young enough, null if none is."""
    last = fresh(responses, now).groupBy("key").agg(F.max(F.struct("fetched_at", "body")).alias("m"))
    return requests.join(last, "key", "left").select(*requests.columns, "m.body", "m.fetched_at")


class ResponseCache:
    """CON07: responses kept as Parquet by day, in a folder that all machines see.

    Saving appends; a read takes the days that the time to live touches, and of
    each key its latest response.  Days before can be deleted at any time.
    """

    SCHEMA = "key string, body string, fetched_at timestamp, day date"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def save(self, responses: DataFrame) -> None:
        """Keeps responses (key, body, fetched_at)."""
        rows = responses.select("key", "body", F.col("fetched_at").cast("timestamp").alias("fetched_at")).withColumn("day", F.to_date("fetched_at"))
        rows.write.mode("append").partitionBy("day").parquet(self.path)

    def _rows(self, now: Column) -> DataFrame:
        from .readers import _exists

        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("day") >= F.to_date(now.cast("timestamp") - F.expr(TTL)))

    def answers(self, requests: DataFrame, now: Column | None = None) -> DataFrame:
        """requests with body and fetched_at, see cached."""
        at = now if now is not None else F.current_timestamp()
        return cached(requests, self._rows(at), at)

    def missing(self, requests: DataFrame, now: Column | None = None) -> DataFrame:
        """The requests that have to be sent, each key once."""
        return self.answers(requests, now).where("fetched_at IS NULL").drop("body", "fetched_at").dropDuplicates(["key"])


def common_conditions(spark: SparkSession) -> DataFrame:
    """CON03: the built-in answers (term, code, display)."""
    return spark.createDataFrame([(t, c, d) for t, (c, d) in COMMON_CONDITIONS.items()], "term string, code string, display string")


def lookup(terms: DataFrame, providers: list[DataFrame], systems: DataFrame) -> DataFrame:
    """CON01-CON05: (term_id, system, code, display, confidence, source) of the first provider that answers.

    terms: (term_id, term).  providers: (system, term, code, display), terms
    lower-cased.  systems: one column, one row a vocabulary asked.
    """
    if not providers:
        return terms.sparkSession.createDataFrame([], "term_id long, system string, code string, display string, confidence double, source string")
    asked = terms.select("term_id", F.lower(F.trim("term")).alias("term"))
    found = None
    for place, p in enumerate(providers):
        hits = asked.join(p.join(systems.select("system"), "system", "left_semi"), "term").select("term_id", "system", F.struct(F.lit(place).alias("place"), "code", "display").alias("m"))
        found = hits if found is None else found.unionByName(hits)
    first = found.groupBy("term_id", "system").agg(F.min("m").alias("m"))
    return first.select("term_id", "system", "m.code", "m.display", F.lit(CONFIDENCE).alias("confidence"), F.concat(F.lit("provider_"), F.col("m.place").cast("string")).alias("source"))


def table_search(responses: DataFrame, most: int = 10) -> DataFrame:
    """CON02: (key, position, code, display) of bodies shaped [total, [code, ...], extra, [[display, ...], ...]]; other bodies give none."""
    parts = F.from_json("body", "array<string>")
    codes = F.from_json(F.get(parts, F.lit(1)), "array<string>")
    shown = F.from_json(F.get(parts, F.lit(3)), "array<array<string>>")
    rows = responses.select("key", F.posexplode(F.slice(F.arrays_zip(codes.alias("code"), shown.alias("names")), 1, most)).alias("position", "x"))
    return rows.select("key", "position", "x.code", F.get("x.names", F.lit(0)).alias("display"))


def parameter_lookup(responses: DataFrame) -> DataFrame:
    """CON04: (key, display) of bodies that list named parameters, one of them the display; others give none."""
    parameters = F.from_json(F.get_json_object("body", "$.parameter"), "array<struct<name:string,valueString:string>>")
    shown = F.get(F.filter(parameters, lambda p: p["name"] == "display"), F.lit(0))["valueString"]
    return responses.select("key", shown.alias("display")).where("display IS NOT NULL")


def drug_search(terms: DataFrame, responses: DataFrame, suggestions: DataFrame, most: int = 10) -> DataFrame:
    """CON01: (term_id, code, display, tty, spelled) of drug groups; terms without any are asked again as suggested.

    responses: (term, body), bodies being drug groups by term type.
    suggestions: (term, position, suggestion); the first that is answered counts.
    """
    groups = F.from_json(F.get_json_object("body", "$.drugGroup.conceptGroup"), "array<struct<tty:string,conceptProperties:array<struct<rxcui:string,name:string>>>>")
    spread = responses.select("term", F.explode(groups).alias("g")).select("term", "g.tty", F.posexplode("g.conceptProperties").alias("position", "p"))
    answers = spread.select("term", F.col("p.rxcui").alias("code"), F.col("p.name").alias("display"), "tty").distinct()
    known = answers.select("term").distinct()
    asked = terms.select("term_id", F.lower(F.trim("term")).alias("term"))
    again = asked.join(known, "term", "left_anti").join(suggestions, "term").join(known.withColumnRenamed("term", "suggestion"), "suggestion")
    respelled = again.groupBy("term_id").agg(F.min(F.struct("position", "suggestion")).alias("m")).select("term_id", F.col("m.suggestion").alias("term"), F.col("m.suggestion").alias("spelled"))
    every = asked.withColumn("spelled", F.lit(None).cast("string")).unionByName(respelled)
    by_term = Window.partitionBy("term").orderBy("code", "tty", "display")
    first = answers.withColumn("n", F.row_number().over(by_term)).where(F.col("n") <= most).drop("n")  # a term's further answers are no request's
    found = every.join(first, "term").select("term_id", "code", "display", "tty", "spelled")
    order = Window.partitionBy("term_id").orderBy("code", "tty", "display")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def concept_details(asked: DataFrame, concepts: dict[str, DataFrame]) -> DataFrame:
    """CON06: (system, code, term, display) of asked (system, code), from the local vocabularies."""
    every = None
    for system, own in concepts.items():
        part = own.select(F.lit(system).alias("system"), "code", "term", "display")
        every = part if every is None else every.unionByName(part)
    return asked.select("system", "code").distinct().join(every, ["system", "code"])
