"""Summaries, pagination and cleaning of results (AGG01-AGG10, SRT, VAL, API01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def valid(rows: DataFrame) -> DataFrame:
    """VAL01, VAL02: rows with a code, a display and a system."""
    filled = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    return rows.where(filled("code") & filled("display") & F.col("system").isNotNull())


def legacy_filter(rows: DataFrame, system: str | None, threshold: float, max_results: int) -> DataFrame:
    """VAL04: (term_id, system, confidence, ...) by system and confidence, the best of each term."""
    kept = rows.where(F.col("confidence") >= threshold)
    kept = kept.where(F.col("system") == system) if system else kept
    order = Window.partitionBy("term_id").orderBy(F.desc("confidence"), "system", "code")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_results)


def unsupported(terms: DataFrame, system: Column, supported) -> DataFrame:
    """VAL08, VAL09: (term_id, found, error) of blank terms and unknown systems."""
    error = F.when(F.coalesce(F.trim("term"), F.lit("")) == "", "Empty term").when(~F.lower(system).isin(*supported), F.concat(F.lit("Unsupported system: "), system))
    return terms.select("term_id", F.lit(False).alias("found"), error.alias("error")).where("error IS NOT NULL")


def concept_counts(concepts: DataFrame) -> DataFrame:
    """AGG01."""
    return concepts.groupBy("system").agg(F.count("*").alias("n_concepts"), F.countDistinct("term").alias("n_terms"))


def database_counts(concepts: DataFrame, custom: DataFrame) -> DataFrame:
    """AGG01 with the number of custom mappings of each vocabulary."""
    own = custom.groupBy("system").agg(F.count("*").alias("n_custom"))
    return concept_counts(concepts).join(own, "system", "left").na.fill(0, ["n_custom"])


def matcher_statistics(synonyms: DataFrame, thresholds: DataFrame) -> DataFrame:
    """AGG02: (name, value) of the synonyms' totals and of the match thresholds."""
    totals = synonym_counts(synonyms).select(F.explode(F.create_map(F.lit("synonym_sets"), F.col("n_sets").cast("double"), F.lit("synonym_terms"), F.col("n_terms").cast("double"))).alias("name", "value"))
    return totals.unionByName(thresholds.select(F.concat(F.lit("threshold_"), "name").alias("name"), "value"))


def synonym_counts(synonyms: DataFrame) -> DataFrame:
    """AGG02."""
    return synonyms.agg(F.countDistinct("set_key").alias("n_sets"), F.count("synonym").alias("n_terms"))


def context_statistics(rows: DataFrame) -> DataFrame:
    """AGG03: totals and averages over (found, confidence, context_score, alternatives) rows; averages of the found."""
    good = F.when(F.col("found"), F.lit(1))
    return rows.agg(
        F.count("*").alias("total"), F.count(good).alias("successful"), F.round(F.count(good) / F.greatest(F.count("*"), F.lit(1)), 6).alias("success_rate"),
        F.round(F.avg(F.when(F.col("found"), F.col("confidence"))), 6).alias("avg_confidence"), F.round(F.avg(F.when(F.col("found"), F.col("context_score"))), 6).alias("avg_context_score"), F.count_if(F.col("alternatives") > 0).alias("with_alternatives"),
    )


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """(value, n) of a column, or of the members of an array column."""
    array = rows.schema[column].dataType.typeName() == "array"
    return rows.select(F.explode(column).alias("value") if array else F.col(column).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def mapping_statistics(rows: DataFrame) -> DataFrame:
    """AGG04: of (term_id, mappings, confidence, seconds) rows."""
    c = F.col("confidence")
    return rows.agg(
        F.count("*").alias("total_terms"), F.sum("mappings").alias("total_mappings"), F.round(F.avg("mappings"), 6).alias("avg_mappings"), F.round(F.avg("confidence"), 3).alias("avg_confidence"), F.round(F.avg("seconds"), 4).alias("avg_seconds"),
        F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"),
    )


def mapping_histograms(rows: DataFrame) -> DataFrame:
    """AGG04: (kind, value, n): terms by domain, and applied rules by type; of (domain, rule_types array) rows."""
    domains = histogram(rows, "domain").withColumn("kind", F.lit("domain"))
    return domains.unionByName(histogram(rows, "rule_types").withColumn("kind", F.lit("rule_type"))).select("kind", "value", "n")


def batch_totals(rows: DataFrame) -> DataFrame:
    """AGG05, AGG06, AGG09: per job of (job_id, term_id, n_matches, started, ended) rows."""
    return rows.groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("n_matches") > 0).alias("successful"), F.count_if(F.col("n_matches") == 0).alias("failed"), F.sum("n_matches").alias("total_matches"),
        ((F.unix_micros(F.max("ended").cast("timestamp")) - F.unix_micros(F.min("started").cast("timestamp"))) / 1e6).alias("seconds"),
    )


def job_summary(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """AGG06: the state of each job of jobs (job_id, total, created) from its log of finished chunks.

    chunks: (job_id, at, successful, failed, error).  A job is pending without
    chunks, failed once a chunk has an error (the first is its message),
    completed when all terms are done, else processing.  seconds: from its
    creation to its last chunk.
    """
    done = chunks.groupBy("job_id").agg(F.sum("successful").alias("successful"), F.sum("failed").alias("failed"), F.max("at").alias("updated"), F.min(F.when(F.col("error").isNotNull(), F.struct("at", "error")))["error"].alias("error"))
    rows = jobs.join(done, "job_id", "left").na.fill(0, ["successful", "failed"])
    processed = F.col("successful") + F.col("failed")
    status = F.when(F.col("updated").isNull(), "pending").when(F.col("error").isNotNull(), "failed").when(processed >= F.col("total"), "completed").otherwise("processing")
    seconds = (F.unix_micros(F.coalesce("updated", "created").cast("timestamp")) - F.unix_micros(F.col("created").cast("timestamp"))) / 1e6
    progress = F.when(F.col("total") > 0, F.round(F.least(F.lit(100.0), 100.0 * processed / F.col("total")), 6)).otherwise(F.lit(100.0))
    return rows.select("job_id", "total", "successful", "failed", status.alias("status"), progress.alias("progress"), seconds.alias("seconds"), "error")


def term_status(n_matches: Column, error: Column) -> Column:
    """AGG09."""
    return F.when(error.isNotNull(), "failed").when(n_matches > 0, "success").otherwise("no_mappings")


def observed(rows: DataFrame, name: str = "mapping"):
    """AGG10: (rows, observation) counting processed and found rows as they pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, F.count("*").alias("processed"), F.count_if("found").alias("found")), seen


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """SRT03: one page, numbered from 1."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def job_results(rows: DataFrame, order: list[str], limit: int, offset: int, partition: str = "job_id") -> DataFrame:
    """SRT04: per job all rows from offset on if limit is 1000 or more or the job has at most 100; else limit rows."""
    placed = rows.withColumn("rn", F.row_number().over(Window.partitionBy(partition).orderBy(*order)))
    n = rows.groupBy(partition).agg(F.count("*").alias("job_rows"))
    last = F.when((F.lit(limit) >= 1000) | (F.col("job_rows") <= 100), F.col("job_rows")).otherwise(offset + limit)
    return placed.join(n, partition).where((F.col("rn") > offset) & (F.col("rn") <= last)).drop("job_rows")


def flattened(results: DataFrame) -> DataFrame:
    """SNK04, API01: (term_id, term, results map of system to mappings) as rows; terms without any keep one empty row."""
    spread = results.select("term_id", "term", F.explode_outer("results").alias("system", "mappings"))
    return spread.select("term_id", "term", "system", F.explode_outer("mappings").alias("m")).select("term_id", "term", "system", "m.code", "m.display", "m.confidence")
