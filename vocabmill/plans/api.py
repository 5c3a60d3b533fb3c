"""The façade: an engine over a set of vocabularies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import normalize as nz
from ..functions.fixed_values import MAX_BATCH_TERMS, SYSTEM_URIS
from ..operators import fuzzy, stats
from ..sources import readers, writers
from . import requests
from .cascade import map_terms
from .enhanced import enhanced


@dataclass
class Engine:
    """Maps terms; every method returns a DataFrame."""

    spark: SparkSession
    concepts: dict[str, DataFrame]
    synonyms: DataFrame | None = None
    custom: DataFrame | None = None
    rules: DataFrame | None = None
    providers: list[DataFrame] = field(default_factory=list)

    def map_terms(self, terms: DataFrame, systems: list[str] | None = None, threshold: float = 0.0, max_results: int = 100, include_fuzzy: bool = True, thresholds: dict[str, float] | None = None) -> DataFrame:
        """Mappings of terms (term_id, term) from threshold on; thresholds: those of the fuzzy tiers that differ from the defaults."""
        wrong = set(systems or ()) - set(SYSTEM_URIS)
        if wrong:
            raise ValueError(f"unsupported systems: {sorted(wrong)}")
        own = {s: c for s, c in self.concepts.items() if not systems or s in systems}
        found = map_terms(terms, own, self.synonyms, self.custom, self.providers, include_fuzzy, thresholds)
        return stats.legacy_filter(stats.valid(found.where("found")), None, threshold, max_results)

    def map_term(self, term: str, **options) -> list[dict]:
        """One term's mappings, as dicts."""
        if not term:
            raise ValueError("empty term")
        rows = self.map_terms(self.spark.createDataFrame([(0, term)], "term_id long, term string"), **options)
        return [r.asDict() for r in rows.orderBy("rank").collect()]

    def map_batch(self, terms: list[str], **options) -> DataFrame:
        if not 1 <= len(terms) <= MAX_BATCH_TERMS:
            raise ValueError(f"a batch has 1 to {MAX_BATCH_TERMS} terms")
        return self.map_terms(self.spark.createDataFrame(list(enumerate(terms)), "term_id long, term string"), **options)

    def fuzzy_matches(self, terms: DataFrame, system: str, algorithms: tuple[str, ...] = ("all",), threshold: float = 0.7, max_results: int = 10) -> DataFrame:
        """(term_id, code, display, algorithm, score, rank): the concepts nearest to each term by the algorithms asked for.

        A term of which no concept is near enough has no row.  Concepts with
        the same name are given by the last one, as in the fuzzy index.
        """
        asked = terms.select("term_id", nz.clean(F.col("term")).alias("q")).where("q <> ''")
        named = self.concepts[system].groupBy(F.lower("term").alias("key")).agg(F.max(F.struct("id", "code", "display")).alias("m")).select("key", "m.code", "m.display")
        near = fuzzy.by_algorithms(asked.select("q"), named.select("key"), algorithms, threshold, max_results)
        return asked.join(near, "q").join(named, "key").select("term_id", "code", "display", "algorithm", "score", "rank")

    def map_requests(self, asked: DataFrame, include_fuzzy: bool = True) -> DataFrame:
        """Requests (term_id, term, system[, threshold]), each with its own vocabularies; errors are rows."""
        return requests.routed(asked, self.concepts, synonyms=self.synonyms, custom=self.custom, providers=self.providers, include_fuzzy=include_fuzzy)

    def extract_and_map(self, docs: DataFrame, id_col: str = "doc_id", systems: list[str] | None = None, threshold: float = 0.0, include_fuzzy: bool = True) -> DataFrame:
        """The known terms in free texts (id, text), each with its mappings."""
        own = {s: c for s, c in self.concepts.items() if not systems or s in systems}
        return requests.extracted_and_mapped(docs, own, id_col, threshold, synonyms=self.synonyms, custom=self.custom, providers=self.providers, include_fuzzy=include_fuzzy)

    def map_enhanced(self, terms: DataFrame, **options) -> DataFrame:
        """terms (term_id, term, context) with context, negation and rules."""
        rules = self.rules if self.rules is not None else self.spark.createDataFrame([], readers.RULES)
        return enhanced(terms, map_terms(terms, self.concepts, self.synonyms, self.custom, self.providers), rules, **options)

    def run_job(self, path: str, fmt: str, out: str, column: str = "term", **options) -> DataFrame:
        """A file's terms mapped and written as CSV and JSON beside ``out``; the totals."""
        terms = readers.terms(self.spark, path, fmt, column)
        rows = terms.join(self.map_terms(terms, **options), "term_id", "left")
        writers.results(rows.select("term_id", "term", "system", "code", "display", "confidence"), out)
        return self._totals(out)

    def job_results(self, out: str, limit: int = 1000, offset: int = 0) -> DataFrame:
        """A job's rows as ``run_job`` wrote them, a page of them if there are many."""
        return stats.job_results(self._written(out).withColumn("job_id", F.lit(out)), ["term_id", "system", "code"], limit, offset)

    def job_status(self, out: str) -> DataFrame:
        """(job, status, total, successful, failed, total_matches) of a job by where it writes; pending before it has written."""
        if not readers._exists(self.spark, f"{out}.json/_SUCCESS"):
            return self.spark.createDataFrame([(out, "pending", 0, 0, 0, 0)], "job string, status string, total long, successful long, failed long, total_matches long")
        return self._totals(out).select(F.lit(out).alias("job"), F.lit("completed").alias("status"), "*")

    def _written(self, out: str) -> DataFrame:
        return self.spark.read.schema("term_id long, term string, system string, code string, display string, confidence double").json(f"{out}.json")

    def _totals(self, out: str) -> DataFrame:
        per_term = self._written(out).groupBy("term_id").agg(F.count("code").alias("n"))
        return per_term.agg(F.count("*").alias("total"), F.count_if(F.col("n") > 0).alias("successful"), F.count_if(F.col("n") == 0).alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_matches"))

    def fuzzy_algorithms(self) -> DataFrame:
        """(algorithm, threshold) of the fuzzy tiers and of the scorers that stand alone."""
        return readers.thresholds(self.spark).select(F.col("name").alias("algorithm"), F.col("value").alias("threshold")).unionByName(self.spark.createDataFrame([("levenshtein", None), ("jaro_winkler", 0.9), ("phonetic", None)], "algorithm string, threshold double"))

    def test_files(self, folder: str) -> DataFrame:
        """SRC15: (name, bytes) of the term files of a folder."""
        return readers.file_catalogue(self.spark, folder)

    def add_custom_mapping(self, system: str, term: str, code: str, display: str) -> None:
        new = self.spark.createDataFrame([(system, term, code, display)], "system string, term string, code string, display string")
        self.custom = new if self.custom is None else writers.upserted(self.custom, new)

    def systems(self) -> DataFrame:
        rows = [(s, SYSTEM_URIS[s], s in self.concepts) for s in SYSTEM_URIS] + [("icd10", "unknown", False)]
        return self.spark.createDataFrame(rows, "system string, uri string, supported boolean")

    def statistics(self) -> DataFrame:
        """AGG01 over all vocabularies."""
        every = [c.select(F.lit(s).alias("system"), "term") for s, c in self.concepts.items()]
        both = every[0]
        for e in every[1:]:
            both = both.unionByName(e)
        return stats.concept_counts(both)
