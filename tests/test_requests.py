"""Requests, extraction with mapping, context scores, fallback, summaries, the response cache and fuzzy algorithms."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from vocabmill.functions import similarity as sim
from vocabmill.operators import documents as do, fuzzy as fz, stats as st
from vocabmill.plans import cascade, enhanced as en, requests as rq
from vocabmill.plans.api import Engine
from vocabmill.queries import base
from vocabmill.sources import remote


@pytest.fixture(scope="module")
def engine(spark):
    conditions = spark.createDataFrame(base.CLINICAL_CONDITIONS, "id long, code string, term string, display string, concept_type string, is_active int")
    labs = spark.createDataFrame(base.CLINICAL_LABS, "id long, code string, term string, display string, component string, specimen string, method string, consumer_name string")
    return Engine(spark, {"snomed": conditions, "loinc": labs})


def test_requests_name_their_vocabularies(spark, engine):
    uri = "HTTP://LOINC.org"
    rows = [(1, "asthma", "snomed", None), (1, "asthma", None, None), (2, "hba1c", uri, None), (3, " ", "snomed", None), (4, None, "all", None), (5, "gout", "ICD10", None), (6, "failure", "SNOMED ", 0.9), (7, "failure", "snomed", 0.8), (8, "asthma", "rxnorm", None)]
    got = engine.map_requests(spark.createDataFrame(rows, "term_id long, term string, system string, threshold double").withColumn("code", F.lit("x")), include_fuzzy=False)
    found = sorted(((r.term_id, r.system, r.found, r.code, r.error, tuple(r.attempted or ())) for r in got.collect()), key=repr)
    want = [(1, "snomed", True, "195967001", None, ()), (1, "snomed", True, "195967001", None, ()), (1, "loinc", False, None, None, ("exact",)), (2, "loinc", True, "4548-4", None, ()), (3, "snomed", False, None, "Empty term", ()), (4, "snomed", False, None, "Empty term", ()), (4, "loinc", False, None, "Empty term", ()), (5, "icd10", False, None, "Unsupported system: ICD10", ()), (6, "snomed", False, None, None, ("exact",)), (7, "snomed", True, "84114007", None, ()), (8, "rxnorm", False, None, "Unsupported system: rxnorm", ())]
    assert found == sorted(want, key=repr)


def test_terms_in_texts_are_mapped(spark, engine):
    docs = spark.createDataFrame([(1, "Asthma and asthma; asthma. glucose"), (2, None), (3, ""), (1, "pneumonia")], "doc_id long, text string")
    got = {(r.doc_id, r.term, r.start, r.system): r.code for r in engine.extract_and_map(docs, systems=["snomed"], include_fuzzy=False).collect()}
    assert got == {(1, "Asthma", 0, "snomed"): "195967001", (1, "asthma", 11, "snomed"): "195967001", (1, "glucose", 27, "snomed"): None, (1, "pneumonia", 0, "snomed"): "233604007"}
    assert rq.extracted_and_mapped(docs.limit(0), engine.concepts, include_fuzzy=False).count() == 0


def test_scores_follow_the_context(spark):
    terms = spark.createDataFrame([(1, "diabetes", "glucose high"), (2, "x", "DIAGNOSIS of x"), (3, "x", None), (4, "glucose", "serum sample"), (5, "thing", "a count"), (6, "diabetes", "diagnosis, insulin")], "term_id long, term string, context string")
    rows = [(1, "snomed", True, "diabetes", 0.85, "token", "fuzzy"), (2, "snomed", True, "x", 0.5, "synonym", "synonym"), (3, "snomed", True, "x", 0.8, "token", "fuzzy"), (4, "loinc", True, "glucose", 0.9, "component", "lookup"), (5, "loinc", True, "thing", 0.7, "token", "fuzzy"), (6, "snomed", True, "diabetes", 1.0, "variation", "fuzzy"), (7, "snomed", False, None, None, None, None)]
    got = {r.term_id: (r.score, r.confidence, r.context_enhanced, r.context_term) for r in en.scored_in_context(terms, spark.createDataFrame(rows, "term_id long, system string, found boolean, display string, confidence double, match_type string, via string")).collect()}
    assert got == {1: (95.0, 0.95, True, "glucose"), 2: (100.0, 1.0, True, None), 3: (80.0, 0.8, False, None), 4: (None, 0.9, True, None), 5: (80.0, 0.8, True, None), 6: (100.0, 1.0, True, None), 7: (None, None, False, None)}


def test_fallback_by_domain(spark):
    read = spark.createDataFrame([(1, "laboratory"), (2, "endocrinology"), (3, "endocrinology"), (4, "general"), (5, "cardiology")], "term_id long, domain string")
    hits = [(1, "snomed", "a", "A", 99.0), (1, "loinc", "b", "B", 90.0), (2, "snomed", "c", "C", 59.0), (2, "loinc", "d", "D", 60.0), (3, "snomed", "e", "E", 61.0), (3, "snomed", "f", "F", 62.0), (3, "loinc", "g", "G", 99.0), (4, "snomed", "h", "H", 99.0)]
    got = {r.term_id: (r.system, r.code, round(r.confidence, 6)) for r in en.fallback(read, spark.createDataFrame(hits, "term_id long, system string, code string, display string, score double")).collect()}
    assert got == {1: ("loinc", "b", 1.0), 2: ("loinc", "d", 0.69), 3: ("snomed", "f", 0.713)}
    terms = spark.createDataFrame([(1, "k", "serum glucose lab test result"), (9, "k", "nothing")], "term_id long, term string, context string")
    none = spark.createDataFrame([], "term_id long, system string, found boolean, code string, display string, confidence double, match_type string")
    rows = {r.term_id: (r.found, r.code, r.match_type) for r in en.with_context(terms.withColumn("domain_hint", F.lit("laboratory")), none, spark.createDataFrame(hits, "term_id long, system string, code string, display string, score double")).collect()}
    assert rows == {1: (True, "b", "context_aware_fuzzy"), 9: (False, None, None)}


def test_job_summary(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    jobs = spark.createDataFrame([("p", 5, at(0)), ("r", 10, at(0)), ("c", 10, at(0)), ("f", 10, at(0)), ("e", 0, at(0))], "job_id string, total long, created timestamp")
    chunks = spark.createDataFrame([("r", at(1), 3, 1, None), ("c", at(1), 5, 0, None), ("c", at(2), 4, 1, None), ("f", at(3), 1, 0, "late"), ("f", at(2), 1, 0, "early"), ("gone", at(1), 1, 1, None)], "job_id string, at timestamp, successful long, failed long, error string")
    got = {r.job_id: (r.status, r.progress, r.seconds, r.error) for r in st.job_summary(jobs, chunks).collect()}
    assert got == {"p": ("pending", 0.0, 0.0, None), "r": ("processing", 40.0, 60.0, None), "c": ("completed", 100.0, 120.0, None), "f": ("failed", 20.0, 180.0, "early"), "e": ("pending", 100.0, 0.0, None)}


def test_batch_summary(spark):
    docs = spark.createDataFrame([("b", "1", "completed"), ("b", "2", "failed"), ("c", "3", "pending")], "batch_id string, document_id string, status string").withColumns({c: F.lit(None).cast("timestamp") for c in ("started", "ended")})
    entities = spark.createDataFrame([("b", "1", "drug", "rxnorm", "7"), ("b", "1", "drug", "rxnorm", None), ("b", "1", "lab", None, None), ("b", "2", "lab", "loinc", "8")], "batch_id string, document_id string, kind string, system string, code string")
    got = {r.batch_id: (r.total_entities, r.entities_by_type, r.mappings_by_system, r.successful) for r in do.batch_summary(docs, entities).collect()}
    assert got == {"b": (3, {"drug": 2, "lab": 1}, {"rxnorm": 1}, 1), "c": (0, {}, {}, 0)}


def test_response_cache(spark, tmp_path):
    cache = remote.ResponseCache(spark, str(tmp_path / "cache"))
    at = lambda s: F.to_timestamp(F.lit(s))
    asked = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "key string, n int")
    assert cache.missing(asked, at("2024-01-02 00:30:00")).count() == 3
    responses = spark.createDataFrame([("a", "old", "2024-01-01 22:00:00"), ("a", "new", "2024-01-01 23:45:00"), ("b", "gone", "2024-01-01 23:30:00"), ("c", "other", "2024-01-02 00:10:00")], "key string, body string, fetched_at string")
    cache.save(responses.withColumn("fetched_at", F.to_timestamp("fetched_at")))
    assert {(r.key, r.n, r.body) for r in cache.answers(asked, at("2024-01-02 00:30:00")).collect()} == {("a", 1, "new"), ("b", 2, None), ("b", 3, None), (None, 4, None)}
    cache.save(spark.createDataFrame([("b", "late")], "key string, body string").withColumn("fetched_at", at("2024-01-02 00:20:00")))
    assert {r.key for r in cache.missing(asked, at("2024-01-02 00:30:00")).collect()} == {None}


def test_thresholds_of_the_fuzzy_tiers(spark, engine):
    terms = spark.createDataFrame([(0, "asthmaa")], "term_id long, term string")
    own = {"snomed": engine.concepts["snomed"]}
    assert cascade.map_terms(terms, own).first().found and not cascade.map_terms(terms, own, thresholds={"difflib": 0.99}).first().found
    for wrong in ({"difflib": 0.5}, {"other": 0.9}, {"cosine": 1.5}):
        with pytest.raises(ValueError):
            cascade.fuzzy_thresholds(wrong)


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.9, 1.0])
def test_algorithms_miss_no_pair(spark, threshold):
    """Each algorithm against all pairs of random texts, with repeated letters and tokens, at any threshold."""
    rng = random.Random(int(threshold * 10))
    texts = {"form", "from", "abcd", "acbd", "a", "b a", "a b", "aaaa", "aaab aaab", "robert", "rupert", "knight", "nite", "smith", "smyth", "x", "日本", "日本語", "pre fix", "prefixed"}
    for _ in range(40):
        words = ["".join(rng.choice("abc") for _ in range(rng.choice((1, 2, 4, 6)))) for _ in range(rng.randint(1, 3))]
        texts |= {" ".join(words), " ".join(rng.sample(words, len(words)))}
    texts = sorted(texts)
    queries = spark.createDataFrame([(x,) for x in texts], "q string")
    keys = queries.withColumnRenamed("q", "key")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return row[-1]

    brute = {
        "levenshtein": lambda a, b: 1 - distance(a, b) / max(len(a), len(b)),
        "jaro_winkler": sim.jaro_winkler,
        "token_sort_ratio": lambda a, b: sim.token_sort_ratio(a, b) / 100,
        "token_set_ratio": lambda a, b: sim.token_set_ratio(a, b) / 100,
    }
    every = {}
    for place, (name, score) in enumerate(brute.items()):
        got = {(r.q, r.key): r.score for r in fz.by_algorithms(queries, keys, (name,), threshold, 10_000).collect()}
        want = {(a, b): s for a, b in itertools.product(texts, texts) if (s := round(score(a, b), 6)) >= threshold}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 2e-6 for k, v in want.items()), name
        for k, s in want.items():
            every.setdefault(k, []).append((-s, place))
    if threshold == 0.7:
        got = [(r.q, r.key, r.algorithm, r["rank"]) for r in fz.by_algorithms(queries, keys, tuple(brute), threshold, 3).collect()]
        best = sorted((q, min(v)[0], k, list(brute)[min(v)[1]]) for (q, k), v in every.items())
        assert sorted(got) == sorted((q, k, name, n) for _, group in itertools.groupby(best, key=lambda x: x[0]) for n, (q, _, k, name) in enumerate(itertools.islice(group, 3), 1))
        alike = {(r.q, r.key): r.score for r in fz.by_algorithms(queries, keys, ("phonetic",), 0.7, 10_000).collect()}
        assert alike["smith", "smyth"] == 0.9 and ("robert", "rupert") in alike and ("knight", "x") not in alike


def test_unknown_algorithms(spark):
    rows = spark.createDataFrame([("a",)], "q string")
    for names, threshold in ((("soundly",), 0.7), ((), 0.7), (("all",), 0.0)):
        with pytest.raises(ValueError):
            fz.by_algorithms(rows, rows.withColumnRenamed("q", "key"), names, threshold)


def test_engine_by_algorithms(spark, engine):
    terms = spark.createDataFrame([(0, "Asthmaa"), (1, "mellitus diabetes"), (2, " "), (3, "nothing like it")], "term_id long, term string")
    got = {(r.term_id, r["rank"]): (r.code, r.algorithm) for r in engine.fuzzy_matches(terms, "snomed", ("levenshtein", "token_sort_ratio")).collect()}
    assert got[0, 1] == ("195967001", "token_sort_ratio") and got[1, 1] == ("73211009", "token_sort_ratio") and not {2, 3} & {k[0] for k in got}
