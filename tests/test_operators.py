"""Operators on small literal tables."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vocabmill.operators import context as cx, documents as do, extract as ex, fuzzy as fz, graph as gr, lookup as lk, rules as ru, stats as st
from vocabmill.plans.api import Engine
from vocabmill.plans.enhanced import enhanced
from vocabmill.queries import base, clinical
from vocabmill.sources import readers, remote, writers


def conditions(spark):
    return spark.createDataFrame(base.CLINICAL_CONDITIONS, "id long, code string, term string, display string, concept_type string, is_active int")


def terms(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "term_id long, term string")


def test_contains_takes_the_lowest_id(spark):
    asked = terms(spark, "diabetes", "a", "zzz", "").withColumn("q", F.col("term"))
    hits = {r.term_id: r.id for r in lk.containing(asked, conditions(spark), F.col("q"), F.col("term"), 1, 0.8, "partial").collect()}
    assert hits == {0: 1000000001, 1: 1000000001}


def test_engine(spark, tmp_path):
    engine = Engine(spark, {"snomed": conditions(spark)})
    got = {r.term_id: (r.code, r.match_type) for r in engine.map_terms(terms(spark, "History of Hypertension", "MI", "asthmaa", "   ", "nothing at all")).collect()}
    assert got[0] == ("38341003", "exact") and got[1] == ("22298006", "abbreviation") and got[2] == ("195967001", "levenshtein") and not {3, 4} & set(got)
    engine.add_custom_mapping("snomed", "odd term", "1", "Odd")
    assert engine.map_term("odd term", include_fuzzy=False)[0]["code"] == "1"
    with pytest.raises(ValueError):
        engine.map_term("")
    with pytest.raises(ValueError):
        engine.map_terms(terms(spark, "x"), systems=["icd10"])
    assert engine.systems().where("supported").count() == 1 and engine.statistics().first().n_concepts == 10


def test_walks_end_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b", gr.IS_A, 1), ("b", "c", gr.IS_A, 1), ("c", "a", gr.IS_A, 1), ("c", "d", gr.IS_A, 0)], "source string, destination string, kind string, is_active int")
    starts = spark.createDataFrame([("a",)], "code string")
    assert {(r.reached, r.depth) for r in gr.reach(starts, edges).collect()} == {("b", 1), ("c", 2)}
    assert {(r.reached, r.depth) for r in gr.reach(starts, edges, up=False).collect()} == {("c", 1), ("b", 2)}


def test_context(spark):
    rows = spark.createDataFrame([("patient denies any history of chest pain",), ("patient is feeling well today",), ("possible copd, lung and asthma",)], "x string")
    got = rows.select(cx.modifiers(F.col("x")).alias("m"), cx.domain(F.col("x")).alias("d")).collect()
    assert got[0].m == ["negation", "past_history"] and got[1].d == "general" and (got[2].m, got[2].d) == (["uncertainty"], "pulmonology")
    ties = spark.createDataFrame([(0, "lung and heart"), (1, "heart, lung and asthma"), (2, ""), (3, None)], "i int, x string")
    assert [r.d for r in ties.orderBy("i").select(cx.domain(F.col("x")).alias("d")).collect()] == ["cardiology", "pulmonology", "general", None]


@pytest.mark.parametrize("context, term, cue", [("patient denies chest pain", "chest pain", "denies"), ("no fever but chest pain", "chest pain", None), ("denies fever. chest pain", "chest pain", None), ("no evidence of acute asthma", "asthma", "no evidence of"), ("has asthma", "asthma", None), ("asthma", "gout", None), ("not one two three four five six asthma", "asthma", None)])
def test_negation(spark, context, term, cue):
    assert spark.createDataFrame([(context, term)], "c string, t string").select(cx.negation_cue(F.col("c"), F.col("t"))).first()[0] == cue


def test_rules(spark):
    rules = clinical.rules(spark)
    asked = spark.createDataFrame([(0, "CHEST PAIN", {}), (1, "stomach pain", {}), (2, "bp", {}), (3, "blood  pressure", {}), (4, "heart rate", {}), (5, "x", {"domain": "cardiology"}), (6, "headache", {}), (7, "asthma", {}), (8, "copd", {})], "term_id long, term string, context map<string,string>")
    found = {}
    for r in ru.matches(asked, rules).collect():
        found.setdefault(r.term_id, set()).add(r.rule_id)
    assert found == {0: {"r1"}, 2: {"r2"}, 3: {"r2"}, 5: {"r3", "r4"}, 6: {"r5"}}
    base_rows = asked.select("term_id", F.array(F.struct(F.lit("B").alias("code"), F.lit("snomed").alias("system"), F.lit("b").alias("display"), F.lit(0.5).alias("confidence"), F.lit("exact").alias("match_type"))).alias("mappings"))
    applied = {r.term_id: [m.code for m in r.mappings] for r in ru.apply(base_rows, ru.ranked(ru.matches(asked, rules), rules)).collect()}
    assert applied[0] == ["29857009", "B"] and applied[6] == ["999999"] and applied[1] == ["B"] and applied[5] == ["22253000", "B"]
    wrong = {r.rule_id: r.e for r in rules.select("rule_id", ru.errors(rules).alias("e")).collect() if r.e}
    assert wrong == {"r9": ["missing target_display", "pattern doesn't compile"], "r10": ["no required context"]}


def test_many_rules(spark, monkeypatch):
    """no number of rules is too large; rules that require something meet by key, those that require absence don't."""
    rows = [(f"d{i}", "domain", "x", {"domain": f"k{i % 3}"}) for i in range(10_100)]
    rows += [(f"c{i}", "context", "x", {"required:a": str(i), "required:b": None if i == 2 else "1"}) for i in range(10_100)]
    rows += [("none", "context", "x", {"required:z": None}), ("p1", "pattern", "^pain$", {}), ("p2", "pattern", "x", {"pattern": "PA.N"}), ("empty", "context", "x", {"y": "1"})]
    rules = spark.createDataFrame([(*r, True) for r in rows], "rule_id string, rule_type string, source_term string, conditions map<string,string>, is_active boolean")
    asked = spark.createDataFrame([(0, "pain", {"a": "1", "b": "1", "z": "1"}), (1, "x", {"a": "2"}), (2, "big pain", {"a": "3", "b": "2", "z": "1"}), (3, "y", None)], "term_id long, term string, context map<string,string>")
    want = [(0, "c1"), (0, "p1"), (0, "p2"), (1, "c2"), (1, "none"), (2, "p2"), (3, "none")]
    for most in (10_000, 2):
        monkeypatch.setattr(ru, "MAX_BROADCAST_RULES", most)
        assert sorted((r.term_id, r.rule_id) for r in ru.matches(asked, rules).collect()) == want
    one = spark.createDataFrame([(0, "q", {"domain": "k1"})], "term_id long, term string, context map<string,string>")
    assert sorted(r.rule_id for r in ru.matches(one, rules).collect()) == sorted([*(f"d{i}" for i in range(1, 10_100, 3)), "none"])


def test_rules_of_one_key_are_shared_out(spark, monkeypatch):
    """a term and a rule of one key make as many rows as their product, so no single task may make them all."""
    monkeypatch.setattr(ru, "BLOCK", 10, raising=False)
    monkeypatch.setattr(ru, "SLICE", 2, raising=False)
    rows = [(f"e{i}", "exact", "PAIN" if i else None, {}) for i in range(60)] + [("e60", "override", "gout", {})]
    rows += [(f"d{i}", "domain", "x", {"domain": "k"} if i else {}) for i in range(60)]
    rows += [(f"c{i}", "context", "x", {"required:a": "1", "required:b": str(i % 2)}) for i in range(60)]
    rules = spark.createDataFrame([(*r, True) for r in rows], "rule_id string, rule_type string, source_term string, conditions map<string,string>, is_active boolean")
    asked = spark.createDataFrame([(0, "pain", {}), (1, "Pain", {"domain": "k"}), (1, "Pain", {"domain": "k"}), (2, "gout", {"a": "1", "b": "1"}), (3, None, None)], "term_id long, term string, context map<string,string>")
    exact, domain = [f"e{i}" for i in range(1, 60)], [f"d{i}" for i in range(1, 60)]
    want = [(0, e) for e in exact] + [(1, r) for r in exact + domain] * 2 + [(2, "e60")] + [(2, f"c{i}") for i in range(1, 60, 2)]
    assert sorted((r.term_id, r.rule_id) for r in ru.matches(asked, rules).collect()) == sorted(want)
    one = ru.matches(asked.where("term_id = 0"), rules)
    assert one.select(F.spark_partition_id()).distinct().count() > 1


def test_enhanced_lowers_negated_terms(spark):
    notes = spark.createDataFrame([(1, "chest pain", "patient denies chest pain")], "term_id long, term string, context string")
    found = Engine(spark, {"snomed": conditions(spark)}).map_terms(notes, include_fuzzy=False).withColumn("found", F.lit(True))
    row = enhanced(notes, found, clinical.rules(spark).where("rule_id = 'r6'")).first()
    assert row.is_negated and row.mappings[0].confidence < 0.3 and "negated" in row.mappings[0].match_type


def test_merging_spans(spark):
    rows = spark.createDataFrame([([(0, 17, 0.9), (0, 8, 0.8), (25, 34, 0.95), (35, 40, 0.85)],), ([],)], "s array<struct<start:int,end:int,confidence:double>>")
    assert [len(r[0]) for r in rows.select(ex.merged(F.col("s"))).collect()] == [3, 0]


def test_windows_cover_the_text(spark):
    texts = ["", "a" * 100, "b" * 101, "c" * 365]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(ex.windows(F.col("text"))).collect()
    assert [len(r[0]) for r in got] == [0, 1, 2, 5] and got[3][0][-1].end == 365


def test_spans(spark):
    text = "Diabetes and diabetes, aspirin 81mg twice daily"
    got = spark.createDataFrame([(text,), (None,)], "text string").select(ex.term_spans(F.col("text"))).collect()
    assert [(s.text, s.start) for s in got[0][0]] == [("Diabetes", 0), ("diabetes", 13), ("aspirin", 23)] and got[1][0] == []


def test_levenshtein_finds_all_pairs(spark):
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) for _ in range(60)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    df = spark.createDataFrame([(w,) for w in words], "q string")
    got = {(r.q, r.key) for r in fz.levenshtein_within(df, df.withColumnRenamed("q", "key"), 2).collect()}
    assert got == {(a, b) for a in words for b in words if distance(a, b) <= 2}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('term,context\n"pain, severe",x\nNA,y\n,z\nasthma,\n')
    (tmp_path / "a.txt").write_text(" one \n\ntwo\n")
    (tmp_path / "l.json").write_text(json.dumps(["x", "y"]))
    (tmp_path / "o.json").write_text(json.dumps([{"term": "x"}, {"term": "z"}]))
    (tmp_path / "m.json").write_text(json.dumps(["x", {"term": "z"}]))
    read = lambda f, k: [r.term for r in readers.terms(spark, str(tmp_path / f), k).orderBy("term_id").collect()]
    assert read("a.csv", "csv") == ["pain, severe", "NA", "asthma"] and read("a.txt", "txt") == ["one", "two"]
    assert read("l.json", "json") == ["x", "y"] and read("o.json", "json") == ["x", "z"]
    for f, k in (("m.json", "json"), ("a.csv", "xml")):
        with pytest.raises(ValueError):
            read(f, k)
    with pytest.raises(ValueError):
        readers.terms(spark, str(tmp_path / "a.csv"), "csv", "nope")
    (tmp_path / "syn").mkdir()
    (tmp_path / "syn" / "1.json").write_text(json.dumps({"a_syn": ["p", "q"], "b_syn": ["r"]}))
    (tmp_path / "syn" / "2.json").write_text(json.dumps({"a_syn": ["new"]}))
    assert {(r.set_key, r.position, r.synonym) for r in readers.synonym_sets(spark, str(tmp_path / "syn")).collect()} == {("a_syn", 0, "new"), ("b_syn", 0, "r")}
    (tmp_path / "c.json").write_text(json.dumps({"snomed": {"t": {"code": "1", "display": "T", "found": True}}, "loinc": {}}))
    assert [tuple(r) for r in readers.custom_mappings(spark, str(tmp_path / "c.json")).collect()] == [("snomed", "t", "1", "T")]
    assert readers.table(spark, str(tmp_path / "none.parquet"), readers.CONCEPTS).count() == 0
    assert {r.name for r in readers.file_catalogue(spark, str(tmp_path / "*.csv")).collect()} == {"a.csv"}


def test_rules_round_trip(spark, tmp_path):
    rules = clinical.rules(spark).withColumn("metadata", F.lit(None).cast("string")).withColumn("updated_at", F.col("created_at")).withColumn("created_by", F.lit("me"))
    writers.rules_json(rules.repartition(3), str(tmp_path / "r"), include_inactive=True)
    valid, invalid = readers.rules_json(spark, str(tmp_path / "r"))
    assert valid.count() == 8 and {r.rule_id for r in invalid.collect()} == {"r9", "r10"}
    (tmp_path / "one.json").write_text(json.dumps([{"rule_id": "a", "rule_type": "exact", "priority": 1, "source_term": "x", "target_code": "1", "target_system": "s", "target_display": "d", "conditions": {"note": "n"}}, {"rule_id": "b"}], indent=1))
    valid, invalid = readers.rules_json(spark, str(tmp_path / "one.json"))
    assert [(r.rule_id, r.conditions) for r in valid.collect()] == [("a", {"note": "n"})] and [r.rule_id for r in invalid.collect()] == ["b"]


def test_fuzzy_scorers_miss_no_pair(spark):
    """Against all pairs, with keys and tokens of one letter among them."""
    import itertools
    import random

    from vocabmill.functions import similarity as sim

    rng = random.Random(11)
    texts = {"a", "b", "c d", "d c", "a b", "b q a", "long query of words", "query long words of"}
    for _ in range(70):
        words = ["".join(rng.choice("abcd") for _ in range(rng.choice((1, 1, 2, 4, 6)))) for _ in range(rng.randint(1, 4))]
        texts |= {" ".join(words), " ".join(rng.sample(words, len(words))), " ".join(words)[: rng.randint(1, 12)].strip()}
    texts = sorted(texts - {""})
    rows = spark.createDataFrame([(x,) for x in texts], "q string")
    keys = rows.withColumnRenamed("q", "key")
    scorers = fz.library_scorers()
    got = {(r.q, r.key, r.method): r.score for r in fz.scored(rows, keys, scorers).collect()}
    want = {(x, y, n): score for x, y in itertools.product(texts, texts) for n, least in scorers.items() if (score := getattr(sim, n)(x, y)) >= least}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    best = {r.q: (r.score, r.method, r.key) for r in fz.best_of(fz.scored(rows, keys, scorers)).collect()}
    order = list(scorers)
    assert best == {q: (s, order[p], k) for q, (s, p, k) in ((q, min((-v, order.index(n), k) for (x, k, n), v in want.items() if x == q)) for q in texts) for s in [-s]}
    near = {(r.q, r.key) for r in fz.scored(rows, keys, {"difflib_ratio": 0.8}, least=0.8).collect()}
    assert near == {(x, y) for x, y in itertools.product(texts, texts) if sim.difflib_ratio(x, y) >= 0.8}


def test_search_against_brute_force(spark):
    """FUZ07: concepts that contain a variation of the term, rated by difflib."""
    import random

    from vocabmill.functions import normalize as nz, similarity as sim

    rng = random.Random(6)
    words = ["heart", "failure", "chest", "pain", "acute", "renal", "disease", "test"]
    names = sorted({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(60)})
    concepts = spark.createDataFrame([(i, f"c{i}", n) for i, n in enumerate(names)], "id long, code string, term string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["Heart failure", "chest", "acute renal", "zz", "pain test", "", "he"])], "term_id long, term string")
    varied = {r.term_id: (r.q, r.vs) for r in asked.select("term_id", nz.clean(F.col("term")).alias("q")).select("term_id", "q", nz.variations(F.col("q")).alias("vs")).collect()}
    want = set()
    for term_id, (q, vs) in varied.items():
        hits = {}
        for v in vs:
            if len(v) >= 3:
                for i in [i for i, n in enumerate(names) if v in n][:20]:
                    score = round(sim.difflib_ratio(q, names[i]), 6)
                    if score >= 0.8:
                        hits[f"c{i}"] = score
        want |= {(term_id, code, score, n) for n, (score, code) in enumerate(sorted(((s, c) for c, s in hits.items()), key=lambda x: (-x[0], x[1]))[:10], 1)}
    assert {(r.term_id, r.code, r.score, r["rank"]) for r in fz.search(asked, concepts).collect()} == want and len(want) > 3


def test_search_of_many_concepts_with_one_term(spark):
    """terms and concepts of one name don't multiply; codes of two names keep their better score."""
    n = 400
    concepts = [(i, f"c{i:05d}", "heart failure") for i in range(n)] + [(n + i, f"c{i:05d}" if i == 3 else f"b{i:05d}", "heart failures") for i in range(n)]
    asked = [(i, "Heart failure" if i % 2 else "heart failures") for i in range(n)]
    found = fz.search(spark.createDataFrame(asked, "term_id long, term string"), spark.createDataFrame(concepts, "id long, code string, term string")).cache()
    rows = {}
    for r in found.collect():
        rows.setdefault(r.term_id, []).append((r["rank"], r.code, r.score))
    assert len(rows) == n and sorted(rows[1]) == [(i + 1, f"c{i:05d}", 1.0) for i in range(10)]
    assert sorted(rows[0]) == [(i + 1, c, 1.0) for i, c in enumerate([*(f"b{i:05d}" for i in range(11) if i != 3)][:10])]
    joined = fz.search(spark.createDataFrame(asked, "term_id long, term string"), spark.createDataFrame(concepts, "id long, code string, term string"))
    assert _most_rows(spark, joined) < 20 * n


def _most_rows(spark, df):
    """The most rows that a join of the plan made."""
    df.write.format("noop").mode("overwrite").save()
    qe = df._jdf.queryExecution()
    df.collect()
    counts, todo = [], [qe.executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if "Join" in node.nodeName():
            metric = node.metrics().get("numOutputRows")
            counts.append(metric.get().value() if metric.isDefined() else 0)
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert counts
    return max(counts)


def test_drug_search_of_many_drugs(spark):
    """a term's answers are cut to the first before its requests meet them."""
    body = json.dumps({"drugGroup": {"conceptGroup": [{"tty": "T", "conceptProperties": [{"rxcui": f"{i:04d}", "name": f"n{i}"} for i in range(500)]}]}})
    responses = spark.createDataFrame([("size 1", body)], "term string, body string")
    near = spark.createDataFrame([("sise 1", 0, "size 9"), ("sise 1", 1, "size 1")], "term string, position int, suggestion string")
    asked = spark.createDataFrame([(i, "Size 1" if i % 2 else "sise 1") for i in range(300)] + [(1, "sise 1")], "term_id long, term string")
    found = remote.drug_search(asked, responses, near, 3)
    rows = sorted((r.term_id, r.code, r.spelled or "") for r in found.select("term_id", "code", "spelled").collect())
    assert rows[:3] == [(0, "0000", "size 1"), (0, "0001", "size 1"), (0, "0002", "size 1")] and len(rows) == 900 and len([r for r in rows if r[0] == 1]) == 3
    assert _most_rows(spark, found) < 2000


def test_phonetic_keys():
    from vocabmill.functions.similarity import phonetic_key

    alike = (("Philip", "Filip"), ("Knight", "Nit"), ("Wright", "Rit"), ("Schmid", "Skmid"), ("Jack", "Jak"))
    for x, y in alike:
        assert phonetic_key(x) == phonetic_key(y), (x, y)
    assert phonetic_key("asthma") != phonetic_key("anemia") and phonetic_key("two words").count(" ") == 1 and phonetic_key("") == ""


def test_negation_by_cases(spark):
    from vocabmill.operators import context as cx

    cases = {("patient denies chest pain", "chest pain"): "denies", ("no fever but chest pain", "chest pain"): None, ("no a b c d e f chest pain", "chest pain"): None, ("negative for chest pain", "Chest Pain"): "negative for", ("no. chest pain", "chest pain"): None, ("chest pain, no fever", "chest pain"): None, ("", "x"): None}
    rows = spark.createDataFrame(list(cases), "context string, term string")
    assert {(r.context, r.term): r.cue for r in rows.select("*", cx.negation_cue(F.col("context"), F.col("term")).alias("cue")).collect()} == cases


def test_facade_job(spark, tmp_path):
    engine = Engine(spark, {"snomed": conditions(spark)})
    out = str(tmp_path / "job")
    assert engine.job_status(out).first().status == "pending"
    (tmp_path / "t.txt").write_text("asthma\nqqqq\n")
    engine.run_job(str(tmp_path / "t.txt"), "txt", out, include_fuzzy=False)
    row = engine.job_status(out).first()
    assert (row.status, row.total, row.successful, row.failed) == ("completed", 2, 1, 1)
    assert sorted((r.term, r.code is not None) for r in engine.job_results(out).collect()) == [("asthma", True), ("qqqq", False)]
    assert "difflib" in {r.algorithm for r in engine.fuzzy_algorithms().collect()}
    assert {r.name for r in engine.test_files(str(tmp_path / "*.txt")).collect()} == {"t.txt"}


def test_providers(spark):
    asked = spark.createDataFrame([(1, "Asthma")], "term_id long, term string")
    systems = spark.createDataFrame([("snomed",)], "system string")
    assert remote.lookup(asked, [], systems).count() == 0
    engine = Engine(spark, {"snomed": conditions(spark)}, providers=[spark.createDataFrame([("snomed", "zzz", "9", "Z")], "system string, term string, code string, display string")])
    assert engine.map_term("zzz", include_fuzzy=False)[0]["code"] == "9"


def test_job(spark, tmp_path):
    (tmp_path / "t.txt").write_text("asthma\nqqqq\n")
    row = Engine(spark, {"snomed": conditions(spark)}).run_job(str(tmp_path / "t.txt"), "txt", str(tmp_path / "out"), include_fuzzy=False).first()
    assert (row.total, row.successful, row.failed, row.total_matches) == (2, 1, 1, 1)


def test_cache_and_documents(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 11:30:00")], "key string, t string").withColumn("fetched_at", F.to_timestamp("t"))
    assert [r.key for r in remote.fresh(rows, F.to_timestamp(F.lit("2024-01-01 12:00:00"))).collect()] == ["b"]
    files = spark.createDataFrame([(bytearray(b"%PDF-1.7"), "pdf"), (bytearray(b"plain"), "pdf"), (bytearray(b"plain"), "txt"), (bytearray(b"x"), "exe")], "c binary, k string")
    assert [r[0] for r in files.select(do.fits_type(F.col("c"), F.col("k"))).collect()] == [True, False, True, False]
    with pytest.raises(Exception):
        spark.range(1).select(do.checked_confidence(F.lit(1.5))).collect()
    jobs = spark.createDataFrame([("j", i) for i in range(150)] + [("k", i) for i in range(90)], "job_id string, n int")
    pages = {r.job_id: r["count"] for r in st.job_results(jobs, ["n"], 20, 5).groupBy("job_id").count().collect()}
    assert pages == {"j": 20, "k": 85}


def test_stream(spark, tmp_path):
    from vocabmill.streaming import jobs

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps({"term_id": i * 10 + k, "term": t, "ts": "2024-01-01T00:00:00"}) + "\n" for k, t in enumerate(["asthma", "pneumonia"])))
    engine = Engine(spark, {"snomed": conditions(spark)})
    query = jobs.run(jobs.first_seen(jobs.term_stream(spark, str(tmp_path / "in"), 2)), lambda df: engine.map_terms(df.select("term_id", "term"), include_fuzzy=False), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and jobs.progress(query)["rows"] == 6


def test_jaro_winkler_misses_no_pair(spark):
    """Against all pairs: short and swapped names share no two neighbouring letters."""
    import itertools
    import random

    from vocabmill.functions.similarity import jaro_winkler
    from vocabmill.operators.fuzzy import jaro_winkler_candidates

    rng = random.Random(3)
    names = {"form", "from", "abcd", "acbd", "abcdefg", "acbdfeg", "a", "ab", "ba", "aa", "\u00e9t\u00e9", "t\u00e9\u00e9"}
    for _ in range(60):
        name = [rng.choice("abcde fg") for _ in range(rng.randrange(1, 24))]
        names.add("".join(name))
        for _ in range(3):
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(name))
                name[i : i + 2] = name[i : i + 2][::-1]
            names.add("".join(name)[: rng.randrange(1, 30)])
    names = sorted(names)
    rows = spark.createDataFrame([(x,) for x in names], "q string")
    found = {(r.q, r.key) for r in jaro_winkler_candidates(rows, rows.withColumnRenamed("q", "key")).collect()}
    wanted = {(x, y) for x, y in itertools.product(names, names) if round(jaro_winkler(x, y), 6) >= 0.9}
    assert wanted <= found and ("form", "from") in wanted and ("abcdefg", "acbdfeg") in wanted
    assert len(found) < len(names) ** 2 / 2


def test_xlsx_drops_no_row(spark, monkeypatch, tmp_path):
    from vocabmill.sources import writers

    monkeypatch.setattr(writers, "SHEET_ROWS", 10, raising=False)
    with pytest.raises(ValueError, match="rows"):
        writers.documents(spark.range(11), str(tmp_path / "x.xlsx"), "xlsx")


def _bags(spark, seed, n, column):
    """Random short names over few tokens, of which the first is in most names."""
    draw = random.Random(seed)
    made = {" ".join(["acute"] * (draw.random() < 0.8) + draw.choices("abc def ghi jkl mno pqr stu vwx yza bcd".split(), k=draw.randint(0, 5))) for _ in range(n)} | {"", "acute"}
    return sorted(made), spark.createDataFrame([(x,) for x in sorted(made)] + [(None,)], f"{column} string")


@pytest.mark.parametrize("least", [0.4, 0.7, 1.0])
def test_token_pairs_against_all_pairs(spark, least):
    qs, queries = _bags(spark, 1, 40, "q")
    ks, keys = _bags(spark, 2, 80, "key")
    want = set()
    for x in qs:
        for y in ks:
            a, b = set(x.split()), set(y.split())
            if a and b and len(a & b) / len(a | b) >= least:
                want.add((x, y, round(len(a & b) / len(a | b), 9)))
    assert want and {(r.q, r.key, round(r.jaccard, 9)) for r in fz.token_jaccard(queries, keys, least).collect()} == want


@pytest.mark.parametrize("least", [0.3, 0.7, 0.95])
def test_cosine_against_all_pairs(spark, least):
    qs, queries = _bags(spark, 3, 40, "q")
    ks, keys = _bags(spark, 4, 80, "key")

    def grams(x):
        t = x.split()
        return t + [f"{a} {b}" for a, b in zip(t, t[1:])]

    n, df = len(ks), {}
    for y in ks:
        for g in set(grams(y)):
            df[g] = df.get(g, 0) + 1

    def unit(x):
        raw = {g: c * (math.log((1 + n) / (1 + df[g])) + 1) for g, c in Counter(grams(x)).items() if g in df}
        size = math.sqrt(sum(w * w for w in raw.values()))
        return {g: w / size for g, w in raw.items()}

    want, vectors = {}, {y: unit(y) for y in ks}
    for x in qs:
        own = unit(x)
        best = min(((-round(sum(w * v.get(g, 0) for g, w in own.items()), 6), y) for y, v in vectors.items()), default=(0, ""))
        if -best[0] >= least:
            want[x] = (best[1], -best[0])
    found = {r.q: (r.key, r.cosine) for r in fz.cosine(queries, fz.tfidf(keys.where("key IS NOT NULL")), least).collect()}
    assert want and found == want
