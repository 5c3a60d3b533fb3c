"""Normalisers against plain Python, similarities against hand-computed values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vocabmill.functions import fixed_values as fv, normalize as nz, similarity as sim


def one(spark, rows, *columns):
    df = spark.createDataFrame([(x,) for x in rows], "x string")
    return [r[0] for r in df.select(*columns).collect()]


def py_term(x):
    x = x.lower().strip(" ")
    for p in fv.TERM_PREFIXES:
        x = x[len(p) :] if x.startswith(p) else x
    x = re.sub(r"\s+", " ", re.sub(r"[,.;:!?()]", " ", x)).strip(" ")
    return x.replace("%", " percent").replace("&", " and ")


def py_drug(x):
    x = re.sub(r"\b\d+\s*(?:mg|g|mcg|ml|mEq)\b", "", x.lower())
    for f in fv.DOSAGE_FORMS:
        x = x.replace(f, "")
    x = re.sub(r"\([^)]*\)", "", x)
    for s in fv.BRAND_SUFFIXES:
        x = x[: -len(s)] if x.endswith(s) else x
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", x)).strip(" ")


def test_terms_against_python(spark):
    rng = random.Random(1)
    parts = [*fv.TERM_PREFIXES, "asthma", "pain, severe", "H2O & 5%", " x ", "(left)", "é", "history", "10mg tablet", "oral", "xr", "-xr"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for _ in range(300)]
    assert one(spark, texts, nz.normalize_term(F.col("x"))) == [py_term(t) for t in texts]
    assert one(spark, texts, nz.normalize_drug(F.col("x"))) == [py_drug(t) for t in texts]


@pytest.mark.parametrize("text, want", [("acute chronic x", "chronic x"), ("chronic acute x", "x"), ("History of Asthma", "asthma"), ("a, b", "a b")])
def test_prefixes_go_once_in_order(spark, text, want):
    assert one(spark, [text], nz.normalize_term(F.col("x"))) == [want]


@pytest.mark.parametrize("text, want", [("lisinopril 10mg", "lisinopril"), ("metformin 500 mg tablet", "metformin"), ("ibuprofen 200mg oral tablet", "ibuprofen")])
def test_drugs(spark, text, want):
    assert one(spark, [text], nz.normalize_drug(F.col("x"))) == [want]


@pytest.mark.parametrize("text, want", [("serum sodium level", "sodium"), ("HbA1c", "hemoglobin a1c"), ("lab test hgb", "hemoglobin"), ("K", "potassium")])
def test_labs(spark, text, want):
    assert one(spark, [text], nz.normalize_lab(F.col("x"))) == [want]


def test_variations(spark):
    got = dict(zip(["history of hypertension", "hypertension, severe", "mi", "myocardial infarction", "chronic pain", "gastritis"], one(spark, ["history of hypertension", "hypertension, severe", "mi", "myocardial infarction", "chronic pain", "gastritis"], nz.variations(F.col("x")))))
    assert "hypertension" in got["history of hypertension"] and "hypertension severe" in got["hypertension, severe"]
    assert {"myocardial infarction", "heart attack"} <= set(got["mi"]) and "mi" in got["myocardial infarction"]
    assert {"pain", "persistent pain", "chronic ache"} <= set(got["chronic pain"]) and "gastr inflammation" in got["gastritis"]


def test_tokens_flags_and_bands(spark):
    assert one(spark, ["The pain, of a naïve heart!"], nz.tokenize(F.col("x"))) == [["pain", "naïve", "heart"]]
    assert one(spark, ["salt intake", "chest pain"], nz.is_lab_term(F.col("x"))) == [True, False]
    assert one(spark, ["SNOMED", "icd10"], nz.system_uri(F.col("x"))) == ["http://snomed.info/sct", "unknown"]
    assert one(spark, ["0.95", "0.6", "0.4", "0.1"], nz.confidence_band(F.col("x").cast("double"))) == ["high", "medium", "low", "very_low"]
    calibrated = one(spark, ["0.95", "0.8", "0.55"], nz.calibrate(F.col("x").cast("double")))
    assert calibrated[0] < 0.95 and calibrated[1] < 0.8 and calibrated[2] < 0.55


def test_ratios():
    assert sim.lcs("kitten", "sitting") == 4
    assert sim.ratio("kitten", "sitting") == pytest.approx(100 * 8 / 13) and sim.ratio("", "") == 100
    assert sim.partial_ratio("bolt", "a hot bolt here") == 100
    assert sim.token_sort_ratio("pain chest", "chest pain") == 100 and sim.token_set_ratio("chest pain", "severe chest pain") == 100
    assert sim.difflib_ratio("abcd", "bcde") == 0.75
    assert sim.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert sim.phonetic_key("Knight") == sim.phonetic_key("nite") and sim.phonetic_key("phone") == sim.phonetic_key("fone")

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
        return row[-1]

    rng = random.Random(0)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert sim.lcs(a, b) == slow(a, b)
