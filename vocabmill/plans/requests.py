"""Requests as rows: each names its vocabularies, and terms come from tables or from free text (LKP27, VAL08, VAL09, EXT01).

Requests repeat terms; each distinct term is mapped once in each vocabulary that
is asked for it, and the answers are joined back.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed_values import SYSTEM_URIS
from ..functions.staging import staged
from ..operators import extract
from .cascade import map_terms

ANSWER = ("found", "code", "display", "confidence", "match_type", "via")


def system_name(system: Column) -> Column:
    """A vocabulary's short name, from the name or its URI, in any case; others stay as they are, lower-cased."""
    low, out = F.lower(F.trim(system)), F.lower(F.trim(system))
    for name, uri in SYSTEM_URIS.items():
        out = F.when(low == uri.lower(), name).otherwise(out)
    return out


def _answers(asked: DataFrame, concepts: dict[str, DataFrame], **options) -> DataFrame:
    """(system, term, *ANSWER) of the distinct (system, term) rows of asked; each vocabulary's cascade sees its own terms only."""
    distinct = staged(asked.select("system", "term").distinct())

    def one(system: str) -> DataFrame:
        terms = distinct.where(F.col("system") == system).select(F.col("term").alias("term_id"), "term")
        return map_terms(terms, {system: concepts[system]}, **options).select("system", F.col("term_id").alias("term"), *ANSWER)

    with ThreadPoolExecutor(max(1, len(concepts))) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, concepts))


def routed(requests: DataFrame, concepts: dict[str, DataFrame], **options) -> DataFrame:
    """LKP27: (term_id, system, *ANSWER, error, attempted): an answer for each request and vocabulary.

    requests: (term_id, term, system[, threshold]).  system is a vocabulary's
    name or URI, ``all`` or null for every vocabulary.  A mapping below the
    request's threshold is not given.  Blank terms and vocabularies that aren't
    there give a row with an error (VAL08, VAL09).  attempted lists what was
    tried for terms that aren't found.  options: as of map_terms.
    """
    known = list(concepts)
    name = F.coalesce(system_name(F.col("system")), F.lit("all"))
    least = F.coalesce(F.col("threshold").cast("double"), F.lit(0.0)) if "threshold" in requests.columns else F.lit(0.0)
    each = F.explode(F.when(name == "all", F.array(*map(F.lit, known))).otherwise(F.array(name)))
    rows = requests.select("term_id", "term", F.col("system").alias("asked"), least.alias("least"), each.alias("system")).withColumn("blank", F.coalesce(F.trim("term"), F.lit("")) == "")
    error = F.when(F.col("blank"), "Empty term").when(~F.col("system").isin(*known), F.concat(F.lit("Unsupported system: "), "asked"))
    rows = staged(rows.withColumn("error", error))
    fit = rows.where("error IS NULL")
    joined = fit.join(_answers(fit, concepts, **options), ["system", "term"], "left")
    given = F.coalesce("found", F.lit(False)) & (F.col("confidence") >= F.col("least"))
    methods = ["exact"] + ["fuzzy"] * bool(options.get("include_fuzzy", True)) + ["provider"] * bool(options.get("providers"))
    shown = [F.when(given, F.col(c)).alias(c) for c in ANSWER[1:]]
    answered = joined.select("term_id", "system", given.alias("found"), *shown, "error", F.when(~given, F.array(*map(F.lit, methods))).alias("attempted"))
    wrong = rows.where("error IS NOT NULL").select("term_id", "system", F.lit(False).alias("found"), *[F.lit(None).cast(answered.schema[c].dataType).alias(c) for c in ANSWER[1:]], "error", F.lit(None).cast("array<string>").alias("attempted"))
    return answered.unionByName(wrong)


def extracted_and_mapped(docs: DataFrame, concepts: dict[str, DataFrame], id_col: str = "doc_id", threshold: float = 0.0, **options) -> DataFrame:
    """EXT01: (id, term, start, end, entity_confidence, system, *ANSWER): the terms in each text, mapped in each vocabulary.

    docs: (id, text).  A spelling counts once in a text.  Terms without a
    mapping of at least the threshold stay, not found.
    """
    spans = staged(extract.extracted_terms(docs, id_col).withColumnRenamed("confidence", "entity_confidence"))
    systems = F.array(*map(F.lit, concepts))
    each = spans.withColumn("system", F.explode(systems))
    joined = each.join(_answers(each, concepts, **options), ["system", "term"], "left")
    given = F.coalesce("found", F.lit(False)) & (F.col("confidence") >= threshold)
    return joined.select(id_col, "term", "start", "end", "entity_confidence", "system", given.alias("found"), *[F.when(given, F.col(c)).alias(c) for c in ANSWER[1:]])
