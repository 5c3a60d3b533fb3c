"""User rules over terms (RUL01-RUL06, VAL03, ENH04).

rules: (rule_id, rule_type, priority, source_term, target_code, target_system,
target_display, conditions, created_at, is_active), conditions being a map of
strings with the keys pattern, domain, min_confidence and required:NAME.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

RULE_TYPES = ("exact", "pattern", "context", "domain", "override")
CONFIDENCES = {"exact": 1.0, "pattern": 0.8, "context": 0.9, "domain": 0.85, "override": 1.0}
CRITICAL = 1
#: Up to so many pattern rules are broadcast; more meet the terms as a Cartesian product.
MAX_BROADCAST_RULES = 10_000
#: A key of more than BLOCK rules meets its terms in blocks of so many rules by slices of about SLICE terms.
BLOCK, SLICE = 1_000, 10_000


def _meet(terms: DataFrame, rules: DataFrame, on: list[str]) -> DataFrame:
    """The pairs of terms and rules with equal keys.

    The pairs of a key grow with the product of its terms and rules, while its
    rows may be too few for Spark to share them out; so keys of many rules are
    cut on both sides, and each block of rules and slice of terms is on its own.
    """
    counted = rules.groupBy(*on).agg(F.count("*").alias("n_rules")).where(F.col("n_rules") > BLOCK).dropna(subset=on)
    if counted.isEmpty():
        return terms.join(rules, on)
    asked = terms.join(F.broadcast(counted), on).groupBy(*on, "n_rules").agg(F.count("*").alias("n_terms"))
    cuts = F.broadcast(asked.select(*on, F.ceil(F.col("n_rules") / BLOCK).alias("blocks"), F.ceil(F.col("n_terms") / SLICE).alias("slices")))
    parts = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = lambda by, n: F.pmod(F.xxhash64(F.lit("cut"), by), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = terms.join(cuts, on).select(*terms.columns, own("term_id", "slices").alias("slice"), every("blocks").alias("block"))
    right = rules.join(cuts, on).select(*rules.columns, own("rule_id", "blocks").alias("block"), every("slices").alias("slice"))
    cut = [*on, "block", "slice"]
    # a given number of partitions is not put together again, however few bytes they have
    many = left.repartition(parts, *cut).join(right.repartition(parts, *cut), cut).drop("block", "slice")
    few = terms.join(rules.join(F.broadcast(counted.select(*on)), on, "left_anti"), on)
    return few.unionByName(many)


def matches(terms: DataFrame, rules: DataFrame) -> DataFrame:
    """RUL01: (term_id, rule_id, confidence) of every active rule that fits.

    terms: (term_id, term, context), context being a map of strings.  Exact and
    override rules meet terms by the term, domain rules by the context's domain
    and context rules by their first requirement, all by equi-join.  Pattern
    rules, and context rules that only require absence, have no key: each meets
    each term.  Context and domain rules ignore the term.
    """
    active = rules.where("is_active")
    need = F.coalesce(F.col("conditions")["min_confidence"].cast("double"), F.lit(0.0))
    rated = active.withColumn("confidence", F.create_map(*[x for k, v in CONFIDENCES.items() for x in (F.lit(k), F.lit(v))])[F.col("rule_type")]).where(F.col("confidence") >= need)
    asked = terms.select("term_id", "term", "context")
    keyed = rated.where("rule_type IN ('exact', 'override')").select("rule_id", "confidence", F.lower("source_term").alias("k"))
    by_key = _meet(asked.select("term_id", F.lower("term").alias("k")), keyed, ["k"]).select("term_id", "rule_id", "confidence")
    ctx = F.coalesce("context", F.create_map().cast("map<string,string>"))
    domains = rated.where("rule_type = 'domain'").select("rule_id", "confidence", F.col("conditions")["domain"].alias("k"))
    by_domain = _meet(asked.select("term_id", ctx["domain"].alias("k")), domains, ["k"]).select("term_id", "rule_id", "confidence")
    named = F.map_filter("conditions", lambda k, v: F.startswith(k, F.lit("required:")))
    rest = rated.where("rule_type IN ('pattern', 'context')").withColumn("required", F.transform_keys(named, lambda k, v: F.substr(k, F.lit(10))))
    rest = rest.withColumn("first", F.get(F.array_sort(F.filter(F.map_entries("required"), lambda e: e.value.isNotNull())), F.lit(0)))
    rest = rest.withColumn("pattern", F.concat(F.lit("(?i)"), F.coalesce(F.col("conditions")["pattern"], F.col("source_term")))).select("rule_id", "rule_type", "confidence", "pattern", "required", "first")
    keyed_context = (F.col("rule_type") == "context") & F.col("first").isNotNull()
    has_required = (F.size("required") > 0) & F.forall(F.map_entries("required"), lambda e: ctx[e.key].eqNullSafe(e.value))
    entries = asked.select("term_id", "context", F.explode("context").alias("k", "v"))
    contexts = rest.where(keyed_context).select("rule_id", "confidence", "required", F.col("first.key").alias("k"), F.col("first.value").alias("v"))
    by_context = _meet(entries, contexts, ["k", "v"]).where(has_required).select("term_id", "rule_id", "confidence")
    scanned = rest.where(~keyed_context)
    if scanned.limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES:
        scanned = F.broadcast(scanned)
    fits = ((F.col("rule_type") == "pattern") & F.regexp_like("term", F.col("pattern"))) | ((F.col("rule_type") == "context") & has_required)
    by_scan = asked.join(scanned, fits).select("term_id", "rule_id", "confidence")
    return by_key.unionByName(by_domain).unionByName(by_context).unionByName(by_scan)


def ranked(found: DataFrame, rules: DataFrame) -> DataFrame:
    """RUL02: matches with their rank by priority, then confidence, age and rule_id."""
    order = Window.partitionBy("term_id").orderBy("priority", F.desc("confidence"), "created_at", "rule_id")
    named = rules.select("rule_id", "rule_type", "priority", "target_code", "target_system", "target_display", "created_at")
    return found.join(named, "rule_id").withColumn("rank", F.row_number().over(order))


def apply(base: DataFrame, order: DataFrame) -> DataFrame:
    """RUL03: base (term_id, mappings) with the best rule's mapping put first, or alone.

    Override and critical rules replace the list.
    """
    target = F.struct(F.col("target_code").alias("code"), F.col("target_system").alias("system"), F.col("target_display").alias("display"), "confidence", F.concat(F.lit("rule_"), "rule_type").alias("match_type"))
    top = order.where("rank = 1").select("term_id", target.alias("r"), ((F.col("rule_type") == "override") | (F.col("priority") == CRITICAL)).alias("alone"))
    joined = base.join(top, "term_id", "left")
    return joined.select("term_id", F.when(F.col("r").isNull(), F.col("mappings")).when(F.col("alone"), F.array("r")).otherwise(F.concat(F.array("r"), "mappings")).alias("mappings"))


def latest(log: DataFrame) -> DataFrame:
    """RUL04: rules from a log of versions (rule_id, ..., updated_at): the last of each."""
    rest = [c for c in log.columns if c != "rule_id"]
    return log.groupBy("rule_id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", *[c for c in ("priority", "source_term") if c in rest])).alias("m")).select("rule_id", "m.*")


def added(log: DataFrame, rules: DataFrame, at: Column) -> DataFrame:
    """RUL04: the log with new rules, active and created at ``at``."""
    new = rules.withColumns({"created_at": at, "updated_at": at, "is_active": F.lit(True)})
    return log.unionByName(new.select(log.columns))


def changed(log: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """RUL04: the log with a version for each changed rule: its last one, with the changes' values that aren't null.

    changes: rule_id and any of the log's columns.  Unknown rule_ids change nothing.
    """
    new = changes.select("rule_id", *[F.col(c).alias(f"__{c}") for c in changes.columns if c != "rule_id"])
    both = latest(log).join(new, "rule_id")
    kept = [F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in changes.columns and c != "rule_id" else F.col(c) for c in log.columns]
    return log.unionByName(both.select(kept).withColumn("updated_at", at))


def removed(log: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """RUL04: the log with an inactive version of each of the rules; nothing is erased."""
    return changed(log, ids.select("rule_id", F.lit(False).alias("is_active")), at)


def all_rules(rules: DataFrame, include_inactive: bool = False) -> DataFrame:
    """RUL05."""
    return (rules if include_inactive else rules.where("is_active")).orderBy("priority", "created_at", "rule_id")


def _compiles(patterns: pa.Array) -> pa.Array:
    def ok(p):
        try:
            return p is not None and bool(re.compile(p))
        except re.error:
            return False

    return pa.array([ok(p) for p in patterns.to_pylist()], pa.bool_())


def errors(rules: DataFrame) -> Column:
    """VAL03: what is wrong with a rule, in a fixed order; empty if nothing."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    compiles = F.arrow_udf(_compiles, "boolean")
    need = lambda kind, bad, text: F.when((F.col("rule_type") == kind) & bad, F.lit(text))
    found = F.array(
        *[F.when(blank(c), F.lit(f"missing {c}")) for c in ("rule_id", "source_term", "target_code", "target_system", "target_display")],
        need("pattern", ~compiles(F.coalesce(F.col("conditions")["pattern"], F.col("source_term"))), "pattern doesn't compile"),
        need("context", F.size(F.filter(F.map_keys("conditions"), lambda k: F.startswith(k, F.lit("required:")))) <= 0, "no required context"),
        need("domain", F.col("conditions")["domain"].isNull(), "no domain"),
    )
    return F.filter(found, lambda e: e.isNotNull())


def validated(expected: DataFrame, mappings: DataFrame) -> DataFrame:
    """ENH04: expectations (term_id, code, system) with exact_match and the best mapping's code.

    mappings: (term_id, system, code, confidence).  The best is the expected
    one if it is there, else that of most confidence.
    """
    rows = expected.join(mappings.select("term_id", F.col("system").alias("s"), F.col("code").alias("c"), "confidence"), "term_id", "left")
    hit = F.coalesce((F.col("c") == F.col("code")) & (F.col("s") == F.col("system")), F.lit(False))
    return rows.groupBy("term_id", "code", "system").agg(F.bool_or(hit).alias("exact_match"), F.max_by("c", F.struct(hit.alias("hit"), "confidence", "c")).alias("best_code"))
