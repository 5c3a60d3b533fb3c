"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight.  In the
order of keys within the source, documents are taken until the source's budget
of words is full.  Budgets above the source's size first take whole epochs.

The order is never sorted as a whole.  It has levels: the key's quantile
bucket, a bucket within that bucket, the key itself, and the row's place in a
written table, which parts equal rows.  Sizes are summed by source and bucket
of a level, prefix sums tell in which bucket a budget ends, and only that
bucket goes on to the next level.  What is found is one row a source, the last
that may be taken; every row then decides by itself.  Texts take no part in
this: the decision is made on rows of a few numbers, and ``copies`` meets the
texts once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import Scratch

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MAX_EPOCHS = 1.5, 2.0
BUCKETS = 4096
DRAWS = 1 << 48
_PLACE = ("b1", "b2", "tie", "part", "rid")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column) -> Column:
    """A 48-bit number from the MD5 of a row's doc_id and text, so rows that share an id draw apart."""
    own = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(own), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn.  The level L
    at which sum(min(max_epochs * size, L * weight)) is share * all sizes is
    what resharing the excess again and again comes to; it is found by sorting
    sources by the level at which each is full.  One row a source is sorted
    here, never a row a document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    own = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_epochs)
    everything = Window.partitionBy()
    full = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(full), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * share - before("cap")) / (F.sum("w").over(everything) - before("w"))
    own = own.withColumn("level", level).withColumn("open", F.col("cap") / F.col("w") >= F.col("level"))
    first = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("w")).alias("at"), "level"))).over(everything)["level"]
    return own.withColumn("target", F.least("cap", F.coalesce(first * F.col("w"), F.col("cap")))).select("source", "source_size", "target")


def _same_source(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    return a.join(b.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), how).drop("__s")


def _narrowed(rows: DataFrame, by: str) -> DataFrame:
    """Of each source's rows (source, size, before, rest, ...), those of the one value of ``by`` in which the budget ends.

    before: the words in front of that value.  Sources whose rows all fit have none.
    """
    sums = rows.groupBy("source", by).agg(F.sum("size").alias("s"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("before") + F.coalesce(F.sum("s").over(order), F.lit(0))
    over = sums.withColumn("upto", upto).where(F.col("upto") + F.col("s") > F.col("rest"))
    ends = over.groupBy("source").agg(F.min(F.struct(F.col(by).alias("at"), "upto")).alias("e")).select("source", F.col("e.at").alias("__at"), F.col("e.upto").alias("__upto"))
    return _same_source(rows, ends).where(F.col(by) == F.col("__at")).withColumn("before", F.col("__upto")).drop("__at", "__upto")


def _decided(docs: DataFrame, quality: DataFrame | None, weights: tuple[float, ...], share: float, max_epochs: float, scratch: Scratch) -> DataFrame:
    """(doc_id, source, size, draw, source_size, target, epochs, more) of each row of docs; more: whether the rest of the budget holds it."""
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text")).alias("draw"))
    if quality is None:
        weighed = slim.withColumn("weight", F.lit(1.0))
    else:
        known = scratch.table(quality.select(F.col("doc_id").alias("__id"), "weight"), "weights")
        salted = slim.withColumn("__salt", F.when(F.col("doc_id").isNull(), F.col("draw") % 4096).otherwise(0))  # null ids match nothing, so deal them out
        weighed = salted.join(known.withColumn("__none", F.lit(0).cast("long")), (F.col("doc_id") == F.col("__id")) & (F.col("__salt") == F.col("__none")), "left")
    key = -F.log((F.col("draw") + 0.5) / float(DRAWS)) / F.coalesce("weight", F.lit(1.0))
    rows = scratch.table(weighed.select("doc_id", "source", "size", "draw", key.alias("key"), F.monotonically_increasing_id().alias("rid")), "rows")
    at = (1 - F.exp(-F.col("key"))) * BUCKETS
    rows = rows.withColumn("b1", F.least(F.floor(at), F.lit(BUCKETS - 1)).cast("long"))
    place = {
        "b2": F.floor((at - F.col("b1")) * BUCKETS).cast("long"),
        "tie": F.struct("key", F.col("doc_id").isNotNull().alias("has"), F.coalesce("doc_id", F.lit(0)).alias("id"), "draw"),
        "part": F.shiftright("rid", 33),
    }
    rows = rows.withColumns(place)
    by_bucket = scratch.table(rows.groupBy("source", "b1").agg(F.sum("size").alias("size")), "buckets")
    plan = targets(by_bucket.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = scratch.table(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "plan")
    budget = plan.select("source", F.lit(0).cast("long").alias("before"), "rest")
    ends = _narrowed(_same_source(by_bucket, budget), "b1").select("source", F.col("b1").alias("__b1"), "before", "rest")
    left = _same_source(rows, ends).where(F.col("b1") == F.col("__b1")).select("source", "size", *_PLACE, "before", "rest")
    left = scratch.table(left, "ends1")
    for n, by in enumerate(_PLACE[1:], 2):
        left = scratch.table(_narrowed(left, by), f"ends{n}")
    last = left.select("source", F.struct(*_PLACE).alias("end"), (F.col("before") + F.col("size") / 2 <= F.col("rest")).alias("fits"))
    bounds = scratch.table(_same_source(plan, last, "left"), "bounds")  # one row a source
    own = F.struct(*_PLACE)
    more = F.col("end").isNull() | (own < F.col("end")) | ((own == F.col("end")) & F.col("fits"))
    return _same_source(rows, bounds).select("doc_id", "source", "size", "draw", "source_size", "target", "epochs", more.alias("more"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each row of docs; taken: words, repeats counted.

    quality: (doc_id, weight), weight > 0 and one row a doc_id; others weigh 1.
    A document has floor(target / source_size) whole epochs; those first by key
    fill the rest of the budget.  The document in which it ends is taken if at
    least half of it fits.  Null texts have size 0 and are taken as nothing.
    Rows that repeat a doc_id draw apart unless their texts are equal too; of
    such equal rows any may be taken, in the right number.  Null is a source of
    its own.  Other columns are ignored, whatever their names.
    """
    found = _decided(docs, quality, weights, share, max_epochs, Scratch(docs.sparkSession, "mixing"))
    taken = F.col("size") * (F.col("epochs") + F.col("more").cast("long"))
    return found.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def copies(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """The rows of docs, all columns as they are, each as often as ``mix`` takes it.

    Documents without words stay once.  If the mix takes only some of several
    rows with the same doc_id and text, each gets its last copy with that
    share as probability, seeded.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    found = _decided(docs, quality, weights, share, max_epochs, scratch)
    times = F.when(F.col("size") > 0, F.col("epochs") + F.col("more").cast("long")).otherwise(1)
    wanted = found.groupBy("doc_id", "draw").agg(F.avg(times).alias("times"), F.max(times).alias("most")).where("most > 0")
    wanted = scratch.table(wanted.select(F.col("doc_id").alias("__id"), F.col("draw").alias("__draw"), "times"), "times")
    rows = docs.select(F.struct(*docs.columns).alias("d"), draw(F.col("doc_id"), F.col("text")).alias("draw"), F.rand(7).alias("chance"))
    met = rows.join(wanted, (F.col("draw") == F.col("__draw")) & F.col("d.doc_id").eqNullSafe(F.col("__id")))
    whole = F.floor("times")
    n = (whole + (F.col("chance") < F.col("times") - whole).cast("long")).cast("int")
    return met.where(n > 0).select("d", F.explode(F.sequence(F.lit(1), n))).select("d.*")
