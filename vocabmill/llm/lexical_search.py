"""Ranked lexical search: term-bucketed postings, integer scores, top k.

Terms are the maximal runs of characters outside ``[\\x00-\\x2F\\x3A-\\x40
\\x5B-\\x60\\x7B-\\x7F]`` with A-Z lower-cased.  With N documents that hold a
term, L terms in all, n terms in a document, df documents that hold a term and
tf its occurrences in one,

    w = floor(1000 ln((2N + 2) / (2 df + 1)))
    m = 100 - b + (b n N) div L
    score = sum of w ((10^9 tf) div (1000 tf + 12 m)) over an item's terms,

b being the percentage of length normalisation, 25 by default; all but w is
64-bit integer.

Postings of the items' terms are dealt to buckets of terms, a hot bucket over
several tasks, and written bucket by bucket; document frequencies and scores
come from there.  A match is scored once, not once for each item: scored
matches move to their document and meet the items there, so the sum over an
item's terms needs no further shuffle, and only k documents of each task and
item go on to the ranking.  Items are taken in blocks small enough to send to
all tasks.

Defined results: null, empty and termless texts match nothing.  Rows that
repeat a doc_id are documents of their own and rank in any order among equals.
Rows that repeat an item_id are one item; a null item_id is an item.  Documents
with a null doc_id come last among equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._shared import Scratch, slices

BUCKETS = 16
#: Bytes of items' terms sent to all tasks at once.
BLOCK_BYTES = 32 << 20
#: Bytes of an item's term in a broadcast table, besides its characters.
ENTRY_BYTES = 64
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """The text's terms, with repeats; null has none."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(F.coalesce(lower, F.lit("")), F.lit(TERM_PATTERN), F.lit(0))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times): how often an item holds a term."""
    return items.select("item_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _postings(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """For each row with terms its number of terms, as a row without a term, and its terms with their occurrences."""
    for batch in batches:
        for part in slices(batch):
            found, counts, lengths, which = [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                if not text:
                    continue
                own = Counter(_TERM.findall(text.translate(_LOWER) if not text.isascii() else text.lower()))
                if own:
                    found.append(None)
                    found.extend(own)
                    n = own.total()
                    counts.append(0)
                    counts.extend(own.values())
                    lengths.extend([n] * (len(own) + 1))
                    which.extend([i] * (len(own) + 1))
            if found:
                rows = pa.array(which, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), part.column("doc_id").take(rows).cast(kind), part.column("row").take(rows), pa.array(counts, pa.int64()), pa.array(lengths, pa.int64())], ["term", "doc_id", "row", "tf", "n"])


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, row, tf, n) of each row and term, and one row without a term for each row that has terms."""
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _postings(batches, arrow), f"term string, doc_id {kind.simpleString()}, row bigint, tf bigint, n bigint")


def bucket(term: Column) -> Column:
    return F.pmod(F.hash(term), F.lit(BUCKETS))


class Index:
    """Postings of the terms of some items over all documents, in buckets of terms.

    ``postings`` (bucket, term, doc_id, row, tf, n), ``terms`` (term, df) and
    the corpus' ``n_docs`` and ``n_terms``, which count every term of every
    document.
    """

    def __init__(self, docs: DataFrame, items: DataFrame) -> None:
        self.scratch = Scratch(docs.sparkSession, "search")
        wanted = items.select("term").distinct().where("term IS NOT NULL")
        found = postings(docs)
        # rows without a term carry the documents' lengths through the same pass
        kept = found.join(wanted.withColumn("wanted", F.lit(True)), "term", "left").where("wanted OR term IS NULL").drop("wanted")
        dealt = kept.withColumn("bucket", F.when(F.col("term").isNotNull(), bucket(F.col("term"))).otherwise(-1)).hint("rebalance", "bucket")
        path = self.scratch.path("postings")
        dealt.sortWithinPartitions("bucket", "term", "row").write.partitionBy("bucket").parquet(path)
        written = docs.sparkSession.read.schema(dealt.schema).parquet(path)
        sums = written.where("bucket = -1").agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        self.n_docs, self.n_terms = sums.n, sums.l or 0
        self.postings = written.where("bucket >= 0")
        self.terms = self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def scored(self, length_percent: int = 25) -> DataFrame:
        """(term, doc_id, row, points): the score of each match, once for all items."""
        weight = F.floor(1000 * F.log((2.0 * self.n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
        norm = f"{100 - length_percent} + (({length_percent}L * n * {self.n_docs}L) div {max(self.n_terms, 1)}L)"
        points = F.col("weight") * F.expr(f"(1000000000L * tf) div (1000L * tf + 12L * ({norm}))")
        weights = self.terms.select("term", weight.alias("weight")).where("weight > 0")
        return self.postings.join(weights, "term").select("term", "doc_id", "row", points.alias("points")).where("points > 0")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES, length_percent: int = 25) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents, all if fewer; scores are above 0."""
    asked = item_terms(items)
    index = Index(docs, asked)
    asked = index.scratch.table(asked, "items")
    size = asked.agg(F.sum(F.octet_length("term") + ENTRY_BYTES).alias("b")).first().b or 0
    blocks = -(-size // block_bytes) or 1
    by_document = index.scored(length_percent).repartition("doc_id")
    if blocks > 1:
        by_document = index.scratch.table(by_document, "scored")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    found = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.hash("item_id"), F.lit(blocks)) == block) if blocks > 1 else asked
        matched = (by_document.repartition("doc_id") if blocks > 1 else by_document).join(F.broadcast(own), "term")
        sums = matched.groupBy("doc_id", "row", "item_id").agg(F.sum(F.col("points") * F.col("times")).alias("score"))
        ranked = sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        found.append(ranked if blocks == 1 else index.scratch.table(ranked, f"ranked{block}"))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out
