"""Line dedup with two Bloom filters and exact confirmation of suspects.

1. Each task reduces its lines to 128-bit digests, and deals their first
   halves, once a task, and whole digests with the doc_id to shards.
2. A shard streams the halves through a once-seen filter; what is seen again
   goes to a twice-seen filter.  Then its digests pass the twice-seen filter,
   and only those that it knows move on.  Neither filter leaves its shard.
3. For each suspect the distinct documents are counted exactly, and the one
   that keeps the line is chosen.
4. Each document gets the digests it loses and is rewritten.

Lines are held equal if their 128-bit digests are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._shared import Scratch, slices, texts_as_bytes
from .bloom import Bloom, Twice, packed_by_shard, shard_of  # noqa: F401

MIN_CHARS, MIN_DOCS = 20, 3
#: A task packs its digests when it holds so many.
PACK = 1_000_000


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space, A-Z lower-cased."""
    return line.strip().lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    n = len(key)
    return n >= min_chars and (n >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def _digests(text: bytes, min_chars: int) -> list[bytes]:
    """A 128-bit digest for each line; empty for lines that are too short."""
    keys = map(line_key, text.split(b"\n"))
    return [xxhash.xxh3_128_digest(k) if long_enough(k, min_chars) else b"" for k in keys]


_PACKED = "shard int, kind int, once binary, again binary, ids binary, none binary"


def _packed_lines(min_chars: int, shards: int):
    """Of each shard a row (kind 0) of this task's hashes, and one (kind 1) of digests with the doc_id, each document's once."""

    def pack(digests, ids, none):
        both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        seen = packed_by_shard([both[:, 0]], shards)
        n = seen.num_rows
        yield pa.record_batch([seen.column(0), pa.array([0] * n, pa.int32()), seen.column(1), seen.column(2), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)
        shard = shard_of(both[:, 0], shards).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        used, first = np.unique(shard[order], return_index=True)
        groups = [order[a:b] for a, b in zip(first, [*first[1:], len(order)])]
        columns = [[x[g].tobytes() for g in groups] for x in (both[:, 0], both[:, 1], np.repeat(*ids), np.repeat(*none))]
        yield pa.record_batch([pa.array(used), pa.array([1] * len(used), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names)

    names = ["shard", "kind", "once", "again", "ids", "none"]

    def run(batches):
        digests, ids, counts, count = [], [], [], 0

        def flush():
            none = np.array([x is None for x in ids], np.uint8)
            yield from pack(digests, (np.array([x or 0 for x in ids], np.int64), counts), (none, counts))
            digests.clear(), ids.clear(), counts.clear()

        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts_as_bytes(part)):
                    own = {d for d in _digests(text, min_chars) if d}
                    if own:
                        digests.extend(own)
                        ids.append(doc_id)
                        counts.append(len(own))
                        count += len(own)
                if count > PACK:
                    yield from flush()
                    count = 0
        if digests:
            yield from flush()

    return run


def _suspects(batches):
    """(did, has, digest) of a shard's rows that its twice-seen filter knows; hashes come before digests."""
    filters = Twice()
    for batch in batches:
        for kind, once, again, ids, none in zip(*(c.to_pylist() for c in batch.columns)):
            if not kind:
                filters.feed(once, again)
                continue
            h = np.frombuffer(once, np.uint64)
            keep = filters.again.contains(h)
            both = np.stack([h, np.frombuffer(again, np.uint64)], axis=1)[keep]
            digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(both), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())
            yield pa.record_batch([pa.array(np.frombuffer(ids, np.int64)[keep]), pa.array(np.frombuffer(none, np.uint8)[keep] == 0), digest], ["did", "has", "digest"])


def _rewrite(min_chars: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                lines_of, dropped, kept = [], [], []
                for text, gone in zip(texts_as_bytes(part), part.column("gone").to_pylist()):
                    lines = text.split(b"\n")
                    lines_of.append(len(lines))
                    if gone:
                        gone = set(gone)
                        lines = [x for x, d in zip(lines, _digests(text, min_chars)) if d not in gone]
                    dropped.append(lines_of[-1] - len(lines))
                    kept.append(b"\n".join(lines))
                yield pa.record_batch([part.column("doc_id"), pa.array(lines_of, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of each row of docs, repeated lines gone.

    A line's key is the line without ASCII white space at its ends, A-Z
    lower-cased.  A key of at least min_chars code points found in at least
    min_docs documents loses all its lines but those in the largest doc_id
    holding it.  A null text is one empty line, as is an empty one.  Rows with
    equal doc_ids count as one document; null doc_ids together are one more,
    below all others.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    own = docs.select("doc_id", "text")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = own.mapInArrow(_packed_lines(min_chars, shards), _PACKED).repartitionById(shards, "shard").sortWithinPartitions("kind")
    suspects = scratch.table(packed.drop("shard").mapInArrow(_suspects, "did long, has boolean, digest binary"), "suspects")
    document = F.struct("has", "did")
    confirmed = suspects.groupBy("digest").agg(F.countDistinct("has", "did").alias("n"), F.max(document).alias("keeper")).where(F.col("n") >= min_docs)
    confirmed = scratch.table(confirmed.select("digest", "keeper"), "confirmed")  # a join of two tables, so a hot digest can be split
    gone = suspects.join(confirmed, "digest").where(document < F.col("keeper")).groupBy("has", "did").agg(F.collect_set("digest").alias("gone"))
    gone = scratch.table(gone.select(F.when(F.col("has"), F.col("did")).alias("__id"), "gone"), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    return own.join(gone, same, "left").select("doc_id", "text", "gone").mapInArrow(_rewrite(min_chars), "doc_id long, n_lines long, n_dropped long, text string")
