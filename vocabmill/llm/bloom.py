"""Once-seen and twice-seen Bloom filters over shards of 64-bit hashes.

Tasks reduce what they see to packed hashes, which are dealt to shards.  A
shard streams them through its once-seen filter; what is seen again goes to
its twice-seen filter.  Rows are then met with the twice-seen filters: at hand
in each task if together they are at most ``max_bytes``, else in the shard, to
which the rows are dealt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._shared import Scratch

#: Bits a key and probes: about 0.5 % false suspects, which exact confirmation rejects.
BITS_PER_KEY, PROBES = 12, 5


def _positions(h: np.ndarray, m: np.ndarray | int) -> list[np.ndarray]:
    m = np.asarray(m, np.uint64)
    step = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17) | np.uint64(1)
    base = h ^ (h >> np.uint64(29))
    return [(base + np.uint64(i) * step) % m for i in range(PROBES)]


class Bloom:
    """A scalable Bloom filter: when a layer is full, one four times as large is added."""

    def __init__(self, keys: int = 1 << 16) -> None:
        self.layers: list[np.ndarray] = []
        self._grow(keys)

    @classmethod
    def of(cls, layers) -> "Bloom":
        """A filter to look up only."""
        own = cls.__new__(cls)
        own.layers, own.room = [np.frombuffer(x, np.uint8) for x in layers], 0
        return own

    def _grow(self, keys: int) -> None:
        self.layers.append(np.zeros(max(64, keys * BITS_PER_KEY) // 8, np.uint8))
        self.room = keys

    def contains(self, h: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h), bool)
        for bits in self.layers:
            hit = np.ones(len(h), bool)
            for p in _positions(h, len(bits) * 8):
                hit &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            found |= hit
        return found

    def add(self, h: np.ndarray) -> None:
        while len(h):
            if not self.room:
                self._grow(len(self.layers[-1]) * 8 // BITS_PER_KEY * 4)
            part, h = h[: self.room], h[self.room :]
            bits = self.layers[-1]
            for p in _positions(part, len(bits) * 8):
                np.bitwise_or.at(bits, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
            self.room -= len(part)


    def folded(self) -> list[bytes]:
        """The layers, the last halved as often as its keys allow: a key's place in a half is its place modulo the half."""
        last = self.layers[-1]
        used, keys = len(last) * 8 // BITS_PER_KEY - self.room, len(last) * 8 // BITS_PER_KEY
        while 2 * used <= keys and len(last) > 64 and len(last) % 2 == 0:
            last, keys = last[: len(last) // 2] | last[len(last) // 2 :], keys // 2
        return [x.tobytes() for x in (*self.layers[:-1], last)] if used or len(self.layers) > 1 else []


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (h >> np.uint64(11)) % np.uint64(shards)


PACKED = "shard int, once binary, again binary"


def packed_by_shard(parts: list[np.ndarray], shards: int) -> pa.RecordBatch:
    """One row a shard: its hashes that occur once in parts, and those that occur more often."""
    h, n = np.unique(np.concatenate(parts), return_counts=True)
    shard = shard_of(h, shards).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    h, n, shard = h[order], n[order], shard[order]
    used, first = np.unique(shard, return_index=True)
    groups = list(zip(first, [*first[1:], len(h)]))
    once, again = ([h[a:b][(n[a:b] > 1) == more].tobytes() for a, b in groups] for more in (False, True))
    return pa.record_batch([pa.array(used), pa.array(once, pa.binary()), pa.array(again, pa.binary())], ["shard", "once", "again"])


class Twice:
    """A once-seen and a twice-seen filter, fed with hashes in any order."""

    def __init__(self) -> None:
        self.once, self.again = Bloom(), Bloom()

    def feed(self, once: bytes, again: bytes) -> None:
        """Hashes that a task saw once, and those that it saw more often."""
        h, repeats = np.frombuffer(once, np.uint64), np.frombuffer(again, np.uint64)
        known = self.once.contains(h)
        repeats = np.concatenate([h[known], repeats])
        self.again.add(repeats[~self.again.contains(repeats)])
        self.once.add(np.concatenate([h[~known], repeats]))


def _filter_shard(batches):
    """One row: this shard's twice-seen filter, a layer an element."""
    filters = Twice()
    for batch in batches:
        for once, again in zip(batch.column("once").to_pylist(), batch.column("again").to_pylist()):
            filters.feed(once, again)
    yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([filters.again.folded()], pa.list_(pa.binary()))], ["shard", "twice"])


def filters_of(packed: DataFrame, scratch: Scratch, shards: int) -> DataFrame:
    """(shard, twice) from packed hashes."""
    dealt = packed.repartitionById(shards, "shard").select("once", "again")
    return scratch.table(dealt.mapInArrow(_filter_shard, "shard int, twice array<binary>"), "filters")


class Filters:
    """The filters of all shards, to look up hashes of any shard at once.

    The nth layers of all are one array.
    """

    def __init__(self, layers_of: dict[int, list[bytes]], shards: int) -> None:
        self.shards, self.levels = shards, []
        for n in range(max(map(len, layers_of.values()), default=0)):
            own = {s: x[n] for s, x in layers_of.items() if len(x) > n}
            start, size = np.full(shards, -1, np.int64), np.ones(shards, np.uint64)
            lengths = np.array([len(x) for x in own.values()])
            start[list(own)], size[list(own)] = np.cumsum(lengths) - lengths, lengths * 8
            self.levels.append((start, size, np.frombuffer(b"".join(own.values()), np.uint8)))

    def know(self, h: np.ndarray) -> np.ndarray:
        found, shard = np.zeros(len(h), bool), shard_of(h, self.shards).astype(np.int64)
        for start, size, bits in self.levels:
            at = start[shard]
            hit = at >= 0
            for p in _positions(h, size[shard]):
                hit &= (bits[(p >> np.uint64(3)).astype(np.int64) + at] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            found |= hit
        return found


def collected(filtered: DataFrame, shards: int, max_bytes: int):
    """A broadcast of all twice-seen filters, or None if they are larger than max_bytes."""
    total = F.aggregate("twice", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
    if (filtered.agg(F.sum(total)).first()[0] or 0) > max_bytes:
        return None
    return filtered.sparkSession.sparkContext.broadcast(Filters({r.shard: r.twice for r in filtered.toLocalIterator()}, shards))


def _probe(batches):
    """A shard's rows whose hash its filter knows; the filter comes first."""
    own = Bloom.of(())
    for batch in batches:
        for layers in batch.column("twice").drop_null().to_pylist():
            own = Bloom.of(layers)
        rows = batch.filter(batch.column("twice").is_null()).drop_columns(["twice"])
        if rows.num_rows:
            yield rows.filter(pa.array(own.contains(rows.column("h").to_numpy(zero_copy_only=False).view(np.uint64))))


def met_in_shards(rows: DataFrame, filtered: DataFrame, shards: int) -> DataFrame:
    """The rows (shard, h, ...) whose hash the twice-seen filter of their shard knows."""
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "shard"]
    both = filtered.select("shard", "twice", *none).unionByName(rows.withColumn("twice", F.lit(None).cast("array<binary>")))
    dealt = both.repartitionById(shards, "shard").sortWithinPartitions(F.col("twice").isNull())
    return dealt.drop("shard").select(*[c for c in rows.columns if c != "shard"], "twice").mapInArrow(_probe, rows.drop("shard").schema)
