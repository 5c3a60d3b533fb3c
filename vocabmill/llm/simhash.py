"""SimHash near-dedup by a segment-popcount embedding.

Equal fingerprints are one node.  A fingerprint's four 16-bit segments have a
bit count each.  Those four numbers embed it: the Manhattan distance of two
embeddings is at most the Hamming distance of the fingerprints.  A grid of
side 2 over the embedding is range-joined: fingerprints are packed into chunks
by cell, each chunk visits the cells within the allowed Manhattan distance,
and pairs of chunks are verified by XOR and bit count.

A pair of chunks yields a spanning forest of its links, not the links: at most
one row for each fingerprint of the pair, whatever the size of a group of
near copies.  Components follow from the forests.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ._shared import Scratch, arrow_rows, slices, texts_as_bytes
from .components import Labels, components

SHINGLE, RADIUS, SEED = 4, 4, 42
SEGMENTS, SIDE = 4, 2
CHUNK = 8192
#: One task packs about so many chunks of a cell.
PACK_CHUNKS = 64
_CELLS = 64 // SEGMENTS // SIDE + 1


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, repeats included, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    k = min(shingle, len(words))
    hash_of = xxhash.xxh64_intdigest
    set_bits, n = np.zeros(64, np.int64), len(words) - k + 1
    for a in range(0, n, 1 << 16):
        b = min(n, a + (1 << 16))
        h = np.array([hash_of(flat[s:e], SEED) for s, e in zip(starts[a:b], ends[a + k - 1 : b + k - 1].tolist())], np.uint64)
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = np.array([fingerprint(x, shingle) for x in texts_as_bytes(part)], np.uint64)
                yield pa.record_batch([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def _segment_counts(fp: Column) -> list[Column]:
    width = 64 // SEGMENTS
    return [F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1))) for i in range(SEGMENTS)]


def _cell(counts: list[Column]) -> Column:
    return sum((F.floor(c / SIDE).cast("int") * _CELLS**i for i, c in enumerate(counts)), F.lit(0))


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Steps to cells that hold points within the radius; one of each opposite pair."""
    reach = (radius + SIDE - 1) // SIDE
    gap = lambda d: max(0, (abs(d) - 1) * SIDE + 1)  # noqa: E731  least distance along one axis
    steps = itertools.product(range(-reach, reach + 1), repeat=SEGMENTS)
    return [s for s in steps if s >= (0,) * SEGMENTS and sum(gap(d) for d in s if d) <= radius]


def _pack(batches):
    """(cell, chunk, fps) from rows sorted by cell."""
    task, made = TaskContext.get().partitionId(), 0
    cell, held, size = None, [], 0

    def row():
        nonlocal made, held, size
        out = pa.record_batch([pa.array([cell], pa.int32()), pa.array([task << 32 | made], pa.int64()), pa.array([np.concatenate(held).tobytes()], pa.binary())], ["cell", "chunk", "fps"])
        made, held, size = made + 1, [], 0
        return out

    for batch in batches:
        cells, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cuts = np.flatnonzero(np.diff(cells)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(cells)]):
            if a < b:
                if held and cells[a] != cell:
                    yield row()
                cell = cells[a]
                while a < b:
                    part = fps[a : min(b, a + CHUNK - size)]
                    held.append(part)
                    a, size = a + len(part), size + len(part)
                    if size == CHUNK:
                        yield row()
    if held:
        yield row()


def _visits(offsets: list[tuple[int, ...]]):
    def run(batches):
        """A chunk, once for each cell that it visits."""
        for batch in batches:
            for cell, chunk, fps in zip(*(c.to_pylist() for c in batch.columns)):
                at = [cell // _CELLS**i % _CELLS for i in range(SEGMENTS)]
                to = [[x + d for x, d in zip(at, s)] for s in offsets]
                to = [sum(x * _CELLS**i for i, x in enumerate(t)) for t in to if all(0 <= x < _CELLS for x in t)]
                yield pa.record_batch([pa.array(to, pa.int32()), pa.array([cell] * len(to), pa.int32()), pa.array([chunk] * len(to), pa.int64()), pa.array([fps] * len(to), pa.binary())], ["to", "home", "visitor", "visiting"])

    return run


def _forests(radius: int):
    def run(batches):
        """(u, v): spanning forests of the links within each pair of chunks."""
        for batch in batches:
            for visiting, fps in zip(batch.column("visiting").to_pylist(), batch.column("fps").to_pylist()):
                a, b = np.frombuffer(visiting, np.uint64), np.frombuffer(fps, np.uint64)
                labels = Labels(len(a) + len(b))
                for start in range(0, len(a), 128):
                    i, j = np.nonzero(np.bitwise_count(a[start : start + 128, None] ^ b[None, :]) <= radius)
                    if len(i):
                        labels.link(i + start, j + len(a))
                both = np.concatenate([a, b]).view(np.int64)
                u, v = (both[x] for x in labels.forest())
                keep = u != v
                if keep.any():
                    yield pa.record_batch([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs.

    fp: the 64-bit SimHash as a signed long.  component_id: the smallest doc_id
    that links of at most ``radius`` differing bits reach, the row's own
    included.  A null text is empty; texts without words have fingerprint 0 and
    link like any other.  A null doc_id is never the smallest unless a
    component has no other.  Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    own = scratch.table(docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "own")
    nodes = scratch.table(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    placed = nodes.select(_cell(_segment_counts(F.col("fp"))).alias("cell"), "fp")
    # at most _CELLS**SEGMENTS = 6561 rows, so they can go to all tasks; large cells are packed by several
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / (PACK_CHUNKS * CHUNK)).cast("int").alias("parts"))
    spread = placed.join(F.broadcast(parts), "cell").select("cell", "fp", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part"))
    chunks = scratch.table(spread.repartition("cell", "part").sortWithinPartitions("cell").select("cell", "fp").mapInArrow(_pack, "cell int, chunk long, fps binary"), "chunks")
    with arrow_rows(spark, 128):
        visits = chunks.mapInArrow(_visits(_offsets(radius)), "to int, home int, visitor long, visiting binary")
        pairs = visits.join(chunks, F.col("to") == F.col("cell")).where("home <> cell OR visitor <= chunk")
        links = scratch.table(pairs.select("visiting", "fps").mapInArrow(_forests(radius), "u long, v long"), "links")
    roots = components(links, scratch)
    labelled = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    found = labelled.select("fp", "root").join(least, "root").select("fp", "component_id")
    return own.join(found, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
