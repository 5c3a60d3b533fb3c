"""Exact top-k by inner product, with a KD-tree in each shard.

Vectors are dealt to cells, by median splits that a bounded sample decides,
and a cell to as many shards as its bytes need.  A shard is a packed block of
vectors.  Its tree splits at the median of the widest dimension; every node
keeps the tight bounding box of its vectors.  A query's score against anything
in a box is at most the sum over dimensions of the larger of q*low and q*high.
A search takes nodes by that bound, largest first, and stops when the bound is
below the kth score so far.

Queries come in blocks, dealt by the same cells.  Each block first searches a
shard of its own cell; the kth scores found there are propagated.  Then the
block meets the root boxes of all shards, many boxes a row, and goes on only to
shards whose box may hold a better score for one of its queries, with those
queries marked.  Every (block, shard) pair left is a row of its own, and
returns at most k rows a query.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import Scratch, arrow_rows

#: Bytes of vectors in a shard and in a block of queries; vectors in a leaf; boxes that a block meets at once.
SHARD_BYTES, BLOCK_BYTES, LEAF, PAGE = 8 << 20, 256 << 10, 256, 1024
#: Cells are cut by at most so many sampled vectors and bytes, with so many a cell or more.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLED_A_CELL = 8192, 32 << 20, 16
K, SCALE = 5, 256


class KDTree:
    """Vectors reordered so that each node is a range; boxes are tight."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, end, left, right; -1 at leaves
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self._build(vectors, 0, len(vectors), leaf)
        self.vectors = vectors[self.order]
        self.boxes = np.array(self.low), np.array(self.high)

    def _build(self, v: np.ndarray, start: int, end: int, leaf: int) -> int:
        own = v[self.order[start:end]]
        low, high = own.min(axis=0), own.max(axis=0)
        me = len(self.nodes)
        self.nodes.append((start, end, -1, -1))
        self.low.append(low)
        self.high.append(high)
        if end - start > leaf and (high > low).any():
            axis, middle = int(np.argmax(high - low)), (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(own[:, axis], middle)]
            left = self._build(v, start, start + middle, leaf)
            right = self._build(v, start + middle, end, leaf)
            self.nodes[me] = start, end, left, right
        return me

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): the most that a node's vectors can score."""
        low, high = self.boxes
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        return plus @ high.T + minus @ low.T


def _search(tree: KDTree, ids: np.ndarray, query: np.ndarray, own_id: int, bound: np.ndarray, kth: float, k: int) -> list[tuple[float, int]]:
    """The k best (score, vec_id) that score kth at least, ties to the smaller id."""
    best: list[tuple[float, int]] = []  # a heap of (score, -vec_id), the worst first
    queue = [(-bound[0], 0)]
    while queue:
        most, node = heapq.heappop(queue)
        if -most < (max(kth, best[0][0]) if len(best) == k else kth):
            break
        start, end, left, right = tree.nodes[node]
        if left >= 0:
            heapq.heappush(queue, (-bound[left], left))
            heapq.heappush(queue, (-bound[right], right))
            continue
        scores = tree.vectors[start:end] @ query
        least = max(kth, best[0][0]) if len(best) == k else kth
        near = np.flatnonzero((scores >= least) & (ids[start:end] != own_id))
        if len(near) > k:  # only the k best of a leaf matter, by score, then id
            near = near[np.lexsort((ids[start:end][near], -scores[near]))[:k]]
        for i in near.tolist():
            entry = (scores[i].item(), -int(ids[start + i]))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return [(s, -i) for s, i in best]


def scaled(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a double; null where a component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return F.when(embedding.isNotNull() & ~bad, whole)


class Cells:
    """Cells of space, by median splits of a sample along its widest dimension."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, value, left, right; a cell has axis -1 and its number for left
        self.count = 0
        self._split(sample, max(1, min(cells, len(sample) // SAMPLED_A_CELL)))

    def _split(self, v: np.ndarray, cells: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, self.count, 0))
        if cells > 1:
            axis = int(np.argmax(v.max(axis=0) - v.min(axis=0)))
            middle = float(np.median(v[:, axis]))
            below = v[:, axis] < middle
            if below.any():  # else the sample can't be split
                left = self._split(v[below], cells // 2)
                right = self._split(v[~below], cells - cells // 2)
                self.nodes[me] = axis, middle, left, right
                return me
        self.nodes[me] = -1, 0.0, self.count, 0
        self.count += 1
        return me

    def of(self, v: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        out, todo = np.zeros(len(v), np.int32), [(0, np.arange(len(v)))]
        while todo:
            node, rows = todo.pop()
            axis, value, left, right = self.nodes[node]
            if axis < 0:
                out[rows] = left
            elif len(rows):
                below = v[rows, axis] < value
                todo += [(left, rows[below]), (right, rows[~below])]
        return out


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows, shorter ones filled up with zeros."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets) - column.offsets[0].as_py()
    out, size = np.zeros((len(column), width)), np.diff(offsets)
    out[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(offsets[:-1], size)] = flat
    return out


def _placed(cells, width: int):
    def run(batches):
        """(vec_id, asked, cell, v), v being the padded vector's bytes."""
        for batch in batches:
            v = _padded(batch.column("v"), width)
            yield pa.record_batch([batch.column("vec_id"), batch.column("asked"), pa.array(cells.value.of(v)), pa.array([x.tobytes() for x in v], pa.binary())], ["vec_id", "asked", "cell", "v"])

    return run


def _pack(width: int, rows: int):
    def run(batches):
        """(part, cell, ids, vectors, low, high): blocks of at most ``rows`` vectors of one cell and lot; rows come sorted by both."""
        task, made, now, ids, vectors = TaskContext.get().partitionId(), 0, None, [], []

        def row():
            nonlocal made, ids, vectors
            block = np.frombuffer(b"".join(vectors)).reshape(len(ids), width)
            columns = [pa.array([task << 32 | made], pa.int64()), pa.array([now[0]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (np.array(ids, np.int64), block, block.min(axis=0), block.max(axis=0)))]
            made, ids, vectors = made + 1, [], []
            return pa.record_batch(columns, ["part", "cell", "ids", "vectors", "low", "high"])

        for batch in batches:
            for cell, lot, vec_id, v in zip(*(batch.column(c).to_pylist() for c in ("cell", "lot", "vec_id", "v"))):
                if ids and (len(ids) == rows or (cell, lot) != now):
                    yield row()
                now = cell, lot
                ids.append(vec_id)
                vectors.append(v)
        if ids:
            yield row()

    return run


_PACKED = "part long, cell int, ids binary, vectors binary, low binary, high binary"


def _packed(placed: DataFrame, rows: int, width: int) -> DataFrame:
    """Blocks of vectors by cell; a cell with more rows than a block holds is dealt to lots by hash."""
    lots = placed.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("lots"))
    spread = placed.join(F.broadcast(lots), "cell")  # at most SAMPLE_ROWS / SAMPLED_A_CELL cells
    spread = spread.select("cell", F.pmod(F.xxhash64("vec_id", "v"), F.col("lots")).cast("int").alias("lot"), "vec_id", "v")
    return spread.repartition("cell", "lot").sortWithinPartitions("cell", "lot").mapInArrow(_pack(width, rows), _PACKED)


def _rows(batch: pa.RecordBatch):
    """The rows of a batch as dicts, one at a time."""
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _pruned(width: int):
    def run(batches):
        """(part, block, mask): for a block and a page of boxes, the shards that may hold a better score, and for which queries."""
        for batch in batches:
            for r in _rows(batch):
                queries = np.frombuffer(r["q_vectors"]).reshape(-1, width)
                kth = np.frombuffer(r["kth"])[: len(queries)] if r["kth"] is not None else np.full(len(queries), -np.inf)
                low, high = (np.frombuffer(b"".join(r[c])).reshape(-1, width) for c in ("lows", "highs"))
                most = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
                wanted = most >= kth[:, None]
                keep = [j for j in np.flatnonzero(wanted.any(axis=0)).tolist() if r["parts"][j] != r["home"]]
                yield pa.record_batch([pa.array([r["parts"][j] for j in keep], pa.int64()), pa.array([r["block"]] * len(keep), pa.int64()), pa.array([wanted[:, j].tobytes() for j in keep], pa.binary())], ["part", "block", "mask"])

    return run


def _searches(width: int, k: int):
    def run(batches):
        """The best of each asking query of a block in a shard.

        Rows come sorted by shard: its vectors first, then the blocks that ask.
        """
        last, tree, ids = None, None, None
        for batch in batches:
            for r in _rows(batch):
                if r["block"] is None:
                    ids, last = np.frombuffer(r["ids"], np.int64), r["part"]
                    tree = KDTree(np.frombuffer(r["vectors"]).reshape(len(ids), width))
                    ids = ids[tree.order]
                    continue
                assert r["part"] == last
                own = np.frombuffer(r["ids"], np.int64)
                queries = np.frombuffer(r["vectors"]).reshape(len(own), width)
                kth = np.frombuffer(r["kth"])[: len(own)] if r["kth"] is not None else np.full(len(own), -np.inf)
                asking = np.flatnonzero(np.frombuffer(r["mask"], bool)) if r["mask"] is not None else np.arange(len(own))
                bounds = tree.bounds(queries[asking])
                found = [(i, s, v) for n, i in enumerate(asking.tolist()) for s, v in _search(tree, ids, queries[i], int(own[i]), bounds[n], float(kth[i]), k)]
                place = np.array([f[0] for f in found], np.int64)
                yield pa.record_batch([pa.array([r["block"]] * len(found), pa.int64()), pa.array(place), pa.array(own[place]), pa.array([f[2] for f in found], pa.int64()), pa.array([int(f[1]) for f in found], pa.int64())], ["block", "place", "query_id", "vec_id", "score"])

    return run


def _meet(shards: DataFrame, asking: DataFrame) -> DataFrame:
    """Each shard once, followed by the blocks that ask it."""
    none = F.lit(None).cast("binary")
    rows = shards.select("part", F.lit(None).cast("long").alias("block"), "ids", "vectors", none.alias("kth"), none.alias("mask")).unionByName(asking.select("part", "block", F.col("q_ids").alias("ids"), F.col("q_vectors").alias("vectors"), "kth", "mask"))
    return rows.repartition("part").sortWithinPartitions("part", F.col("block").asc_nulls_first())


_FOUND = "block long, place long, query_id long, vec_id long, score long"


def _cells_of(own: DataFrame, n: int, width: int, cells: int) -> Cells:
    """Cells cut by a sample whose rows and bytes are bounded."""
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    mask = (1 << 30) - 1
    place = F.xxhash64(F.lit("cells"), "vec_id", "v").bitwiseAND(F.lit(mask))
    chosen = own.select("v", place.alias("place")).where(F.col("place") <= int(min(1.0, 2 * most / max(1, n)) * mask)).orderBy("place").limit(most).select("v")
    sample = np.zeros((0, width))
    for batch in chosen.toArrow().to_batches() if cells > 1 else ():
        sample = np.concatenate([sample, _padded(batch.column(0), width)])
    return Cells(sample, cells)


def top_k(vectors: DataFrame, queries: Column, k: int = K, scale: int = SCALE, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of vectors for each query.

    vectors: (vec_id, embedding).  queries: a condition that marks query rows.
    Components become floor(scale * x); the score is the integer inner product,
    exact while sums stay below 2**53.  Ties go to the smaller vec_id.  A query
    never meets rows of its own vec_id; rows that repeat a vec_id otherwise
    stand for themselves.  Null vectors, those holding null or non-finite
    components, and null vec_ids take no part.  Shorter vectors are padded with
    zeros.  Other columns are ignored.  Cells are cut by a sample, but every
    row is in a shard, and every shard that may matter is searched.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    own = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.coalesce(queries, F.lit(False)).alias("asked"), scaled(F.col("embedding"), scale).alias("v")).where("v IS NOT NULL")
    n, width = own.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width)
    shard_rows, block_queries = max(1, shard_bytes // (8 * width)), max(1, min(1024, block_bytes // (8 * width)))
    cells = spark.sparkContext.broadcast(_cells_of(own, n, width, -(-n // shard_rows)))
    with arrow_rows(spark, max(16, min(10_000, (8 << 20) // (8 * width)))):
        placed = scratch.table(own.mapInArrow(_placed(cells, width), "vec_id long, asked boolean, cell int, v binary"), "placed")
        shards = scratch.table(_packed(placed, shard_rows, width), "shards")
        blocks = _packed(placed.where("asked"), block_queries, width).select(F.col("part").alias("block"), "cell", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
        homes = shards.groupBy("cell").agg(F.min("part").alias("home"))  # queries are vectors, so their cell has a shard
        blocks = scratch.table(blocks.join(F.broadcast(homes), "cell").drop("cell"), "blocks")
    none = F.lit(None).cast("binary")
    n_pages = -(-shards.count() // PAGE)
    by_page = shards.select(F.pmod(F.xxhash64("part"), F.lit(n_pages)).cast("int").alias("page"), F.struct("part", "low", "high").alias("b")).groupBy("page").agg(F.collect_list("b").alias("b"))
    pages = scratch.table(by_page.select("page", F.col("b.part").alias("parts"), F.col("b.low").alias("lows"), F.col("b.high").alias("highs")), "pages")
    with arrow_rows(spark, 16):
        first = scratch.table(_meet(shards, blocks.withColumns({"part": F.col("home"), "kth": none, "mask": none})).mapInArrow(_searches(width, k), _FOUND), "first")
        floor = first.groupBy("block", "place").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        packed = floor.groupBy("block").applyInArrow(_pack_bounds(block_queries), "block long, kth binary")
        known = scratch.table(blocks.join(packed, "block", "left"), "known")
        # every block meets every page: PAGE boxes at once, so few rows, and each block's own bounds decide which shards it goes on to
        turned = known.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1)))).join(pages, "page")
        asked = scratch.table(turned.select("block", "home", "q_vectors", "kth", "parts", "lows", "highs").mapInArrow(_pruned(width), "part long, block long, mask binary"), "asked")
        rest = scratch.table(_meet(shards, asked.join(known, "block")).mapInArrow(_searches(width, k), _FOUND), "rest")
    order = Window.partitionBy("block", "place").orderBy(F.col("score").desc(), "vec_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _pack_bounds(queries: int):
    def run(table: pa.Table) -> pa.Table:
        """A block's kth scores by place; places without k finds have no bound."""
        kth = np.full(queries, -np.inf)
        for p, s in zip(table.column("place").to_pylist(), table.column("kth").to_pylist()):
            if s is not None:
                kth[p] = s
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "kth": pa.array([kth.tobytes()], pa.binary())})

    return run
