"""Benchmark decontamination by greedy string tiling.

Texts become lower-cased tokens: runs of letters and digits, single ones in
scripts written without spaces.  An item of fewer than ``min_match`` tokens is
one seed and matches where all of it occurs.  For others, a document and
a benchmark item are compared if they share seeds, runs of ``min_match``
tokens, that together cover enough of the item.  Greedy string tiling then
marks, again and again, the longest match that overlaps no earlier one, found
by running Karp-Rabin matching (Wise, 1993).  An item is covered by the sum of
its tiles, in whatever order the document has them, so reordered passages
count.

The benchmark's seeds go to every task in blocks of at most ``block_bytes`` of
text; a larger benchmark takes more passes over the documents.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import slices, texts_as_bytes

MIN_MATCH, MIN_COVERAGE = 5, 0.5
BLOCK_BYTES = 32 << 20
_TOKEN = re.compile(r"[^\W_]+")
#: Thai, Lao, Tibetan, Myanmar, Khmer, kana and Han.
_SPACELESS = "[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]"
_ANY_SPACELESS = re.compile(_SPACELESS)
_MIXED_TOKEN = re.compile(rf"(?={_SPACELESS})[^\W_]|(?:(?!{_SPACELESS})[^\W_])+")
_MOD = (1 << 61) - 1


def tokens(text: str) -> list[str]:
    text = text.lower()
    return (_MIXED_TOKEN if _ANY_SPACELESS.search(text) else _TOKEN).findall(text)


def _matches(p: list[int], t: list[int], free_p: list[bool], free_t: list[bool], size: int) -> list[tuple[int, int, int]]:
    """Maximal matches of at least size free tokens, by a rolling hash of t's and p's windows.

    If one is longer than twice the size, it is returned alone, to search at its length.
    """

    def windows(s, free):
        h, run, top = 0, 0, pow(1_000_003, size, _MOD)
        for i, x in enumerate(s):
            h = (h * 1_000_003 + x) % _MOD
            run = run + 1 if free[i] else 0
            if i >= size:
                h = (h - s[i - size] * top) % _MOD
            if run >= size:
                yield i - size + 1, h

    table: dict[int, list[int]] = {}
    for j, h in windows(t, free_t):
        table.setdefault(h, []).append(j)
    found = []
    for i, h in windows(p, free_p):
        for j in table.get(h, ()):
            if p[i : i + size] != t[j : j + size]:
                continue
            if i and j and free_p[i - 1] and free_t[j - 1] and p[i - 1] == t[j - 1]:
                continue  # part of the match that starts before it
            k = size
            while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and free_p[i + k] and free_t[j + k]:
                k += 1
            if k > 2 * size:
                return [(k, i, j)]
            found.append((k, i, j))
    return found


def tile(p: list[int], t: list[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(start in p, start in t, length) of each tile, the longest first, of equal ones the first in p, then in t.

    Tokens are positive integers; a 0 matches nothing.
    """
    free_p, free_t = [x > 0 for x in p], [x > 0 for x in t]
    tiles, size = [], max(min_match, min(len(p), len(t), 20))
    while True:
        found = _matches(p, t, free_p, free_t, size)
        if found and found[0][0] > 2 * size:
            size = found[0][0]
            continue
        queue = [(-k, i, j) for k, i, j in found]
        heapq.heapify(queue)
        while queue:
            k, i, j = heapq.heappop(queue)
            taken = [-1, *(x for x in range(-k) if not (free_p[i + x] and free_t[j + x])), -k]
            if len(taken) == 2:
                free_p[i : i - k] = free_t[j : j - k] = [False] * -k
                tiles.append((i, j, -k))
                continue
            for a, b in zip(taken, taken[1:]):  # what tiles left of the match is matched in its own turn
                if b - a - 1 >= size:
                    heapq.heappush(queue, (a + 1 - b, i + a + 1, j + a + 1))
        if size == min_match:
            return tiles
        size = max(min_match, size // 2)


class Seeds:
    """The seeds of a block of benchmark items, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], min_match: int) -> None:
        self.number: dict[str, int] = {}
        self.items = [(item, [self.number.setdefault(x, len(self.number) + 1) for x in tokens(text)]) for item, text in items]
        self.k = min_match
        rows = [(np.full(max(0, len(ids) - min_match + 1), n), np.arange(max(0, len(ids) - min_match + 1)), self.hashes(np.array(ids, np.uint64))) for n, (_, ids) in enumerate(self.items)]
        item, at, h = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.at = h[order].astype(np.uint64), item[order], at[order]
        self.known = np.unique(self.h)
        #: Length -> (hashes, ids -> item_ids) of items with fewer than min_match tokens.
        self.short: dict[int, tuple[np.ndarray, dict[tuple, list[int]]]] = {}
        for item_id, ids in self.items:
            if 0 < len(ids) < min_match:
                h, whole = self.short.get(len(ids), (np.zeros(0, np.uint64), {}))
                whole.setdefault(tuple(ids), []).append(item_id)
                self.short[len(ids)] = np.union1d(h, self.hashes(np.array(ids, np.uint64), len(ids))), whole

    def hashes(self, ids: np.ndarray, k: int | None = None) -> np.ndarray:
        k = k or self.k
        out = np.zeros(max(0, len(ids) - k + 1), np.uint64)
        for i in range(k):
            out = (out ^ ids[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return out


def _overlaps(seeds, min_coverage: float):
    def run(batches):
        """(doc_id, item_id, coverage, tiles, longest) of the pairs that reach min_coverage."""
        own = seeds.value
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), texts_as_bytes(part)):
                    out += [(doc_id, *x) for x in covered_items(raw.decode("utf-8"), own, min_coverage)]
                yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "coverage", "tiles", "longest"])

    return run


def _whole_items(ids: np.ndarray, seeds: Seeds) -> list[tuple]:
    """covered_items of the short items, all of whose tokens occur in a row."""
    out = []
    for k, (known, whole) in seeds.short.items():
        windows, first = np.unique(seeds.hashes(ids, k), return_index=True)
        for i in first[np.isin(windows, known)].tolist():
            out += [(item_id, 1.0, 1, k) for item_id in whole.get(tuple(ids[i : i + k].tolist()), ())]
    return out


def covered_items(text: str, seeds: Seeds, min_coverage: float) -> list[tuple]:
    """(item_id, coverage, tiles, longest) of each item that the text covers enough of."""
    found = tokens(text)
    get = seeds.number.get
    ids = np.array([get(x, 0) for x in found], np.uint64)
    out = _whole_items(ids, seeds)
    if len(found) < seeds.k or not len(seeds.known):
        return out
    absent = np.concatenate([[0], np.cumsum(ids == 0)])
    starts = np.flatnonzero(absent[seeds.k :] == absent[: -seeds.k])
    if not len(starts):
        return out
    windows = np.zeros(len(starts), np.uint64)
    for i in range(seeds.k):
        windows = (windows ^ ids[starts + i]) * np.uint64(0x9E3779B97F4A7C15)
        windows ^= windows >> np.uint64(31)
    place = np.minimum(np.searchsorted(seeds.known, windows), len(seeds.known) - 1)
    hit = seeds.known[place] == windows
    starts, windows = starts[hit], windows[hit]
    if not len(starts):
        return out
    distinct = np.unique(windows)
    lo, hi = np.searchsorted(seeds.h, distinct, "left"), np.searchsorted(seeds.h, distinct, "right")
    rows = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])
    for n in np.unique(seeds.item[rows]):
        item_id, p = seeds.items[n]
        mine = rows[seeds.item[rows] == n]
        covered = np.zeros(len(p), bool)
        for i in range(seeds.k):
            covered[seeds.at[mine] + i] = True
        if covered.sum() < min_coverage * len(p):
            continue
        near = np.zeros(len(ids), bool)
        for i in range(seeds.k):
            near[starts[np.isin(windows, seeds.h[mine])] + i] = True
        spot = np.flatnonzero(near)
        gaps = np.flatnonzero(np.diff(spot) > 1) + 1
        t = np.insert(ids[spot].astype(np.int64), gaps, 0).tolist()  # a 0 parts what isn't adjacent
        tiles = tile(p, t, seeds.k)
        coverage = sum(k for _, _, k in tiles) / len(p)
        if coverage >= min_coverage:
            out.append((item_id, coverage, len(tiles), max(k for _, _, k in tiles)))
    return out


def _clean(seeds, min_coverage: float):
    def run(batches):
        own = seeds.value
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([not covered_items(raw.decode("utf-8"), own, min_coverage) for raw in texts_as_bytes(part)], pa.bool_()))

    return run


def _blocks(benchmark: DataFrame, min_match: int, block_bytes: int):
    """The benchmark's seeds, broadcast block by block."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes))
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield benchmark.sparkSession.sparkContext.broadcast(Seeds([tuple(r) for r in block.toLocalIterator()], min_match))


def overlaps(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, longest) of contaminated documents.

    coverage: the share of the item's tokens that tiles of at least min_match
    tokens cover; pairs with at least min_coverage are returned.  An item
    of fewer than min_match tokens is covered where it occurs whole.  Items
    without tokens, null texts and null item_ids never match.  Rows that repeat are compared each by themselves and give equal
    rows.  A null doc_id stays null.  Other columns are ignored.
    """
    found = None
    for seeds in _blocks(benchmark, min_match, block_bytes):
        part = docs.select("doc_id", "text").mapInArrow(_overlaps(seeds, min_coverage), "doc_id long, item_id long, coverage double, tiles long, longest long")
        found = part if found is None else found.unionByName(part)
    return found


def without_overlaps(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows whose own text covers an item, whatever their doc_id."""
    for seeds in _blocks(benchmark, min_match, block_bytes):
        docs = docs.mapInArrow(_clean(seeds, min_coverage), docs.schema)
    return docs
