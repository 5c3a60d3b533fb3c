"""Substring dedup by repeated-phrase automata.

A window is ``window`` consecutive words.  Its anchor is the ``gram``-word
phrase inside it with the least hash, so equal windows have equal anchors, and
one anchor serves about (window - gram) / 2 windows in a row: a *run*.

1. Anchor hashes are reduced per task and dealt to shards, where Bloom filters
   find the anchors that recur (as in line dedup).
2. All documents are read again.  Each run whose anchor recurs moves on as its
   *context*: the words of its windows.  A task sends equal contexts once.
3. Contexts are dealt to shards by anchor.  A shard confirms the windows that
   recur, word by word, compiles them into an Aho-Corasick automaton and streams its
   contexts through it; every occurrence of a window is found, and with it the
   first one.
4. Each run learns which of its windows start earlier elsewhere, and documents
   lose the words that such windows cover.

Every document is streamed past the filters, but a context only past the
automaton of its own anchor: sending all documents through the automata of all
shards would cost documents x shards.  An anchor with very many different
contexts is no shard's: its windows meet by digest, spread over all tasks.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._shared import Scratch, slices, texts_as_bytes, worker_state
from .bloom import PACKED, collected, filters_of, met_in_shards, packed_by_shard, shard_of

WINDOW, GRAM = 20, 6
#: Filters up to this size go to all tasks; runs are dealt to the shards of larger ones.
MAX_FILTER_BYTES = 64 << 20
#: Anchors with about this many different contexts or more are worked on by window; they are found among one in CONTEXT_SHARE.
HOT_CONTEXTS, CONTEXT_SHARE = 4000, 64
IDS_A_SHARD, WINDOWS_A_FILE = 1_000_000, 1_000_000
_NULL_ID = -(2**63)
#: Texts are worked on in slices of so many bytes.
SLICE = 2 << 20
#: An automaton is compiled when so many contexts of whole anchors have come.
BLOCK_CONTEXTS = 4000
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**n; kept by the worker up to a slice's length."""
    state = worker_state()
    kept = state.get(("powers", int(base)))
    if kept is None or len(kept) <= n:
        kept = np.full(max(n, SLICE) + 1, base, np.uint64)
        kept[0] = 1
        kept = np.cumprod(kept, dtype=np.uint64)
        if n <= 2 * SLICE:
            state["powers", int(base)] = kept
    return kept[: n + 1]


class Words:
    """The words of a slice's texts: byte spans, 64-bit hashes, and each text's range."""

    def __init__(self, part: pa.RecordBatch, column: str = "text") -> None:
        array = part.column(column)
        n = len(array)
        offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
        data = array.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        space = _SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        starts, ends = ~space, ~space
        starts[1:] &= space[:-1] | edge[1:-1]
        ends[:-1] &= space[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.raw = raw

    def hashes(self) -> np.ndarray:
        powers = _powers(_B, len(self.raw))
        sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
        inverse = _powers(_B_INVERSE, len(self.raw))
        return _mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))


def _sliding_minimum(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours, by doubling."""
    n, done = len(x) - size + 1, 1
    while 2 * done <= size:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:n], x[size - done : size - done + n])


def _runs(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, text, first window's start, windows) of each run; starts count from the slice's first word.

    The anchor is the leftmost of the least grams.  It changes where the least
    value does, or where the anchor drops out and an equal gram follows.
    """
    h = words.hashes()
    n = len(h) - window + 1
    text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    if n <= 0:
        return none
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(_B, len(h))[:-1], out=sums[1:])
    grams = _mix((sums[gram:] - sums[:-gram]) * _powers(_B_INVERSE, len(h))[: len(h) - gram + 1])
    least = _sliding_minimum(grams, window - gram + 1)
    valid = text[:n] == text[window - 1 :]
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (grams[: n - 1] == least[:-1])
    first = np.flatnonzero(fresh)
    if not len(first):
        return none
    upto = np.concatenate([[0], np.cumsum(valid)])  # a run ends where the next starts, or where windows cross texts
    return least[first], text[first], first, upto[np.concatenate([first[1:], [n]])] - upto[first]


def _anchors_by_task(window: int, gram: int, shards: int):
    def run(batches):
        parts, count = [], 0
        for batch in batches:
            for part in slices(batch, max_bytes=SLICE):
                parts.append(_runs(Words(part), window, gram)[0])
                count += len(parts[-1])
            if count > 2_000_000:
                yield packed_by_shard(parts, shards)
                parts, count = [], 0
        if parts:
            yield packed_by_shard(parts, shards)

    return run


class RowNames:
    """Names rows, and orders them: did is the doc_id, (t1, t2) 127 bits of the text's digest.

    A null doc_id has the least long for did and a negative t1, so it comes
    before that doc_id itself.  Rows whose doc_id surely is no other row's go
    without a digest: repeated knows all doc_ids that repeat.
    """

    def __init__(self, repeated=None) -> None:
        self.repeated = repeated

    def __call__(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = part.column("doc_id")
        none = ids.is_null().to_numpy(zero_copy_only=False)
        did = ids.fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
        shared = none | self.repeated.value.know(_mix(did.view(np.uint64))) if self.repeated is not None else np.ones(len(did), bool)
        digests = np.zeros((len(did), 2), np.uint64)
        at = np.flatnonzero(shared)
        if len(at):
            texts = part.column("text").take(pa.array(at)).cast(pa.binary()).to_pylist()
            digests[at] = np.frombuffer(b"".join([xxhash.xxh3_128_digest(t or b"") for t in texts]), np.uint64).reshape(-1, 2)
        t1 = (digests[:, 0] >> np.uint64(1)).view(np.int64)
        return did, np.where(none, -1 - t1, t1), np.ascontiguousarray(digests[:, 1]).view(np.int64)


def _ids_by_task(shards: int):
    """The hashes of this task's doc_ids, packed by shard."""

    def run(batches):
        parts, count = [], 0
        for batch in batches:
            parts.append(_mix(batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)))
            count += len(parts[-1])
            if count > 2_000_000:
                yield packed_by_shard(parts, shards)
                parts, count = [], 0
        if parts:
            yield packed_by_shard(parts, shards)

    return run


ROW = ("did", "t1", "t2")
_CONTEXT = "h long, d1 long, d2 long, did long, t1 long, t2 long, start int, context binary"


def _contexts(window: int, gram: int, filters, names: RowNames):
    """Runs whose anchor may recur; of equal contexts in a task the first alone has the words."""

    def run(batches):
        sent: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, max_bytes=SLICE):
                words = Words(part)
                h, text, first, count = _runs(words, window, gram)
                if not len(h):
                    continue
                keep = filters.value.know(h)
                yield _context_rows(names(part), words, h[keep], text[keep], first[keep], count[keep], window, sent)

    return run


def _context_rows(rows, words, h, text, first, count, window, sent) -> pa.RecordBatch:
    raw, starts, ends = words.raw.tobytes(), words.starts.tolist(), words.ends.tolist()
    digests, contexts = [], []
    for a, n in zip(first.tolist(), count.tolist()):
        b = a + n + window - 1
        context = b" ".join([raw[starts[i] : ends[i]] for i in range(a, b)])
        digest = xxhash.xxh3_128_digest(context)
        digests.append(digest)
        if digest in sent:
            contexts.append(None)
        else:
            contexts.append(context)
            if len(sent) < 500_000:
                sent.add(digest)
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    begin = (first - words.bounds[text]).astype(np.int32)
    columns = [h.view(np.int64), both[:, 0], both[:, 1], *(x[text] for x in rows), begin]
    return pa.record_batch([*(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array(contexts, pa.binary())], ["h", "d1", "d2", *ROW, "start", "context"])


def _all_runs(window: int, gram: int, names: RowNames, shards: int):
    """(shard, h, did, t1, t2, start, n) of every run."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, max_bytes=SLICE):
                words = Words(part)
                h, text, first, count = _runs(words, window, gram)
                rows = [x[text] for x in names(part)]
                columns = [shard_of(h, shards).astype(np.int32), h.view(np.int64), *rows, (first - words.bounds[text]).astype(np.int32), count.astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in columns], ["shard", "h", *ROW, "start", "n"])

    return run


def _marked_contexts(window: int, names: RowNames):
    """The contexts of the runs (h, start, n) listed with each text."""

    def run(batches):
        sent: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, max_bytes=SLICE):
                words, marks = Words(part), part.column("marks").to_pylist()
                text = np.array([i for i, m in enumerate(marks) for _ in m or ()], np.int64)
                if len(text):
                    h, start, n = (np.array([x[k] for m in marks for x in m or ()], np.int64) for k in ("h", "start", "n"))
                    yield _context_rows(names(part), words, h.view(np.uint64), text, start + words.bounds[text], n, window, sent)

    return run


_SEGMENTS = "array<struct<i:int,n:int,did:long,t1:long,t2:long,start:int>>"
_LOCATED = f"d1 long, d2 long, segments {_SEGMENTS}"


def _locate(window: int):
    """For each distinct context: its recurring windows, as segments (i, n, did, t1, t2, start).

    Windows i to i + n - 1 of the context occur first from word ``start`` of
    the row (did, t1, t2) on.  Rows come sorted by anchor.  A block of whole
    anchors at a time is numbered word by word and streamed through its automaton.
    Where an anchor has a single context, that recurs as a whole and is one pattern;
    else the windows that recur are the patterns.
    """
    import ahocorasick

    def solve(groups):
        number: dict[bytes, int] = {}
        automaton, firsts, sizes = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), [], []
        rows, streams = [], []

        def pattern(words):
            if not automaton.exists(words):
                automaton.add_word(words, len(firsts))
                firsts.append(None)
                sizes.append(len(words))

        for group in groups:
            own = [tuple(number.setdefault(w, len(number)) for w in r["context"].split(b" ")) for r in group]
            if len(group) == 1:
                if group[0]["n"] == 1:
                    continue
                pattern(own[0])
            else:
                seen: Counter = Counter()
                for s, r in zip(own, group):
                    for i in range(len(s) - window + 1):
                        seen[s[i : i + window]] += r["n"]
                for w, n in seen.items():
                    if n > 1:
                        pattern(w)
            rows += group
            streams += own
        out = []
        if firsts:
            automaton.make_automaton()
            found = []
            for s, r in zip(streams, rows):
                row, start, own = (r["did"], r["t1"], r["t2"]), r["start"], []
                for end, k in automaton.iter(s):
                    i = end - sizes[k] + 1
                    at = (row, start + i)
                    own.append((i, k))
                    if firsts[k] is None or at < firsts[k]:
                        firsts[k] = at
                found.append(own)
            for r, own in zip(rows, found):
                segments = []
                for i, k in own:
                    row, start = firsts[k]
                    n = sizes[k] - window + 1
                    last = segments[-1] if segments else None
                    if last and last[0] + last[1] == i and last[2] == row and last[3] + last[1] == start:
                        last[1] += n
                    else:
                        segments.append([i, n, row, start])
                if segments:
                    out.append((r["d1"], r["d2"], segments))
        flat = [(i, n, *row, start) for x in out for i, n, row, start in x[2]]
        kinds = (("i", pa.int32()), ("n", pa.int32()), *((c, pa.int64()) for c in ROW), ("start", pa.int32()))
        struct = pa.StructArray.from_arrays([pa.array([y[j] for y in flat], t) for j, (_, t) in enumerate(kinds)], [c for c, _ in kinds])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x[2]) for x in out])]), pa.int32()), struct)
        return pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), lists], ["d1", "d2", "segments"])

    def run(batches):
        groups: list[list[dict]] = []
        held = 0
        for batch in batches:
            for h, group in groupby(batch.to_pylist(), key=lambda r: r["h"]):
                group = list(group)
                if groups and groups[-1][0]["h"] == h:
                    groups[-1] += group
                else:
                    if held >= BLOCK_CONTEXTS:
                        yield solve(groups)
                        groups, held = [], 0
                    groups.append(group)
                held += len(group)
        if groups:
            yield solve(groups)

    return run


def _windows(window: int):
    """(w1, w2, d1, d2, i, n, did, t1, t2, start) of each window of the contexts; (w1, w2) is its digest."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                words = r["context"].split(b" ")
                for i in range(len(words) - window + 1):
                    w = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words[i : i + window])), np.int64).tolist()
                    out.append((*w, r["d1"], r["d2"], i, r["n"], r["did"], r["t1"], r["t2"], r["start"] + i))
            names = ["w1", "w2", "d1", "d2", "i", "n", *ROW, "start"]
            yield pa.record_batch([pa.array([x[j] for x in out], pa.int32() if c in ("i", "start") else pa.int64()) for j, c in enumerate(names)], names)

    return run


def _located_by_window(contexts: DataFrame, window: int, scratch: Scratch, files: int) -> DataFrame:
    """_LOCATED of the contexts of hot anchors, whose windows meet by digest in any number of tasks."""
    found = scratch.table(contexts.mapInArrow(_windows(window), "w1 long, w2 long, d1 long, d2 long, i int, n long, did long, t1 long, t2 long, start int"), "windows", files)
    firsts = found.groupBy("w1", "w2").agg(F.sum("n").alias("times"), F.min(F.struct(*ROW, "start")).alias("first")).where("times > 1")
    firsts = scratch.table(firsts.select("w1", "w2", "first"), "firsts", files)
    segment = F.struct("i", F.lit(1).alias("n"), "first.did", "first.t1", "first.t2", "first.start")
    return found.select("w1", "w2", "d1", "d2", "i").join(firsts, ["w1", "w2"]).groupBy("d1", "d2").agg(F.collect_list(segment).alias("segments")).select("d1", "d2", F.col("segments").cast(_SEGMENTS))


def _cut(window: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, max_bytes=SLICE):
                totals, removed, kept = [], [], []
                for text, spans in zip(texts_as_bytes(part), part.column("spans").to_pylist()):
                    words = text.split()
                    totals.append(len(words))
                    if spans:
                        change = np.zeros(len(words) + 1, np.int64)
                        both = np.array([(x["at"], x["at"] + x["n"] + window - 1) for x in spans], np.int64)
                        np.add.at(change, both[:, 0], 1)
                        np.add.at(change, both[:, 1], -1)
                        words = [w for w, c in zip(words, (np.cumsum(change)[:-1] > 0).tolist()) if not c]
                    removed.append(totals[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.record_batch([part.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return run


def _add_row(names: RowNames):
    def run(batches):
        for batch in batches:
            for part in slices(batch, max_bytes=SLICE):
                yield pa.record_batch([*part.columns, *(pa.array(x) for x in names(part))], [*part.schema.names, *ROW])

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, max_filter_bytes: int = MAX_FILTER_BYTES, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of each row of docs, repeated passages gone.

    Words are runs of bytes other than ASCII white space.  A word is removed if
    a window covers it whose word sequence also starts earlier: in a smaller
    doc_id, or earlier in the same document.  Windows are judged on the input.
    Null texts have no words; texts shorter than a window lose none.  Null
    doc_ids come before all others.  Rows that repeat a doc_id are ordered by
    a 127-bit digest of their text; a window is no repeat of itself in an equal row.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    filtered = filters_of(own.select("text").mapInArrow(_anchors_by_task(window, gram, shards), PACKED), scratch, shards)
    filters = collected(filtered, shards, max_filter_bytes)
    few = 1 + docs.count() // IDS_A_SHARD
    repeated = filters_of(own.select("doc_id").mapInArrow(_ids_by_task(few), PACKED), Scratch(spark, "phrase-ids"), few)
    names = RowNames(collected(repeated, few, max_filter_bytes))
    named = own.mapInArrow(_add_row(names), "doc_id long, text string, did long, t1 long, t2 long")
    if filters is not None:
        runs = own.mapInArrow(_contexts(window, gram, filters, names), _CONTEXT)
    else:
        all_runs = own.mapInArrow(_all_runs(window, gram, names, shards), "shard int, h long, did long, t1 long, t2 long, start int, n int")
        marks = met_in_shards(all_runs, filtered, shards).groupBy(*ROW).agg(F.collect_list(F.struct("h", "start", "n")).alias("marks"))
        runs = named.join(marks, [*ROW]).select("doc_id", "text", "marks").mapInArrow(_marked_contexts(window, names), _CONTEXT)
    runs = scratch.table(runs, "runs")
    first = F.min(F.struct(*ROW, "start")).alias("at")
    contexts_of = lambda r: r.groupBy("h", "d1", "d2").agg(first, F.count("*").alias("n"), F.max("context").alias("context")).select("h", "d1", "d2", "at.*", "n", "context")
    share = min(CONTEXT_SHARE, hot_contexts + 1)
    some = runs.where(F.col("context").isNotNull() & (F.pmod("d1", F.lit(share)) == 0))
    hot = scratch.table(some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot_contexts // share).repartition(1), "hot")  # few
    n_hot = share * (hot.agg(F.sum("n")).first()[0] or 0)
    rest = runs.join(hot, "h", "left_anti") if n_hot else runs
    located = contexts_of(rest).repartition("h").sortWithinPartitions("h").mapInArrow(_locate(window), _LOCATED)
    if n_hot:
        own_hot = contexts_of(runs.join(hot.select("h"), "h", "left_semi"))
        located = located.unionByName(_located_by_window(own_hot, window, scratch, 1 + n_hot * window // WINDOWS_A_FILE))
    here = F.filter("segments", lambda x: (x.did != F.col("did")) | (x.t1 != F.col("t1")) | (x.t2 != F.col("t2")) | (x["start"] != F.col("start") + x.i))
    spans = F.transform(here, lambda x: F.struct((F.col("start") + x.i).alias("at"), x.n.alias("n")))
    found = runs.select("d1", "d2", *ROW, "start").join(located, ["d1", "d2"]).select(*ROW, spans.alias("spans")).where(F.size("spans") > 0)
    found = scratch.table(found.groupBy(*ROW).agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    scratch.drop("runs")
    return named.join(found, [*ROW], "left").select("doc_id", "text", "spans").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, text string")
