"""Near copies: SimHash proposes, exact Jaccard similarity of word shingles decides.

Equal texts are one node.  The SimHash operator, on 5-word shingles, gives
components of fingerprints that differ in at most ``RADIUS`` bits; each node is
compared with the least node of its component, and linked to it if whole sets
of shingles reach a similarity of 4/5.  That finds most copies with few edits,
large groups among them, by one comparison a node.

Fingerprints of texts as similar as 4/5 may differ in 13 bits and more, a
radius at which the grid prunes nothing.  So a prefix filter proposes the rest.
A node's shingles are put in one order for all texts: those that a sample finds
frequent last, else by hash.  Of two sets with a similarity of 4/5 or more, the
first n - ceil(4n/5) + 1 of each in that order (its prefix) share a shingle,
whatever the order is, so pairs that meet on their prefixes' shingles miss none
(Chaudhuri et al., "A Primitive Operator for Similarity Joins in Data
Cleaning", 2006).

A shingle in up to ``SMALL`` prefixes yields its pairs; a pair goes on if it
isn't linked yet and shares so many prefix shingles as the similarity needs.
The members of a more common one are first compared with one of them, the
pivot, so a group of near copies is linked by one comparison a member.  Members
that are in another component than most of their group are then compared with
all of it, in chunks by size.  Either way whole sets are compared before two
nodes are linked, and a group yields a spanning forest, not its links.

Before sets are shuffled, members are compared by bitmaps, a bit for each
residue of the hashes that an odd number of them have.  Bitmaps differ in no
more bits than sets differ in shingles, so a pair that differs in too many
can't reach 4/5 (Sandes et al., "Bitmap Filter: Speeding up Exact Set Similarity
Joins with Bitwise Operations", 2020).  Members of a common shingle's group first
meet the one that is nearest by bitmaps, so that few are left to meet the rest.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ._shared import Scratch, arrow_rows, slices, texts_as_bytes
from .components import Labels, components
from .simhash import near_duplicates

#: Words of a shingle.  A link is a similarity of 4/5 or more.
SHINGLE, SEED = 5, 42
#: Bits in which fingerprints may differ for SimHash to propose a pair.
RADIUS = 4
#: Shingles of at least FREQUENT sampled rows come last; only work depends on it.  About SAMPLE
#: rows are sampled, one of SHARE if these are more: a share that shrinks as rows grow sees less.
SAMPLE, SHARE, FREQUENT, MAX_FREQUENT = 40_000, 6, 3, 1 << 20
SMALL = 32
CHUNK, CHUNK_SHINGLES = 512, 1 << 20
#: Bits of a bitmap: at least the number of shingles, within these limits.
MIN_BITS, MAX_BITS = 64, 1 << 16
#: Up to so many nodes are broadcast to find their texts; for more, texts are shuffled.
BROADCAST_NODES = 500_000


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's word shingles; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    k = min(size, len(words))
    hash_of = xxhash.xxh64_intdigest
    return np.unique(np.array([hash_of(flat[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64))


def prefix(own: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles in the common order, so many that sets that reach 4/5 share one."""
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
        own = np.concatenate([own[~late], own[late]])
    return own[: _prefix_size(len(own))]


def _prefix_size(n):
    return n - (4 * n + 4) // 5 + 1


def node_of(text: Column) -> Column:
    """A long for each text; texts without words and nulls are 0."""
    return F.when(F.coalesce(text, F.lit("")).rlike(r"^\s*$"), F.lit(0).cast("long")).otherwise(F.xxhash64(text))


def _sampled(batches):
    for batch in batches:
        for part in slices(batch):
            found = [shingles(x) for x in texts_as_bytes(part)]
            nodes = np.repeat(part.column("node").to_numpy(zero_copy_only=False), [len(x) for x in found])
            yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64)), pa.array(nodes)], ["key", "node"])


def _counted(batches):
    """(key, n) of the keys that FREQUENT or more different nodes hold, from rows (key, node) sorted by key."""

    def made(keys, nodes):
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, n = np.unique(keys[fresh], return_counts=True)
        return pa.record_batch([pa.array(keys[n >= FREQUENT]), pa.array(n[n >= FREQUENT])], ["key", "n"])

    key, held = None, []
    for batch in batches:
        keys, nodes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(keys):
            continue
        start = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
        if held and keys[-1] != key:
            first = int(np.searchsorted(keys, key, "right"))
            yield made(np.full(sum(map(len, held)) + first, key), np.concatenate([*held, nodes[:first]]))
            if first < start:
                yield made(keys[first:start], nodes[first:start])
            held = []
        elif start:
            yield made(keys[:start], nodes[:start])
        key = keys[-1]
        held.append(np.unique(nodes[start:]))
    if held:
        yield made(np.full(sum(map(len, held)), key), np.concatenate(held))


def bitmap(own: np.ndarray) -> bytes:
    """A bit for each residue of the hashes, 1 if an odd number of them have it."""
    size = min(MAX_BITS, max(MIN_BITS, 1 << (len(own) - 1).bit_length()))
    return np.packbits(np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def nearest(sizes: np.ndarray, roots: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """Of each set the place of the nearest one by bitmaps that may be linked with it and has another root, or -1."""
    found, least, width = np.full(len(sizes), -1), np.full(len(sizes), np.inf), np.array([len(x) for x in bits])
    for w in np.unique(width):
        # sets of alike sizes have bitmaps of one width, or of two of which one is folded in halves
        own, wide = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        a = np.frombuffer(b"".join([bits[x] for x in own]), np.uint64).reshape(len(own), -1)
        halves = np.frombuffer(b"".join([bits[x] for x in wide]), np.uint64).reshape(len(wide), 2, a.shape[1])
        b, others = np.concatenate([a, halves[:, 0] ^ halves[:, 1]]), np.concatenate([own, wide])
        step = max(1, (1 << 20) // b.size)
        for start in range(0, len(own), step):
            some = own[start : start + step]
            differ = np.bitwise_count(a[start : start + step, None] ^ b[None]).sum(axis=2, dtype=np.int64)
            n, m = sizes[some][:, None], sizes[others][None]
            near = (9 * differ <= n + m) & (np.minimum(n, m) * 5 >= np.maximum(n, m) * 4) & (roots[some][:, None] != roots[others][None])
            far = np.where(near, differ / (n + m), np.inf)
            for x, y, at, low in ((some, others, far.argmin(axis=1), far.min(axis=1)), (others, some, far.argmin(axis=0), far.min(axis=0))):
                nearer = low < least[x]
                found[x[nearer]], least[x[nearer]] = y[at[nearer]], low[nearer]
    return found


def _prefixes(frequent):
    def run(batches):
        """(key, node, size) of each prefix's shingles, and a row with the bitmap of each text."""
        for batch in batches:
            for part in slices(batch):
                sizes, found, bits = [], [], []
                for x in texts_as_bytes(part):
                    own = shingles(x)
                    sizes.append(len(own))
                    bits.append(bitmap(own))
                    found.append(prefix(own, frequent.value) if len(own) else own)
                times = [len(x) for x in found]
                nodes = part.column("node").to_numpy(zero_copy_only=False)
                sizes, n = np.array(sizes, np.int32), sum(times)
                yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(nodes, times)), pa.array(np.repeat(sizes, times)), pa.nulls(n, pa.binary())], ["key", "node", "size", "bits"])
                yield pa.record_batch([pa.array(nodes), pa.array(nodes), pa.array(sizes), pa.array(bits, pa.binary())], ["key", "node", "size", "bits"])

    return run


def _groups(batches):
    """From rows sorted by key: (u, v, nu, nv) of small groups' pairs, (pivot, member, their sizes, key) of others."""

    def emit(key, nodes, sizes):
        nodes, first = np.unique(nodes, return_index=True)
        sizes = sizes[first].astype(np.int64)
        m = len(nodes)
        if m > SMALL:
            rows.append((np.full(m, nodes[0]), nodes, np.full(m, sizes[0]), sizes, np.full(m, key), np.zeros(m, bool)))
        elif m > 1:
            i, j = np.triu_indices(m, 1)
            near = np.minimum(sizes[i], sizes[j]) * 5 >= np.maximum(sizes[i], sizes[j]) * 4
            i, j = i[near], j[near]
            rows.append((nodes[i], nodes[j], sizes[i], sizes[j], np.zeros(len(i), np.int64), np.ones(len(i), bool)))

    def flush():
        if rows:
            u, v, nu, nv, keys, none = (np.concatenate(x) for x in zip(*rows))
            yield pa.record_batch([pa.array(u), pa.array(v), pa.array(nu.astype(np.int32)), pa.array(nv.astype(np.int32)), pa.array(keys, pa.int64(), mask=none)], ["u", "v", "nu", "nv", "key"])
            rows.clear()

    rows, key, held = [], None, []
    for batch in batches:
        keys, nodes, sizes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(keys):
            continue
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        if held and keys[0] != key:
            emit(key, *(np.concatenate(x) for x in zip(*held)))
            held = []
        many = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(keys)))
        for a, b in zip(starts[many].tolist(), ends[many].tolist()):
            if b == len(keys):  # may go on in the next batch
                held.append((nodes[a:b], sizes[a:b]))
                key = keys[a]
            elif a == 0 and held:
                emit(keys[a], *(np.concatenate(x) for x in zip(*held, (nodes[a:b], sizes[a:b]))))
                held = []
            else:
                emit(keys[a], nodes[a:b], sizes[a:b])
        yield from flush()
    if held:
        emit(key, *(np.concatenate(x) for x in zip(*held)))
    yield from flush()


def _grouped(batches):
    """The rows of _groups, and those with a bitmap as (node, null, size, null, null, bitmap)."""
    columns, aside = ["u", "v", "nu", "nv", "key", "bits"], []

    def rest():
        for batch in batches:
            aside.append(batch.filter(batch.column("bits").is_valid()))
            yield batch.filter(batch.column("bits").is_null()).select(["key", "node", "size"])

    def passed():
        for own in aside:
            n = own.num_rows
            yield pa.record_batch([own.column("node"), pa.nulls(n, pa.int64()), own.column("size"), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), own.column("bits")], columns)
        aside.clear()

    for found in _groups(rest()):
        yield from passed()
        yield pa.record_batch([*found.columns, pa.nulls(found.num_rows, pa.binary())], columns)
    yield from passed()


def _chunks(sizes: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of chunks of nodes sorted by size."""
    chunks, start, total = [], 0, 0
    for x, size in enumerate(sizes.tolist()):
        if x > start and (x - start == CHUNK or total + size > CHUNK_SHINGLES):
            chunks.append((start, x))
            start, total = x, 0
        total += size
    return [*chunks, (start, len(sizes))] if len(sizes) else []


def crossings(nodes: np.ndarray, sizes: np.ndarray, roots: np.ndarray) -> list[np.ndarray]:
    """Sets of a group's nodes in which each two nodes of unlike roots and alike sizes meet."""
    order = np.lexsort((nodes, sizes))
    nodes, sizes, roots = nodes[order], sizes[order], roots[order]
    found, number = np.unique(roots, return_inverse=True)
    if len(found) < 2:
        return []
    most = number == np.bincount(number).argmax()
    parts = [[(nodes[w][s:e], sizes[w][s], sizes[w][e - 1], set(number[w][s:e].tolist())) for s, e in _chunks(sizes[w])] for w in (~most, most)]
    pairs = [*itertools.combinations(parts[0], 2), *itertools.product(*parts)]
    out = [a[0] for a in parts[0] if len(a[3]) > 1]
    return out + [np.concatenate([a[0], b[0]]) for a, b in pairs if a[2] * 5 >= b[1] * 4 and b[2] * 5 >= a[1] * 4 and len(a[3] | b[3]) > 1]


def _crossed(batches):
    """(members) of the groups' crossings, from rows (key, node, size, root) sorted by key."""

    def made():
        for members in crossings(*(np.concatenate(x) for x in zip(*held))):
            yield pa.record_batch([pa.array([members.tolist()], pa.list_(pa.int64()))], ["members"])

    key, held = None, []
    for batch in batches:
        keys, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(keys):
            continue
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != key:
                yield from made()
                held = []
            key = keys[a]
            held.append([x[a:b] for x in rest])
    if held:
        yield from made()


def _sets(batches):
    for batch in batches:
        for part in slices(batch):
            found = [shingles(x).tobytes() for x in texts_as_bytes(part)]
            yield pa.record_batch([part.column("node"), pa.array(found, pa.binary())], ["node", "own"])


def linked(sets: list[np.ndarray]) -> Labels:
    """Components of the sets by links of similarity 4/5 or more; none of the sets is empty."""
    labels, m = Labels(len(sets)), len(sets)
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(number, kind="stable")
    holder = np.repeat(np.arange(m), size)[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(number))])
    for i in range(m - 1):
        if (labels.of == labels.of[i]).all():
            break
        if (labels.of[i + 1 :] == labels.of[i]).all():
            continue
        mine = number[ends[i] - size[i] : ends[i]]
        runs = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        both = np.bincount(holder[at], minlength=m)[i + 1 :]
        j = np.flatnonzero(9 * both >= 4 * (size[i] + size[i + 1 :])) + i + 1
        if len(j):
            labels.link(np.full(len(j), i), j)
    return labels


def _by_bitmaps(names: list[str]):
    """Pairs of longs from rows (gid, node, root, size, bits) sorted by gid.

    ("gid", "node"): the members that may be linked with one of another root;
    ("u", "v"): each of those and the nearest.
    """

    def run(batches):
        def made():
            nodes, roots, sizes, bits = (list(itertools.chain(*x)) for x in zip(*held))
            nodes = np.array(nodes, np.int64)
            to = nearest(np.array(sizes, np.int64), np.array(roots, np.int64), bits)
            u, v = nodes[to >= 0], nodes[to[to >= 0]]
            out.append((np.full(len(u), gid), u) if names[0] == "gid" else (np.minimum(u, v), np.maximum(u, v)))

        def flush():
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out)], names)
                out.clear()

        gid, held, out = None, [], []
        for batch in batches:
            gids = batch.column("gid").to_numpy(zero_copy_only=False)
            if not len(gids):
                continue
            rest = [batch.column(c).to_pylist() for c in ("node", "root", "size", "bits")]
            cuts = [0, *(np.flatnonzero(np.diff(gids)) + 1).tolist(), len(gids)]
            for a, b in zip(cuts, cuts[1:]):
                if held and gids[a] != gid:
                    made()
                    held = []
                gid = gids[a]
                held.append([x[a:b] for x in rest])
            yield from flush()
        if held:
            made()
        yield from flush()

    return run


def _verified(batches):
    """(u, v) from rows (gid, node, own) sorted by gid: spanning forests of each group's links."""

    def forest(group):
        nodes, sets = list(group), list(group.values())
        u, v = linked(sets).forest() if len(nodes) > 1 else ([], [])
        return pa.record_batch([pa.array([nodes[x] for x in u], pa.int64()), pa.array([nodes[x] for x in v], pa.int64())], ["u", "v"])

    gid, group = None, {}
    for batch in batches:
        for g, node, own in zip(*(c.to_pylist() for c in batch.columns)):
            if g != gid:
                yield forest(group)
                gid, group = g, {}
            group[node] = np.frombuffer(own, np.uint64)
    yield forest(group)


def _frequent(texts: DataFrame, scratch: Scratch) -> np.ndarray:
    share = min(1.0, max(1 / SHARE, SAMPLE / max(1, texts.count())))
    chosen = texts.where(F.xxhash64(F.lit("sample"), "node").bitwiseAND(F.lit((1 << 30) - 1)) < int(share * (1 << 30)) + 1)
    sampled = chosen.mapInArrow(_sampled, "key long, node long").repartition("key").sortWithinPartitions("key")
    counted = scratch.table(sampled.mapInArrow(_counted, "key long, n long"), "frequent")
    least, total = FREQUENT, 0
    for r in counted.groupBy("n").agg(F.count("*").alias("keys")).orderBy(F.desc("n")).collect():
        total += r.keys
        if total > MAX_FREQUENT:
            least = r.n + 1
            break
    return np.sort(counted.where(F.col("n") >= least).select("key").toArrow().column("key").to_numpy().view(np.uint64))


def _members(sets: DataFrame) -> DataFrame:
    return sets.select(F.xxhash64("members").alias("gid"), F.explode("members").alias("node"))


def _of_several_roots(sized: DataFrame, linked_yet: DataFrame) -> DataFrame:
    """(key, node, size, root) of the keys whose nodes don't have one root."""
    placed = sized.join(linked_yet, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    several = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    return placed.join(several, "key", "left_semi")


def _with_bitmaps(members: DataFrame, bits: DataFrame, linked_yet: DataFrame) -> DataFrame:
    placed = members.join(bits, "node").join(linked_yet, "node", "left").select("gid", "node", F.coalesce("root", "node").alias("root"), "size", "bits")
    return placed.repartition("gid").sortWithinPartitions("gid", "node")


def _links(sets: DataFrame, texts: DataFrame, scratch: Scratch, label: str, bits: DataFrame | None = None, linked_yet: DataFrame | None = None) -> DataFrame:
    """(u, v): spanning forests of the links among each row's members (array of nodes).

    With bits (node, size, bits) and linked_yet (node, root), only members that
    may be linked with one of another root are compared whole.
    """
    spark = texts.sparkSession
    members = _members(sets)
    if bits is not None:
        with arrow_rows(spark, 1024):
            members = scratch.table(_with_bitmaps(members, bits, linked_yet).mapInArrow(_by_bitmaps(["gid", "node"]), "gid long, node long"), f"{label}-members")
    else:
        members = scratch.table(members, f"{label}-members")
    nodes = scratch.table(members.select("node").distinct(), f"{label}-nodes")
    if nodes.count() <= BROADCAST_NODES:
        nodes = F.broadcast(nodes)
    needed = texts.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    with arrow_rows(spark, 128):
        found = members.join(needed.mapInArrow(_sets, "node long, own binary"), "node").select("gid", "node", "own")
        return scratch.table(found.repartition("gid").sortWithinPartitions("gid").mapInArrow(_verified, "u long, v long"), f"{label}-links")


def roots(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of each text of docs that is linked with another: root is its component's least node.

    Two texts are linked if their sets of shingles have a Jaccard similarity of
    0.8 or more; shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    texts = docs.select(node_of(F.col("text")).alias("node"), "text").where("node <> 0")
    similar = near_duplicates(texts.select(F.col("node").alias("doc_id"), "text"), SHINGLE, RADIUS)
    stars = similar.where("doc_id <> component_id").select(F.array("component_id", "doc_id").alias("members")).distinct()
    near = _links(stars, texts, scratch, "similar")
    linked_yet = scratch.table(components(near, Scratch(spark, "near-copies-similar")), "similar-roots")
    frequent = spark.sparkContext.broadcast(_frequent(texts, scratch))
    keys = texts.mapInArrow(_prefixes(frequent), "key long, node long, size int, bits binary")
    groups = scratch.table(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_grouped, "u long, v long, nu int, nv int, key long, bits binary"), "groups")
    bits = scratch.table(groups.where("bits IS NOT NULL").select(F.col("u").alias("node"), F.col("nu").alias("size"), "bits").dropDuplicates(["node"]), "bits")
    # of the prefixes' shingles a pair shares n; behind them it can share what is left of either set
    behind = F.greatest(*(F.floor(F.col(c) * 4 / 5 + 0.9).cast("long") - 1 for c in ("nu", "nv")))
    pairs = groups.where("key IS NULL AND bits IS NULL").groupBy("u", "v", "nu", "nv").agg(F.count("*").alias("n")).where(9 * (F.col("n") + behind) >= 4 * (F.col("nu") + F.col("nv")))
    large = groups.where("key IS NOT NULL")
    to_pivot = large.where("u <> v AND least(nu, nv) * 5 >= greatest(nu, nv) * 4").select("u", "v").distinct()
    pairs = pairs.select("u", "v").union(to_pivot)
    for end in ("u", "v"):
        pairs = pairs.join(linked_yet.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    pairs = pairs.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v"))
    near = near.union(_links(pairs.select(F.array("u", "v").alias("members")), texts, scratch, "prefix", bits, linked_yet))
    if large.isEmpty():
        return components(near, scratch)
    linked_yet = scratch.table(components(near, Scratch(spark, "near-copies-prefix")), "prefix-roots")
    sized = large.select("key", F.col("v").alias("node"), F.col("nv").alias("size"))
    placed = _of_several_roots(sized, linked_yet)
    with arrow_rows(spark, 1024):
        asked = _with_bitmaps(placed.select(F.col("key").alias("gid"), "node"), bits, linked_yet)
        closest = scratch.table(asked.mapInArrow(_by_bitmaps(["u", "v"]), "u long, v long").distinct(), "nearest")
    near = near.union(_links(closest.select(F.array("u", "v").alias("members")), texts, scratch, "nearest"))
    linked_yet = scratch.table(components(near, Scratch(spark, "near-copies-nearest")), "nearest-roots")
    placed = _of_several_roots(sized, linked_yet).repartition("key").sortWithinPartitions("key")
    rest = scratch.table(placed.mapInArrow(_crossed, "members array<long>").distinct(), "crossings")
    scratch.drop("groups")
    if rest.isEmpty():
        return linked_yet
    return components(near.union(_links(rest, texts, scratch, "large", bits, linked_yet)), scratch)


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies.

    It has the smallest doc_id, nulls last, then the smallest hash of its text,
    then the least values.  Texts without words are copies of one another.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    own = docs.select("doc_id", node_of(F.col("text")).alias("node")).groupBy("doc_id", "node").agg(F.count("*").alias("n"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "n")
    nodes = own.groupBy("node").agg(F.min(place).alias("least"))
    labelled = nodes.join(roots(docs, scratch), "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("m"))
    kept = scratch.table(least.select(F.col("m.doc_id").alias("id"), F.col("m.node").alias("of"), F.col("m.n").alias("copies")), "kept")
    rows = docs.select(F.struct(*docs.columns).alias("d"), F.col("doc_id").alias("own"), node_of(F.col("text")).alias("node"))
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("node") == F.col("of"))
    found = rows.join(kept.where("copies = 1"), same, "left_semi").select("d.*")
    repeats = kept.where("copies > 1")
    if repeats.isEmpty():
        return found
    one = rows.join(repeats, same).groupBy("id", "of").agg(F.min("d").alias("m"))
    return found.unionByName(one.select("m.*"))
