"""Token ids in a binary file format, with short-document access.

A dataset is a folder of shards, each a ``.tok`` file of zstandard frames, and
``manifest.json``.  Every document is one frame, compressed by itself against a
dictionary that all shards share; a frame holds the document's ids as little-endian
unsigned integers of the manifest's width.  A shard ends in its index and a
fixed footer:

    frames | index | footer
    index:  int64 doc_ids, int64 frame ends, int64 id counts, uint8 doc_id is null
    footer: 8 bytes magic, int64 documents, int64 index start, 32 bytes SHA-256
            of the dictionary

To read one document, read the footer and index, then its frame.  Shards are
written under a temporary name and renamed, so a task that runs twice leaves
one whole file.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._shared import shared_folder, slices, texts_as_bytes, worker_state

MAGIC = b"VMTOKID1"
FOOTER, FOOTER_BYTES = "<8sqq32s", 56
END_ID = 2
#: The dictionary is trained on at most so many documents of up to so many characters, chosen by hash.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES, LEVEL = 1000, 1 << 15, 64 << 10, 3
#: A memo of more chunks or bytes keeps half of that, of chunks of up to MEMO_CHUNK bytes with their ids.
MEMO_ENTRIES, MEMO_BYTES, MEMO_CHUNK = 400_000, 16 << 20, 1 << 10
#: So many new chunks are encoded as one text.
TOGETHER = 100
#: What no regular expression engine's white space goes beyond.
_SPACE_LIKE = "\\s\x1c-\x1f\x85\u180e\u200b-\u200d\u2060\ufeff"
_UNSAFE_SPACE = re.compile(f" (?:[{_SPACE_LIKE}]|\\Z)")
_SAFE_SPACE = re.compile(f" (?![{_SPACE_LIKE}]|\\Z)")


class Encoder:
    """Ids of whole texts by the tokenizers library, remembering chunks.

    The byte-level pre-tokenizer always parts a text before a space that no
    white space follows, and BPE works on each of its pieces by itself.  So a
    text's ids are those of its chunks, cut at such spaces; the ids of a chunk
    that came before are looked up, others come from the library.  Arrow splits
    the texts, looks each distinct chunk of a call up once, and joins the ids; the
    memo is an array of chunks and one of their ids.  A full memo keeps what was
    used last.  Texts with a special token's string, and all texts of tokenizers
    of another kind, are encoded as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        kind = json.loads(self.tok.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.special = [x["content"] for x in kind.get("added_tokens", [])]
        self.by_chunk = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not kind.get("normalizer")
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        #: Whether a token begins with a space, as the first of each chunk does and no other.
        self.first = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.first[i] = token[:1] == "\u0120"
        self.memo, self.ids, self.used, self.calls = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64), 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_chunks(self, chunks: list[str]) -> list[bytes]:
        """Those without a space are encoded together, and parted again at the tokens that begin with one."""
        other = [i for i, c in enumerate(chunks) if " " in c]
        found = dict(zip(other, self._ids([chunks[i][1:] if chunks[i][0] == " " else f" {chunks[i]}" for i in other])))
        plain, out = [c for c in chunks if " " not in c] if other else chunks, []
        for a in range(0, len(plain), TOGETHER):
            group = plain[a : a + TOGETHER]
            ids = np.frombuffer(self._ids([" " + " ".join(group)])[0], self.dtype)
            starts = (np.flatnonzero(self.first[ids]) * self.width).tolist()
            if len(starts) == len(group) and not starts[0]:
                raw = ids.tobytes()
                out += [raw[i:j] for i, j in zip(starts, [*starts[1:], len(raw)])]
            else:
                out += self._ids([f" {c}" for c in group])
        rest = iter(out)
        return [found[i] if i in found else next(rest) for i in range(len(chunks))] if other else out

    def _remembered(self, chunks: pa.Array) -> pa.Array:
        """The ids of distinct chunks, from the memo or else from the library."""
        found = pc.index_in(chunks, self.memo)
        new = found.is_null()
        fresh, new = chunks.filter(new), new.to_numpy(zero_copy_only=False)
        made = pa.array(self._ids_of_chunks(fresh.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        place = found.fill_null(0).to_numpy().astype(np.int64)
        self.calls += 1
        self.used[place[~new]] = self.calls
        place[new] = len(self.memo) + np.arange(len(fresh))
        memo, ids, used = pa.concat_arrays([self.memo, fresh]), pa.concat_arrays([self.ids, made]), np.concatenate([self.used, np.full(len(fresh), self.calls)])
        out = ids.take(pa.array(place))
        if len(memo) > MEMO_ENTRIES or memo.nbytes + ids.nbytes > MEMO_BYTES:
            sizes = pc.binary_length(memo).to_numpy() + pc.binary_length(ids).to_numpy() + 16  # and two offsets
            last = np.argsort(-used, kind="stable")
            last = last[sizes[last] <= MEMO_CHUNK][: MEMO_ENTRIES // 2]
            kept = np.sort(last[np.cumsum(sizes[last]) <= MEMO_BYTES // 2])
            memo, ids, used = memo.take(pa.array(kept)), ids.take(pa.array(kept)), used[kept]
        self.memo, self.ids, self.used = memo, ids, used
        return out

    def _joined(self, lists: pa.ListArray) -> list[bytes]:
        """The ids of each list of chunks.  The first chunk has no space before it, so its key has one more."""
        bounds, values = lists.offsets.to_numpy(), lists.values
        first = np.zeros(len(values), bool)
        first[bounds[:-1]] = True
        begin = pa.array([f" {c}" for c in values.filter(pa.array(first)).to_pylist()], pa.large_string()).dictionary_encode()
        later = pc.if_else(pa.array(first), pa.scalar(None, values.type), values).dictionary_encode()
        at = later.indices.fill_null(0).to_numpy().astype(np.int64)
        at[bounds[:-1]] = len(later.dictionary) + begin.indices.to_numpy()
        ids = self._remembered(pa.concat_arrays([later.dictionary.cast(pa.large_string()), begin.dictionary])).take(pa.array(at))
        ends, data = np.frombuffer(ids.buffers()[1], np.int64, len(at) + 1)[bounds].tolist(), memoryview(ids.buffers()[2] or b"")
        return [data[i:j].tobytes() for i, j in zip(ends, ends[1:])]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out, plain, spaced = [b""] * len(texts), {}, {}
        for i, raw in enumerate(texts):
            text = raw.decode("utf-8")
            if not self.by_chunk or any(s in text for s in self.special):
                out[i] = self._ids([text])[0]
            elif _UNSAFE_SPACE.search(text):
                spaced[i] = _SAFE_SPACE.split(text)
            else:
                plain[i] = text
        if plain or spaced:
            split = pc.split_pattern(pa.array(plain.values(), pa.string()), " ")
            for i, ids in zip([*plain, *spaced], self._joined(pa.concat_arrays([split, pa.array(spaced.values(), split.type)]))):
                out[i] = ids
        return out


def encoder(path: str) -> Encoder:
    state = worker_state()
    if ("encoder", path) not in state:
        state["encoder", path] = Encoder(path)
    return state["encoder", path]


def _encoded(tokenizer: str, end_id: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                enc = encoder(tokenizer)
                end = np.array([end_id], enc.dtype).tobytes()
                yield pa.record_batch([pa.array([x + end for x in enc.encode(texts_as_bytes(part))], pa.binary())], ["ids"])

    return run


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> bytes:
    """A dictionary from at most sample_docs documents of up to sample_chars characters, the same in each run.

    Only this fit is bounded: all documents are compressed against it, whole.
    It is empty if there are too few samples or they are too small.
    """
    import zstandard

    share = min(1.0, 4 * sample_docs / max(1, docs.count()))
    place = F.xxhash64(F.lit("dictionary"), "doc_id", "text")
    eligible = docs.where(F.length("text") <= sample_chars).select("text", place.alias("place"))
    chosen = eligible.where(F.col("place").bitwiseAND(F.lit((1 << 30) - 1)) < int(share * (1 << 30)) + 1).orderBy("place").limit(sample_docs).select("text")
    samples = [r.ids for r in chosen.mapInArrow(_encoded(tokenizer, end_id), "ids binary").toLocalIterator()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes, level: int = LEVEL):
    import zstandard

    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _write_shard(folder: str, tokenizer: str, end_id: int, dictionary: bytes, digest: bytes):
    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        name, partial = f"{root}/{shard:06d}.tok", f"{root}/.{shard:06d}.{uuid.uuid4().hex}"
        ids, ends, counts, nulls, at = [], [], [], [], 0
        enc = out = compress = None
        for batch in batches:
            for part in slices(batch):
                if out is None:
                    enc, compress = encoder(tokenizer), _compressor(dictionary).compress
                    out = store.open_output_stream(partial)
                    end = np.array([end_id], enc.dtype).tobytes()
                doc_ids = part.column("doc_id")
                nulls += doc_ids.is_null().to_pylist()
                ids += doc_ids.fill_null(0).to_pylist()
                for raw in enc.encode(texts_as_bytes(part)):
                    frame = compress(raw + end)
                    out.write(frame)
                    at += len(frame)
                    ends.append(at)
                    counts.append(len(raw) // enc.width + 1)
        if out is None:
            return
        for column, kind in ((ids, "<i8"), (ends, "<i8"), (counts, "<i8"), (nulls, "u1")):
            out.write(np.array(column, kind).tobytes())
        out.write(struct.pack(FOOTER, MAGIC, len(ids), at, digest))
        out.close()
        store.move(partial, name)
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([name.rsplit("/", 1)[1]]), pa.array([len(ids)], pa.int64()), pa.array([sum(counts)], pa.int64()), pa.array([enc.width], pa.int32())], ["shard", "file", "docs", "tokens", "width"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> dict:
    """Write docs' ids to folder, in ascending doc_id order; the manifest.

    Null texts are empty, and hold the end id only.  Null doc_ids come first;
    rows that repeat a doc_id stand side by side, by the hash of their text.
    The manifest has one entry a shard.
    """
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    own = docs.select("doc_id", "text")
    dictionary = train_dictionary(own, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).digest()
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = own.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    rows = ordered.mapInArrow(_write_shard(folder, tokenizer, end_id, dictionary, digest), "shard int, file string, docs long, tokens long, width int").collect()
    shards, start = [], 0
    for r in sorted(rows, key=lambda r: r.shard):
        shards.append({"file": r.file, "docs": r.docs, "tokens": r.tokens, "start": start})
        start += r.tokens
    manifest = {"format": MAGIC.decode(), "width": rows[0].width if rows else 4, "end_id": end_id, "dictionary_sha256": digest.hex(), "documents": sum(s["docs"] for s in shards), "tokens": start, "shards": shards}
    for name, data in (("dictionary.zstd", dictionary), ("manifest.json", json.dumps(manifest).encode())):
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(data)
    return manifest


class Shard:
    """Random access to one shard's documents."""

    def __init__(self, store, path: str, dictionary: bytes, width: int) -> None:
        self.file = store.open_input_file(path)
        size = self.file.size()
        magic, n, at, digest = struct.unpack(FOOTER, self.file.read_at(FOOTER_BYTES, size - FOOTER_BYTES))
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} isn't a shard of this dictionary")
        index = self.file.read_at(25 * n, at)
        self.doc_ids, ends, self.counts = (np.frombuffer(index, "<i8", n, 8 * n * i) for i in range(3))
        self.nulls = np.frombuffer(index, "u1", n, 24 * n).astype(bool)
        self.bounds = np.concatenate([[0], ends])
        self.dtype, self.decompress = np.dtype(f"<u{width}"), _decompressor(dictionary).decompress

    def ids(self, i: int) -> np.ndarray:
        a, b = int(self.bounds[i]), int(self.bounds[i + 1])
        return np.frombuffer(self.decompress(self.file.read_at(b - a, a)), self.dtype)


def open_tokens(folder: str) -> tuple[dict, bytes]:
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    with store.open_input_file(f"{root}/dictionary.zstd") as f:
        return manifest, f.read()


def read_tokens(spark: SparkSession, folder: str, digest_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files, one task a shard.

    start counts the ids of all documents before it; ids_crc32 is that of the
    ids as little-endian unsigned 32-bit integers.
    """
    manifest, dictionary = open_tokens(folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>")
    if not manifest["shards"]:
        return spark.createDataFrame([], schema)
    width = manifest["width"]

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(store, f"{root}/{row['file']}", dictionary, width)
                n = len(shard.counts)
                starts = row["start"] + np.concatenate([[0], np.cumsum(shard.counts)[:-1]])
                for a in range(0, n, 1000):
                    b = min(n, a + 1000)
                    ids = [shard.ids(i) for i in range(a, b)]
                    columns = [pa.array(shard.doc_ids[a:b], pa.int64(), mask=shard.nulls[a:b]), pa.array(starts[a:b], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                    if not digest_only:
                        columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *([] if digest_only else ["ids"])])

    shards = spark.createDataFrame([(s["file"], s["start"]) for s in manifest["shards"]], "file string, start long")
    return shards.repartition(len(manifest["shards"])).mapInArrow(run, schema)


def tokens_folder(spark: SparkSession) -> str:
    """A new folder for token files, which stay."""
    return f"{shared_folder(spark)}/vocabmill-tokens-{uuid.uuid4().hex}"
