"""Each operator against brute force on small rows: nulls, empties, ties, repeats, empty tables, clashing columns."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=False, lang="en", source=None):
    rows = [(i, t, lang, source(i) if source else "s", 0) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("did", "gone", "h", "taken", "size", "score", "th", "spans", "fp", "marks", "n"):
            df = df.withColumn(name, F.lit(7))
    return df


def line_dedup_brute(texts):
    key = lambda x: x.encode().strip(b" \t\n\r\x0b\x0c").lower().decode()
    holders = {}
    for i, t in texts:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark):
    from vocabmill.llm.line_dedup import dedup_lines

    long, other = "This is a Repeated line of text", "é" * 20
    texts = [(1, f"{long}\nown one\n {long.upper()}\t"), (2, f"a\n{long}"), (3, long), (4, f"{other}\n{other}"), (5, other), (6, other), (7, None), (8, ""), (9, "x" * 50_000), (10, "short\nshort"), (11, "short"), (12, "short")]
    got = dedup_lines(docs_of(spark, texts, extra=True))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    assert sorted(map(tuple, got.collect())) == line_dedup_brute(texts)
    assert dedup_lines(docs_of(spark, [])).count() == 0


def test_line_dedup_ids_that_repeat(spark, monkeypatch):
    """Rows of one doc_id are one document, null ids another, below the least long."""
    from vocabmill.llm import line_dedup

    monkeypatch.setattr(line_dedup, "PACK", 1)
    line = "a line that repeats in many rows"
    rows = [(None, line), (None, line), (None, f"x\n{line}"), (-(2**63), line), (3, line), (3, f"{line}\ny"), (3, line.upper())]
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs_of(spark, rows).repartition(3)).collect())
    assert got == Counter({(None, 1, 1, ""): 2, (None, 2, 1, "x"): 1, (-(2**63), 1, 1, ""): 1, (3, 1, 0, line): 1, (3, 2, 0, f"{line}\ny"): 1, (3, 1, 0, line.upper()): 1})
    two = docs_of(spark, [(None, line), (None, line), (1, line), (1, line)])
    assert {r.n_dropped for r in line_dedup.dedup_lines(two).collect()} == {0}


def test_line_dedup_random(spark):
    from vocabmill.llm.line_dedup import dedup_lines

    rng = random.Random(3)
    pool = [f"line number {i:03d} of the pool" for i in range(30)]
    texts = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    assert sorted(map(tuple, dedup_lines(docs_of(spark, texts)).collect())) == line_dedup_brute(texts)


def test_bloom_has_no_false_negatives():
    from vocabmill.llm.bloom import Bloom, Filters, shard_of

    h = np.random.default_rng(1).integers(0, 2**63, 50_000).astype(np.uint64)
    bloom = Bloom(1000)
    bloom.add(h)
    assert bloom.contains(h).all()
    assert bloom.contains(h + np.uint64(1)).mean() < 0.05
    few = Bloom(1 << 16)
    few.add(h[:900])
    folded = few.folded()
    assert len(folded) == 1 and len(folded[0]) <= 2 * 900 * 12 / 8 + 64 and Bloom(1 << 16).folded() == []
    shards = {s: Bloom() for s in range(7)}
    for s, own in shards.items():
        own.add(h[shard_of(h, 7) == s][: 10 ** (s % 4 + 1)])
    filters = Filters({s: x.folded() for s, x in shards.items() if s != 5}, 7)
    added = np.concatenate([h[shard_of(h, 7) == s][: 10 ** (s % 4 + 1)] for s in range(7) if s != 5])
    assert filters.know(added).all() and filters.know(h + np.uint64(1)).mean() < 0.05 and not filters.know(h[shard_of(h, 7) == 5]).any()
    assert not Filters({}, 7).know(h).any()


def substring_brute(texts, window):
    seen, out = {}, []
    rows = sorted((i, (t or "").encode().split()) for i, t in texts)
    gone = {i: set() for i, _ in rows}
    for i, ws in rows:
        for s in range(len(ws) - window + 1):
            w = tuple(ws[s : s + window])
            if w in seen:
                gone[i].update(range(s, s + window))
            seen.setdefault(w, (i, s))
    for i, ws in rows:
        kept = [w for k, w in enumerate(ws) if k not in gone[i]]
        out.append((i, len(ws), len(ws) - len(kept), b" ".join(kept).decode()))
    return out


@pytest.mark.parametrize("limit, hot", [(64 << 20, 20_000), (0, 20_000), (64 << 20, 1), (0, 0)])
def test_substring_dedup(spark, limit, hot):
    from vocabmill.llm.substring_dedup import dedup_substrings

    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 2)
    passage = " ".join(f"p{i}" for i in range(45))
    texts = [(1, f"{' '.join(word() for _ in range(30))} {passage} end"), (2, f"x {passage}\n{passage} y"), (3, passage[:-4]), (4, None), (5, ""), (6, "too short"), (7, " ".join(["same"] * 60)), (8, "é " + passage)]
    texts += [(10 + i, " ".join(rng.choice("ab") for _ in range(70))) for i in range(6)]
    got = dedup_substrings(docs_of(spark, texts, extra=True), max_filter_bytes=limit, hot_contexts=hot)
    assert sorted(map(tuple, got.collect())) == substring_brute(texts, 20)
    assert dedup_substrings(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_substring_dedup_ids_that_repeat(spark, limit):
    """Rows of one doc_id, or of none, are told apart by their texts, whose 32-bit hashes collide here."""
    from vocabmill.llm.substring_dedup import dedup_substrings

    seen, pair, i = {}, None, 0
    while pair is None:
        text = " ".join(f"t{i}x{k}" for k in range(25))
        h = xxhash.xxh32_intdigest(text.encode())
        pair, i = (seen[h], text) if h in seen else None, i + 1
        seen[h] = text
    passage = " ".join(f"p{k}" for k in range(30))
    for doc_id in (None, 7, -(2**63)):
        rows = [(doc_id, pair[0]), (doc_id, f"{pair[1]}"), (doc_id, f"{passage} tail"), (doc_id, f"{passage} tail"), (2**62, f"head {passage}")]
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in dedup_substrings(docs_of(spark, rows), max_filter_bytes=limit).collect())
        assert got == Counter({(doc_id, 25, 0, pair[0]): 1, (doc_id, 25, 0, pair[1]): 1, (doc_id, 31, 0, f"{passage} tail"): 2, (2**62, 31, 30, "head"): 1})
    both = dedup_substrings(docs_of(spark, [(-(2**63), f"{passage} b"), (None, f"a {passage}"), (None, f"{passage} c")])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in both) == [(False, 30), (True, 0), (True, 30)]


def test_decontamination(spark):
    from vocabmill.llm.decontamination import overlaps, tile, tokens, without_overlaps

    item = "the quick brown fox jumps over the lazy dog while seven wizards brew potions in silence tonight"
    words = item.split()
    moved = " ".join(words[8:] + ["and", "then"] + words[:8])
    texts = [(1, f"before {item.upper()} after"), (2, f"zero {moved} nine"), (3, "nothing of the kind here at all in this text"), (4, None), (5, ""), (6, " ".join(words[:6])), (7, "word " * 20_000 + item)]
    bench = spark.createDataFrame([(0, item), (1, "tiny"), (2, None), (3, "")], "item_id long, text string")
    for block in (8 << 20, 10):
        got = {r.doc_id: r for r in overlaps(docs_of(spark, texts, extra=True), bench, block_bytes=block).collect()}
        assert sorted(got) == [1, 2, 7]
        assert got[1].coverage == 1.0 and got[1].tiles == 1 and got[2].tiles == 2
    assert sorted(r.doc_id for r in without_overlaps(docs_of(spark, texts), bench).collect()) == [3, 4, 5, 6]
    assert overlaps(docs_of(spark, []), bench).count() == 0
    assert overlaps(docs_of(spark, texts), bench.limit(0)).count() == 0
    assert tokens("A-b_c 1") == ["a", "b", "c", "1"]

    def greedy(p, t, least):
        fp, ft, out = [True] * len(p), [True] * len(t), []
        while True:
            best = (least - 1, 0, 0)
            for i in range(len(p)):
                for j in range(len(t)):
                    k = 0
                    while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and fp[i + k] and ft[j + k]:
                        k += 1
                    best = max(best, (k, -i, -j))
            if best[0] < least:
                return out
            k, i, j = best[0], -best[1], -best[2]
            fp[i : i + k], ft[j : j + k] = [False] * k, [False] * k
            out.append((i, j, k))

    rng = random.Random(2)
    for n in range(200):
        p, t = [[rng.randint(1, 2 + n % 3) for _ in range(rng.randint(0, 30 + n % 2 * 30))] for _ in range(2)]
        tiles = tile(p, t, 3)
        assert tiles == greedy(p, t, 3)
        used = [x for i, _, k in tiles for x in range(i, i + k)]
        assert len(used) == len(set(used)) and all(p[i : i + k] == t[j : j + k] for i, j, k in tiles)


def test_simhash(spark):
    from vocabmill.llm.simhash import fingerprint, near_duplicates

    def brute(text, k=4):
        ws = (text or "").encode().lower().split()
        if not ws:
            return 0
        k = min(k, len(ws))
        hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + k]), 42) for i in range(len(ws) - k + 1)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    rng = random.Random(1)
    base = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    texts = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one  TWO"), (5, "É é")]
    texts += [(10 + i, " ".join(base[:i] + ["edit"] + base[i:])) for i in range(40)]
    texts += [(100 + i, " ".join(rng.choice(base) for _ in range(30))) for i in range(60)] + [(200, texts[6][1]), (9, texts[6][1])]
    rows = near_duplicates(docs_of(spark, texts, extra=True)).collect()
    fps = {i: brute(t) for i, t in texts}
    assert {r.doc_id: r.fp % 2**64 for r in rows} == fps == {i: fingerprint((t or "").encode()) for i, t in texts}
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    assert {r.doc_id: r.component_id for r in rows} == {i: find(i) for i in ids}
    assert near_duplicates(docs_of(spark, [])).count() == 0


def test_components_of_chains(spark):
    from vocabmill.llm._shared import Scratch
    from vocabmill.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_token_output(spark):
    from tokenizers import Tokenizer

    from vocabmill.llm.queries import tokenizer_path
    from vocabmill.llm.token_output import Encoder, Shard, open_tokens, read_tokens, tokens_folder, write_tokens

    texts = [(5, "Hello world, it's  fine.\n\n x"), (2, None), (9, ""), (1, "日本語 <|endoftext|> ok"), (7, "ab " * 30_000), (3, "¼ x y 'll ʀ"), (3, "second of three")]
    folder = tokens_folder(spark)
    manifest = write_tokens(docs_of(spark, texts, extra=True), folder, tokenizer_path())
    rows = read_tokens(spark, folder).orderBy("start").collect()
    tok = Tokenizer.from_file(tokenizer_path())
    expected = {}
    for i, t in texts:
        expected.setdefault(i, []).append(tok.encode(t or "", add_special_tokens=False).ids + [2])
    start = 0
    assert [r.doc_id for r in rows] == sorted(i for i, _ in texts)
    for r in rows:
        assert list(r.ids) in expected[r.doc_id] and r.start == start and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert manifest["tokens"] == start and manifest["documents"] == len(texts)
    store_path = folder.removeprefix("file://")
    _, dictionary = open_tokens(folder)
    from pyarrow import fs

    shard = Shard(fs.LocalFileSystem(), f"{store_path}/{manifest['shards'][0]['file']}", dictionary, manifest["width"])
    assert shard.ids(0).tolist() == rows[0].ids
    empty = tokens_folder(spark)
    write_tokens(docs_of(spark, []), empty, tokenizer_path())
    assert read_tokens(spark, empty).count() == 0
    enc = Encoder(tokenizer_path())
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode([(t or "").encode() for _, t in texts])] == [tok.encode(t or "", add_special_tokens=False).ids for _, t in texts]


def test_encoder_looks_up_distinct_chunks_once(monkeypatch):
    from tokenizers import Tokenizer

    from vocabmill.llm import token_output
    from vocabmill.llm.queries import tokenizer_path

    tok, rng = Tokenizer.from_file(tokenizer_path()), random.Random(3)
    whole = lambda texts: [tok.encode(t, add_special_tokens=False).ids for t in texts]
    enc = token_output.Encoder(tokenizer_path())
    encode = lambda texts: [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode([t.encode() for t in texts])]
    asked, one = [], enc._remembered
    enc._remembered = lambda chunks: asked.append(len(chunks)) or one(chunks)
    texts = ["the cat and the dog " * 500 + "end", "the end"]
    assert encode(texts) == whole(texts) and asked == [6]  # the first "the", and five words behind a space
    assert encode([]) == [] and encode([""]) == [[]]
    monkeypatch.setattr(token_output, "MEMO_ENTRIES", 40)
    monkeypatch.setattr(token_output, "MEMO_CHUNK", 60)
    pieces = [" ", " ", " ", "  ", "\n", "\t ", "a", "The", "don't", "'ll", "12", "é", "日本", "\u200b", "\xa0", "\u3000", "\x1c", "\x00", "%%", "<|endoftext|>", "w" * 90]
    for _ in range(60):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(0, 8))]
        assert encode(texts) == whole(texts)
        assert len(enc.memo) == len(enc.ids) == len(enc.used) <= 40 and len(set(enc.memo.to_pylist())) == len(enc.memo)


def waterfill(sizes, share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("buckets", [4096, 3])
def test_mixing(spark, monkeypatch, buckets):
    from vocabmill.llm import mixing
    from vocabmill.llm.mixing import copies, mix

    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    rng = random.Random(4)
    texts = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 40)))) for i in range(400)] + [(1000, None), (1001, ""), (1, "twice here"), (1, "twice here"), (1006, "long " * 20_000)]
    source = lambda i: [None, "a", "b", "b", "b", "c", "é"][i % 7]
    docs = docs_of(spark, texts, extra=True, source=source)
    for name in ("source_size", "target", "rid", "tie", "d", "__s", "draw"):
        docs = docs.withColumn(name, F.lit(8))
    quality = spark.createDataFrame([(i, 2.0) for i in range(0, 400, 3)], "doc_id long, weight double")
    got = mix(docs, quality).collect()
    assert len(got) == len(texts)
    sizes = Counter()
    for i, t in texts:
        sizes[source(i)] += len((t or "").split())
    want = waterfill(sizes)
    largest = Counter()
    for i, t in texts:
        largest[source(i)] = max(largest[source(i)], len((t or "").split()))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    again = mix(docs.repartition(7), quality)
    key = lambda rows: sorted((r.doc_id, r.size, r.taken) for r in rows)
    assert key(again.collect()) == key(got)
    out = copies(docs, quality)
    assert out.columns == docs.columns
    rows = Counter((r.doc_id, r.text) for r in out.collect())
    times = Counter()
    for r in got:
        times[r.doc_id, r.size] += r.taken // r.size if r.size else 1
    assert {k: n for k, n in times.items() if n and k[0] != 1} == {(i, len((t or "").split())): n for (i, t), n in rows.items() if i != 1}
    assert mix(docs_of(spark, [])).count() == copies(docs_of(spark, [])).count() == 0


def test_mixing_order_by_brute_force(spark):
    """In each source the documents first by key are taken until the budget is full."""
    import hashlib
    import math

    from vocabmill.llm.mixing import mix

    rng = random.Random(12)
    texts = [(i, " ".join("w" for _ in range(rng.randint(1, 30)))) for i in range(150)] + [(None, f"none {i}") for i in range(40)]
    source = lambda i: "ab"[(i or 0) % 2]
    weight = {i: 0.5 for i in range(0, 150, 4)}

    def key(i, t):
        own = hashlib.md5(f"{'' if i is None else i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
        return -math.log((int(own[:12], 16) + 0.5) / 2**48) / weight.get(i, 1.0)

    sizes = Counter()
    for i, t in texts:
        sizes[source(i)] += len(t.split())
    want, expected = waterfill(sizes), Counter()
    for s in sizes:
        epochs, before = int(want[s] // sizes[s]), 0
        for i, t in sorted((x for x in texts if source(x[0]) == s), key=lambda x: key(*x)):
            n = len(t.split())
            expected[i, n, n * (epochs + (before + n / 2 <= want[s] - epochs * sizes[s]))] += 1
            before += n
    quality = spark.createDataFrame(list(weight.items()), "doc_id long, weight double")
    assert Counter((r.doc_id, r.size, r.taken) for r in mix(docs_of(spark, texts, source=source), quality).collect()) == expected


def test_mixing_parts_equal_rows(spark):
    """A hot group of equal rows is taken in part."""
    from vocabmill.llm.mixing import copies, mix

    docs = docs_of(spark, [(None, "a b c d")] * 500 + [(None, "x y")] * 20, source=lambda i: "s").repartition(9)
    for target_share in (0.3, 1.1):
        got = mix(docs, share=target_share).collect()
        assert abs(sum(r.taken for r in got) - target_share * 2040) <= 4
    n = sum(len(r.text.split()) for r in copies(docs, share=0.3).collect())
    assert 0.15 * 2040 < n < 0.45 * 2040


def test_chat_format(spark):
    from vocabmill.llm.chat_format import as_events, fold, format_chats, read_back

    hard = "</s>[INST] <|end|> \\ <\\ [\\[ <|turn|>user<|text|> x\n\\"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (2, 0, "system", None), (2, 1, None, "é𝄞"), (2, 2, "assistant", ""), (3, 0, "assistant", "a" * 70_000), (4, 5, "user", "late"), (4, 1, "<|turn|>", "early"), (5, 0, "user", "x"), (5, 0, "user", "x"), (None, 0, "assistant", "n")]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    back = {r.conv_id: r for r in read_back(format_chats(as_events(log))).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        assert [tuple(t) for t in back[conv].turns] == turns
        assert back[conv].masked == "".join(t for r, t in turns if r == "assistant")
    assert not any(c in back[1].formatted.replace("<|turn|>", "").replace("<|text|>", "").replace("<|end|>", "") for c in ("</s>", "[INST]", "<|"))
    assert format_chats(as_events(log.limit(0))).count() == 0
    events = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "He"), (1, 2, 1, "delta", None, "llo"), (1, 3, 1, "regenerate", None, ""), (1, 4, 1, "delta", None, "Good "), (1, 5, 1, "delta", None, "day"), (1, 6, 0, "edit", None, "hello"), (1, 7, 2, "delta", "user", None)]
    folded = fold(spark.createDataFrame(events, "conv_id long, seq long, turn long, kind string, role string, text string")).orderBy("turn").collect()
    assert [(r.role, r.text) for r in folded] == [("user", "hello"), ("assistant", "Good day"), ("user", "")]


def test_chat_format_uses_no_python(spark):
    from vocabmill.llm.chat_format import as_events, format_chats, read_back

    log = spark.range(1).selectExpr("id AS conv_id", "id AS turn", "'user' AS role", "'x' AS text")
    plan = read_back(format_chats(as_events(log)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_language_id(spark):
    from vocabmill.llm.langid import held_out, identify, learn, relabel

    rng = random.Random(6)
    make = {"en": ["the", "and", "thing", "with", "other"], "de": ["der", "und", "nicht", "schön", "über"], "ru": ["это", "что", "когда", "жизнь"]}
    texts = [(i, " ".join(rng.choice(make[g]) for _ in range(rng.randint(5, 40))), g) for i, g in enumerate(rng.choices(list(make), k=300))]
    rows = [(i, t, g, "s", 0) for i, t, g in texts] + [(900, None, "en", "s", 0), (901, "123 ...", "en", "s", 0), (902, "", None, "s", 0), (903, "schön " * 30_000, None, "s", 0), (None, "the other thing", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    prototypes = learn(docs, ~held_out(4, 2))
    assert sorted(prototypes) == ["de", "en", "ru"]
    got = {r.doc_id: r for r in identify(docs.withColumn("lang_pred", F.lit(1)), prototypes).collect()}
    assert all(got[i].lang_pred == g for i, _, g in texts)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902)) and got[903].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sorted(r.doc_id for r in relabel(docs.where("doc_id >= 900"), prototypes).collect()) == [903]
    assert {r.lang_pred for r in identify(docs, {}).collect()} == {"und"} and learn(docs.limit(0), F.lit(True)) == {}
    marks = docs.where("doc_id IS NOT NULL").select("doc_id", held_out(4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in marks)


def test_toxicity(spark):
    from vocabmill.llm.langid import held_out
    from vocabmill.llm.toxicity import learn, score

    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("lan", "mer", "tos", "vik")]
    rows, labels = [], []
    for i in range(600):
        toxic = rng.random() < 0.2
        body = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(4):
                body.insert(rng.randrange(len(body)), rng.choice(["idiot", "moron", "zzvexal", "zzvexor"]))
        rows.append((i, " ".join(body), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "dalan " * 50_000, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("hits", F.lit(3)).withColumn("toxic", F.lit(9))
    known = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = learn(docs.drop("toxic"), known, ~held_out(5, 0))
    got = {r.doc_id: r.score for r in score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    unseen = [(got[i], t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(t) for s, t in unseen) / len(unseen) > 0.95
    assert got[1000] == got[1001] < 0.5 and got[1002] < 0.5
    bare = learn(docs.drop("toxic"), known.limit(0), ~held_out(5, 0))
    assert score(docs.limit(0), bare).count() == 0
    assert dict(score(spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string"), bare).collect())[1] > 0.5


def test_label_model_finds_the_good_voters():
    from vocabmill.llm.toxicity import LabelModel

    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    flip = lambda p: np.where(rng.random(4000) < p, ~y, y)
    votes = np.stack([flip(0.1), flip(0.1), flip(0.12), flip(0.15), flip(0.2), flip(0.5)], axis=1).astype(int)
    model = LabelModel(0.2).fit(votes)
    assert ((model.posterior(votes) >= 0.5) == y).mean() > 0.9
    assert model.rates[1, 0, 1] > 0.8 and model.rates[0, 0, 1] < 0.2 and abs(model.rates[1, 5, 1] - 0.5) < 0.1


def test_label_model_against_brute_force():
    """The posterior of a fitted tree is Bayes' rule over its own tables."""
    from vocabmill.llm.toxicity import LabelModel

    rng = np.random.default_rng(3)
    votes = rng.integers(-1, 2, (500, 6))
    votes[:, 3] = np.where(rng.random(500) < 0.9, votes[:, 2], votes[:, 3])
    model = LabelModel(0.3).fit(votes)
    got = model.posterior(votes[:60])
    for row, p in zip(np.where(votes[:60] < 0, 2, votes[:60]), got):
        both = [1 - model.prior, model.prior]
        for y in (0, 1):
            for j, i in enumerate(model.parent):
                both[y] *= model.tables[j][y, row[i] if i >= 0 else 0, row[j]]
        assert abs(both[1] / sum(both) - p) < 1e-9
    assert 2 in (model.parent[3], ) or model.parent[2] == 3
    assert np.allclose(model.rates.sum(axis=2), 1) and all(np.allclose(t.sum(axis=2), 1) for t in model.tables)


def test_label_model_with_correlated_voters():
    """Five near copies of one poor voter don't outvote four good ones."""
    from vocabmill.llm.toxicity import LabelModel

    rng = np.random.default_rng(1)
    n = 6000
    y = rng.random(n) < 0.3
    flip = lambda base, p: np.where(rng.random(n) < p, ~base, base)
    poor = flip(y, 0.35)
    votes = np.stack([*(flip(poor, 0.03) for _ in range(5)), *(flip(y, 0.12) for _ in range(4))], axis=1).astype(int)
    model = LabelModel(0.3).fit(votes)
    assert ((model.posterior(votes) >= 0.5) == y).mean() > 0.93
    clones = sum(1 for j in range(5) if 0 <= model.parent[j] < 5)
    assert clones >= 4 and model.rates[1, 6, 1] > 0.8 and model.rates[1, 0, 1] < 0.75


def test_toxicity_samples_both_classes_the_same_in_each_run(spark):
    from vocabmill.llm.toxicity import _sampled

    docs = docs_of(spark, [(i, f"text {i}") for i in range(3000)] + [(5, "text 5"), (5, "other"), (None, "x")])
    labels = spark.createDataFrame([(i, int(i % 100 == 0)) for i in range(3000)] + [(5, 1)], "doc_id long, toxic int")
    runs = [_sampled(x, labels, F.lit(True), 200) for x in (docs, docs.repartition(5))]
    got = [sorted(map(tuple, df.collect()), key=repr) for df, _ in runs]
    assert got[0] == got[1] and len({r[0] for r in got[0]}) == len(got[0])
    toxic = [r[0] for r in got[0] if r[2]]
    assert sorted(toxic) == sorted({*range(0, 3000, 100), 5}) and 60 < len(got[0]) - len(toxic) < 140 and abs(runs[0][1] - 31 / 3000) < 1e-9


def test_top_k(spark):
    from vocabmill.llm.topk import KDTree, top_k

    rng = np.random.default_rng(2)
    v = rng.normal(0, 0.2, (700, 16)).astype(np.float32)
    v[100:140] = v[7]
    rows = [(i, [float(x) for x in v[i]]) for i in range(700)] + [(700, None), (701, [1.0, None]), (702, [float("nan")] * 16), (703, [float("inf")] * 16), (704, []), (705, [0.5]), (None, [0.1] * 16), (50, [0.25] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("v", F.lit(1))
    got = top_k(df, F.col("vec_id") % 50 == 0, shard_bytes=100 * 128, block_bytes=5 * 128).collect()
    ints = []
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            ints.append((i, np.array([np.floor(256 * np.float64(np.float32(x))) for x in e] + [0.0] * (16 - len(e)))))
    want = Counter()
    for q, a in ints:
        if q % 50 == 0:
            best = sorted((-int(a @ b), i) for i, b in ints if i != q)[:5]
            want.update((q, n, i, -s) for n, (s, i) in enumerate(best, 1))
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    few = top_k(df.where("vec_id IN (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 2 and top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    tree = KDTree(v.astype(float), leaf=20)
    assert sorted(tree.order.tolist()) == list(range(700))
    q = rng.normal(size=(3, 16))
    for (a, b, *_), bound in zip(tree.nodes, tree.bounds(q).T):
        assert (q @ tree.vectors[a:b].T <= bound[:, None] + 1e-9).all()


def test_top_k_prunes_shards_and_splits_hot_cells(spark):
    """A third of all vectors are equal; far clusters are cells of their own, which most blocks never visit."""
    from vocabmill.llm import topk

    rng = np.random.default_rng(4)
    centres = rng.normal(0, 4, (12, 8))
    v = np.concatenate([centres[rng.integers(0, 12, 1600)] + rng.normal(0, 0.05, (1600, 8)), np.tile(centres[3], (800, 1))]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in e]) for i, e in enumerate(v)], "vec_id long, embedding array<float>")
    asked, original = [], topk._meet

    def counted(shards, asking):
        asked.append((shards.count(), asking.count()))
        return original(shards, asking)

    topk._meet = counted
    try:
        got = topk.top_k(df, F.col("vec_id") % 50 == 0, shard_bytes=100 * 64, block_bytes=10 * 64).collect()
    finally:
        topk._meet = original
    whole = np.floor(256 * v.astype(np.float64))
    want = {(q, n, i, -s) for q in range(0, len(v), 50) for n, (s, i) in enumerate(sorted((-int(x), i) for i, x in enumerate(whole @ whole[q]) if i != q)[:5], 1)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    (shards, blocks), (_, visits) = asked
    assert shards >= 24 and visits < blocks * shards / 2
    cells = topk.Cells(np.ones((500, 3)), 8)
    assert cells.count == 1 and set(cells.of(np.zeros((4, 3)))) == {0}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from vocabmill.llm.queries import tokenizer_path  # noqa: F401

    rng = random.Random(9)
    pool = [f"word{i}" for i in range(300)]
    texts = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(40, 90)))) for i in range(60)]
    item = " ".join(f"bench{i}" for i in range(20))
    texts += [(100, texts[3][1]), (101, f"{texts[4][1]} {item}"), (102, "12 34"), (103, None)]
    docs_of(spark, texts, source=lambda i: f"s{i % 3}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        kept.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    first = sorted(i for i, _ in texts if i not in (102, 103))
    assert kept[0] == first
    assert kept[1] == [i for i in first if i != 100]
    assert kept[2] == [i for i in kept[1] if i != 101]
    assert set(kept[3]) <= set(kept[2]) and len(kept[3]) > len(kept[2])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == kept[3]


def test_pipeline_edges(spark, tmp_path):
    """Nulls, clashing columns, repeated rows, a very long text; then no rows at all."""
    import corpus_pipeline

    rng = random.Random(3)
    body = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    item, long = " ".join(f"bench{i}" for i in range(20)), body(40_000)
    same = body(50)
    rows = [(None, body(60), None), (None, body(60), "s"), (7, body(60), "s"), (7, body(60), "s"), (8, same, "s"), (8, same, "s"), (None, same, "t"), (9, long, "t"), (10, f"{long} more", "t"), (11, f"{body(30)} {item}", "t"), (None, f"{body(30)} {item}", None), (12, None, "s"), (None, "", None), (13, "...", "s")]
    docs = spark.createDataFrame([(i, t, "en", src, 0) for i, t, src in rows], DOCS)
    clashing = ("size", "source_size", "target", "taken", "draw", "times", "d", "node", "own", "key", "lang_pred", "score", "fp", "__id", "__draw", "__s", "n", "chance")
    for name in clashing:
        docs = docs.withColumn(name, F.lit(5))
    docs.write.parquet(f"{tmp_path}/full/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for where, labelled in (("full", [(7, 1, 0), (None, 0, 1), (9, None, None)]), ("none", [])):
        bench = [(0, item), (None, "x"), (1, None)] if labelled else []
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/{where}/benchmark.parquet")
        spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{where}/labels.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/full/documents.parquet"), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        now = stage(spark, now, f"{tmp_path}/full")
        assert now.columns == docs.columns and set(now.select(*clashing).distinct().first()) == {5}, name
        now.write.parquet(f"{tmp_path}/stage{n}")
        now = spark.read.parquet(f"{tmp_path}/stage{n}")
        kept.append(sorted(((r.doc_id or 0), len(r.text or "")) for r in now.collect()))
    sizes = lambda drop: sorted(((i or 0), len(t)) for k, (i, t, _) in enumerate(rows) if k not in drop)
    assert kept[0] == sizes({11, 12, 13})
    assert kept[1] == sizes({11, 12, 13, 5, 6, 8})  # copies go: of the equal texts one row stays, of the long ones the first
    assert kept[2] == sizes({11, 12, 13, 5, 6, 8, 9, 10})
    assert set(kept[3]) <= set(kept[2]) and max(Counter(kept[3]).values()) <= 2
    out = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert len(out) == len(kept[3]) and all(r.n_tokens > 1 for r in out)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_language_id_against_brute_force(spark):
    """Predictions are the largest cosine of directly bundled n-gram vectors."""
    from vocabmill.llm import langid

    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["alpha", "beta,", "Gamma9", "ünïcode", "жизнь", "x-y"]) for _ in range(rng.randint(1, 30))), "ab"[i % 2]) for i in range(40)]
    letters = np.random.default_rng(langid.SEED).integers(0, 2, (langid.SYMBOLS, langid.DIMENSIONS), np.int8) * 2 - 1

    def bundle(text):
        shown = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        shown = " " + " ".join(shown.split()) + " "
        codes = [int(langid.symbols(np.array([ord(c)]))[0]) for c in shown]
        out = np.zeros(langid.DIMENSIONS)
        for i in range(len(codes) - langid.N + 1):
            v = np.ones(langid.DIMENSIONS, np.int64)
            for k in range(langid.N):
                v *= np.roll(letters[codes[i + k]], langid.N - 1 - k)
            out += v
        return out

    docs = spark.createDataFrame([(i, t, g, "s", 0) for i, t, g in texts], DOCS)
    own = {i: bundle(t) for i, t, _ in texts}
    sums = {g: sum(own[i] / np.linalg.norm(own[i]) for i, _, lang in texts if lang == g) for g in "ab"}
    units = {g: v / np.linalg.norm(v) for g, v in sums.items()}
    got = {r.doc_id: r for r in langid.identify(docs, langid.learn(docs, F.lit(True))).collect()}
    for i, v in own.items():
        cosines = {g: float(u @ v / np.linalg.norm(v)) for g, u in units.items()}
        assert abs(got[i].score - max(0.0, max(cosines.values()))) < 1e-4
        assert got[i].lang_pred == max(cosines, key=cosines.get) or abs(cosines["a"] - cosines["b"]) < 1e-6
    same = {"b": units["a"], "a": units["a"]}
    assert {r.lang_pred for r in langid.identify(docs, dict(sorted(same.items()))).collect()} == {"a"}  # ties go to the first by code point


@pytest.mark.parametrize("small", [32, 2])
def test_near_copies(spark, monkeypatch, small):
    """Links are exact Jaccard of 5-word shingles >= 0.8, for small groups and for chunks of large ones."""
    from vocabmill.llm import near_copies as nc

    monkeypatch.setattr(nc, "SMALL", small)
    monkeypatch.setattr(nc, "CHUNK", 3)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, line = [], " ".join(word() for _ in range(9))
    for i in range(12):
        base = [word() for _ in range(rng.choice((8, 60, 120)))]
        for j in range(rng.choice((1, 4, 9))):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own) + (" " + line if rng.random() < 0.5 else ""))
    texts += [line, line.upper(), "  " + line, "", None, " \n", "one two", "one  TWO", "two one", texts[3]]
    rng.shuffle(texts)

    def shingles(t):
        words = (t or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, of = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
                a, b = sorted((of[i], of[j]))
                of = [a if x == b else x for x in of]
    kept = nc.first_of_each(docs_of(spark, list(enumerate(texts)), extra=True))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(of)) and len(set(of)) < len(texts) - 10
    assert nc.first_of_each(docs_of(spark, [])).count() == 0


def test_large_groups_of_near_copies(monkeypatch):
    """a large group meets its pivot; then only members of other components meet the rest, each pair of alike sizes."""
    import pyarrow as pa
    from vocabmill.llm import near_copies as nc

    batch = lambda keys, nodes, sizes: pa.record_batch([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32())], ["key", "node", "size"])
    rows = [r for b in nc._groups([batch([1, 1], [5, 4], [10, 10]), batch([2] * 3000, range(3000), [100] * 3000)]) for r in b.to_pylist()]
    assert [r for r in rows if r["key"] is None] == [{"u": 4, "v": 5, "nu": 10, "nv": 10, "key": None}]
    assert len(rows) == 3001 and {r["u"] for r in rows if r["key"] == 2} == {0}
    assert nc.crossings(np.arange(3000), np.full(3000, 100), np.zeros(3000, np.int64)) == []
    assert sum(map(len, nc.crossings(np.arange(3000), np.full(3000, 100), np.repeat([0, 1], [2998, 2])))) < 3100
    monkeypatch.setattr(nc, "CHUNK", 3)
    rng = np.random.default_rng(4)
    for m in (2, 7, 40):
        nodes, sizes, roots = rng.permutation(1000)[:m], rng.integers(20, 60, m), rng.integers(0, 6, m) // 3
        met = {frozenset((a, b)) for x in nc.crossings(nodes, sizes, roots) for a in x.tolist() for b in x.tolist()}
        for i in range(m):
            for j in range(i):
                if roots[i] != roots[j] and min(sizes[i], sizes[j]) * 5 >= max(sizes[i], sizes[j]) * 4:
                    assert frozenset((int(nodes[i]), int(nodes[j]))) in met


def test_common_lines_compare_no_sets(spark, monkeypatch):
    """texts that share a line, but are not near copies, are told apart before their sets are shuffled."""
    from vocabmill.llm import near_copies as nc

    monkeypatch.setattr(nc, "SAMPLE", 1)
    rng, whole, table = random.Random(3), {}, nc.Scratch.table
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line = [word() for _ in range(30)]
    texts = [" ".join([*(word() for _ in range(60 + i % 9)), *line]) for i in range(150)]
    texts += [texts[i] + " end" for i in range(0, 150, 50)]

    def counted(self, df, label, *rest, **more):
        out = table(self, df, label, *rest, **more)
        if label.endswith("-nodes"):
            whole[label] = out.count()
        return out

    monkeypatch.setattr(nc.Scratch, "table", counted)
    for share in (6, 10**9):  # the line is frequent; it is not seen to be
        monkeypatch.setattr(nc, "SHARE", share, raising=False)
        whole.clear()
        assert sorted(r.doc_id for r in nc.first_of_each(docs_of(spark, list(enumerate(texts)))).collect()) == list(range(150))
        assert sum(whole.values()) <= 18  # three pairs, met by SimHash, by prefixes and in a group


def test_frequent_shingles_of_many_rows(spark, monkeypatch):
    """the rows sampled for frequent shingles grow with the rows."""
    from vocabmill.llm import near_copies as nc
    from vocabmill.llm._shared import Scratch

    monkeypatch.setattr(nc, "SAMPLE", 1)
    texts = [f"a common line of words own{i} and other{i} words{i} here{i}" for i in range(600)]
    rows = docs_of(spark, list(enumerate(texts))).select(nc.node_of(F.col("text")).alias("node"), "text")
    first, last = nc.shingles(b"a common line of words"), nc.shingles(texts[0].split(" ", 5)[1].encode())
    found = nc._frequent(rows, Scratch(spark, "test")).tolist()
    assert found == first.tolist() and not set(found) & set(last.tolist())
    monkeypatch.setattr(nc, "MAX_FREQUENT", 0)
    assert nc._frequent(rows, Scratch(spark, "test")).tolist() == []


def test_bitmaps_miss_no_link(monkeypatch):
    """bitmaps of any width propose each pair of other roots that reaches 4/5, and drop sets far from all."""
    import pyarrow as pa
    from vocabmill.llm import near_copies as nc

    rng = np.random.default_rng(7)
    draw = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    for most in (1 << 16, 128):
        monkeypatch.setattr(nc, "MAX_BITS", most)
        sets = []
        for n in (1, 5, 30, 64, 70, 120, 129, 500):
            base = draw(n)
            for _ in range(6):
                sets.append(np.unique(np.concatenate([base[rng.permutation(n)[: n - int(n * 0.12 * rng.random())]], draw(int(n * 0.12 * rng.random()))])))
        sets += [draw(40) for _ in range(5)]
        sizes, roots, bits = np.array([len(x) for x in sets]), rng.integers(0, 3, len(sets)), [nc.bitmap(x) for x in sets]
        to = nc.nearest(sizes, roots, bits)
        alike = lambda i, j: 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (sizes[i] + sizes[j])
        due = {i for i in range(len(sets)) if any(roots[i] != roots[j] and alike(i, j) for j in range(len(sets)))}
        assert len(due) > 30 and due <= set(np.flatnonzero(to >= 0).tolist())
        assert all(roots[i] != roots[j] for i, j in enumerate(to.tolist()) if j >= 0) and (to[-5:] < 0).all()
        rows = pa.table({"gid": [g for g in (1, 2) for _ in sets], "node": [*range(len(sets))] * 2, "root": [*roots.tolist()] * 2, "size": pa.array([*sizes.tolist()] * 2, pa.int32()), "bits": bits * 2})
        for names in (["gid", "node"], ["u", "v"]):
            whole, cut = ([x for b in nc._by_bitmaps(names)(rows.to_batches(max_chunksize=n)) for x in b.to_pylist()] for n in (1000, 7))
            assert whole == cut and len(whole) == 2 * (to >= 0).sum()


def test_counts_of_shingles_cut_by_batches():
    """keys are counted in sorted batches, whatever their cuts."""
    import pyarrow as pa
    from vocabmill.llm import near_copies as nc

    rng = np.random.default_rng(8)
    keys, nodes = np.sort(rng.integers(-20, 20, 400)), rng.integers(0, 12, 400)
    held = {}
    for k, n in zip(keys.tolist(), nodes.tolist()):
        held.setdefault(k, set()).add(n)
    rows = pa.table({"key": keys, "node": nodes})
    for size in (1, 3, 50, 1000):
        found = [(r["key"], r["n"]) for b in nc._counted(rows.to_batches(max_chunksize=size)) for r in b.to_pylist()]
        assert found == [(k, len(v)) for k, v in sorted(held.items()) if len(v) >= nc.FREQUENT]


def test_pipeline_near_dedup(spark):
    """Of 60 words one differs, 5 of 56 shingles, but the fingerprints can differ by more than op8's 4 bits."""
    import corpus_pipeline
    from vocabmill.llm.simhash import fingerprint

    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    while True:
        other = list(base)
        other[30] = f"x{rng.randrange(10**6)}"
        if (fingerprint(" ".join(base).encode()) ^ fingerprint(" ".join(other).encode())).bit_count() > 4:
            break
    docs = docs_of(spark, [(1, " ".join(base)), (2, " ".join(other)), (3, "something else")])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_decontamination_by_row(spark):
    from vocabmill.llm.decontamination import without_overlaps

    item = "the quick brown fox jumps over the lazy dog"
    docs = docs_of(spark, [(None, item), (None, "clean one"), (None, None), (1, f"so {item}"), (1, "clean two"), (2, "clean three")])
    bench = spark.createDataFrame([(0, item), (1, "seven wizards brew potions in silence")], "item_id long, text string")
    assert without_overlaps(docs, bench).count() == 4
    for kept in (without_overlaps(docs, bench, block_bytes=8 << 20), without_overlaps(docs, bench, block_bytes=10)):
        assert sorted(str(r.text) for r in kept.collect()) == ["None", "clean one", "clean three", "clean two"]


def test_near_copies_by_row(spark):
    """One row of each component stays, whatever ids repeat or are null."""
    from vocabmill.llm.near_copies import first_of_each

    rows = [(None, "alpha beta"), (None, "alpha beta"), (None, "gamma delta"), (1, "gamma delta"), (2, "some text"), (2, "some text"), (2, "other text"), (3, ""), (3, None), (4, "  ")]
    kept = first_of_each(docs_of(spark, rows, extra=True)).collect()
    assert sorted((r.doc_id or 0, (r.text or "").strip()) for r in kept) == [(0, "alpha beta"), (1, "gamma delta"), (2, "other text"), (2, "some text"), (3, "")]
    assert set(kept[0].asDict()) == set(docs_of(spark, rows, extra=True).columns)


def test_language_id_keeps_rare_languages(spark):
    from vocabmill.llm.langid import learn

    rows = [(i, f"the other thing {i}", "en", "s", 0) for i in range(3000)] + [(7_000_000 + i, "это жизнь", "ru", "s", 0) for i in range(2)] + [(None, "nicht schön", "de", "s", 0)] * 50
    assert sorted(learn(spark.createDataFrame(rows, DOCS), F.lit(True), learn_rows=10)) == ["de", "en", "ru"]


def test_relabel_without_languages(spark):
    from vocabmill.llm.langid import relabel

    rows = spark.createDataFrame([(1, "some text", None, "s", 0), (2, "123 ...", None, "s", 0), (3, None, "en", "s", 0), (4, "жизнь", "xx", "s", 0)], DOCS)
    assert sorted((r.doc_id, r.lang) for r in relabel(rows, {}).collect()) == [(1, None), (4, "xx")]


def test_decontamination_short_items(spark):
    from vocabmill.llm.decontamination import overlaps, tokens

    bench = spark.createDataFrame([(0, "Who wrote Faust?"), (1, "我們今天去學校學習"), (2, "zebra"), (3, "...")], "item_id long, text string")
    docs = docs_of(spark, [(1, "tell me: who wrote FAUST"), (2, "who wrote the first Faust"), (3, "他說我們今天去學校學習嗎"), (4, "a zebra and a zebra"), (5, "who wrote faust, who wrote faust"), (6, "zebra")])
    got = sorted((r.doc_id, r.item_id, r.coverage, r.tiles, r.longest) for r in overlaps(docs, bench).collect())
    assert got == [(1, 0, 1.0, 1, 3), (3, 1, 1.0, 1, 9), (4, 2, 1.0, 1, 1), (5, 0, 1.0, 1, 3), (6, 2, 1.0, 1, 1)]
    assert tokens("abc學校 d") == ["abc", "學", "校", "d"]
