"""Conversation repair, quality rules and lexical search against brute force on small rows."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

TALK = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_edits(rows, most):
    """(cost, audit, output) of every way of at most so many edits that gives good roles: no search, plain enumeration."""
    faults = faults_of(rows)
    for plan in itertools.product(range(3), repeat=len(rows) + 1):  # inserts before each row and at the end
        for ops in itertools.product("KDua", repeat=len(rows)):
            for made in itertools.product(*(itertools.product("ua", repeat=n) for n in plan)):
                cost, audit, out = 0, "", []
                for k in range(len(rows) + 1):
                    for role in made[k]:
                        cost, audit = cost + 2, audit + "I"
                        out.append({"u": "user", "a": "assistant"}[role] + ":")
                    if k == len(rows):
                        break
                    _, role, text = rows[k]
                    if ops[k] == "D":
                        cost, audit = cost + 3, audit + "D"
                        continue
                    if faults[k] in ("blank", "duplicate"):
                        break
                    cost += faults[k] == "truncated"
                    if ops[k] == "K":
                        audit += "K"
                        out.append(f"{role}:{text}")
                    else:
                        cost, audit = cost + 2, audit + "R"
                        out.append({"u": "user", "a": "assistant"}[ops[k]] + f":{text}")
                else:
                    raise AssertionError
                if k == len(rows) and cost <= most and re.fullmatch("(s?(ua)+)?", "".join(x[:1] or "?" for x in out)):
                    yield cost, audit, out


def lattice_brute(rows):
    """Dijkstra without a heuristic over (rows consumed, last initial), by its own transitions."""
    faults, after = faults_of(rows), {"": "su", "s": "u", "u": "a", "a": "u"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, last, out = heapq.heappop(queue)
        if (i, last) in done:
            continue
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(out)
        done.add((i, last))
        push = lambda c, op, j, s, shown: heapq.heappush(queue, (cost + c, audit + op, j, s, out + shown))  # noqa: B023, E731
        for role in ("user", "assistant"):
            if role[0] in after[last]:
                push(2, "I", i, role[0], (f"{role}:",))
        if i < len(rows):
            _, role, text = rows[i]
            push(3, "D", i + 1, last, ())
            if faults[i] in ("", "truncated"):
                more = faults[i] == "truncated"
                if role[:1] and role[:1] in after[last]:
                    push(more, "K", i + 1, role[:1], (f"{role}:{text}",))
                for new in ("user", "assistant"):
                    if new[0] in after[last]:
                        push(2 + more, "R", i + 1, new[0], (f"{new}:{text}",))


def repaired(spark, rows):
    from vocabmill.llm.conversation_repair import digests, repair

    report, turns = repair(spark.createDataFrame(rows, TALK).withColumns({c: F.lit(7) for c in ("at", "block", "digest", "first", "made", "fault")}))
    hashes = {r.conv_id: r.repaired_sha256 for r in digests(turns).collect()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes.get(r.conv_id, hashlib.sha256(b"").hexdigest())) for r in report.collect()}


def expected(rows):
    order = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2][:64], hashlib.md5(z[2].encode()).digest()))
    turns, faults = [t for t, _, _ in order if t is not None], faults_of(order)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(order, order[1:]))
    cost, audit, out = lattice_brute(order)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


@pytest.mark.parametrize("bits", [8, 1])
def test_conversation_repair(spark, monkeypatch, bits):
    """Segments of 256 rows and of 2, which cut every conversation, give what one search gives."""
    from vocabmill.llm import conversation_repair as cr

    monkeypatch.setattr(cr, "SEGMENT_BITS", bits)
    rng = random.Random(bits)
    texts = ["Fine.", "Cut off", "", " \t", "Same!", None, "é" * 90 + "?", "x" * 5000]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for c in [*range(40), None] for _ in range(rng.randint(1, 9))]
    rows += [(99, i, ("user", "assistant")[i % 3 % 2], "One.") for i in range(700)] + [(98, None, "user", "A."), (97, 5, "assistant", "B."), (97, 9, "user", "C.")]
    got = repaired(spark, rows)
    want = {c: expected([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want


def test_conversation_repair_takes_the_cheapest_and_least():
    """A* against plain enumeration of edits."""
    from vocabmill.llm.conversation_repair import BLANK, DUPLICATE, FINE, TRUNCATED, search, TAIL

    kinds = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": TRUNCATED, "": FINE}
    rng = random.Random(4)
    for n in (0, 1, 2, 2, 2, 3, 3):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "no", ""])) for i in range(n)]
        found = search([(kinds[f], r[1][:1]) for f, r in zip(faults_of(rows), rows)], 0)
        best = min((cost + 2 * TAIL[s], audit + "I" * TAIL[s]) for s, (cost, audit) in found.items())
        assert best == min(all_edits(rows, best[0]))[:2] and best == lattice_brute(rows)[:2]


def test_damage(spark):
    from vocabmill.llm.conversation_repair import damage

    rows = [(c, t, "assistant", "Yes. No! So?") for c in (*range(30), None) for t in (*range(3), None)] + [(5, 1, None, None)]
    want = Counter()
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if fault == 4 else role or " ", " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        want[(c, t, role, text)] += {0: 0, 3: 2}.get(fault, 1)
    assert Counter(map(tuple, damage(spark.createDataFrame(rows, TALK)).collect())) == +want
    assert damage(spark.createDataFrame([], TALK)).count() == 0


def test_conversation_repair_of_nothing(spark):
    assert repaired(spark, []) == {}


def test_op11_keeps_conversations_without_rows(spark, tmp_path):
    from vocabmill.llm.queries import op11_conversation_repair

    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "A."), (None, None, "user", "A.")], TALK).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert tuple(got[gone]) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and set(got) == {gone, None}


DOCS = "doc_id long, text string, lang string"


def counts_brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    where = {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def clean_text(rng, lang, n):
    common = {"a": ["the", "of", "and", "to"], "b": ["le", "de", "et", "la"]}[lang]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)) + "."


def divergence_brute(shares, reference):
    out = 0.0
    for k in set(shares) | set(reference):
        p, q = shares.get(k, 0.0), reference.get(k, 0.0)
        out += (p * math.log2(2 * p / (p + q)) if p else 0) / 2 + (q * math.log2(2 * q / (p + q)) if q else 0) / 2
    return out


def test_quality_rules(spark):
    from vocabmill.llm.quality_rules import judge

    rng = random.Random(6)
    texts = [(i, clean_text(rng, "ab"[i % 2], rng.choice([12, 60, 150])), "ab"[i % 2]) for i in range(60)]
    odd = [None, "", " \t\n ", "a b", "Same line\nSame line\n\n \nother", "x " * 9 + "y", "one two three four five six seven eight nine ten one two three four five", "r s t u v " * 40, "é|#*$ <b> & %" * 3 + "\n\n", "w" * 60_000 + " z" * 12, "a\rb\x0cc\x0bd\te f g h i j k"]
    junk = [(500, " ".join("".join(rng.choice("ABCDEFGH") for _ in range(6)) + "!!" for _ in range(120)), "a"), (501, " | ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(150)), "b")]
    other = [(502, clean_text(rng, "b", 150), "a"), (503, clean_text(rng, "a", 150), None), (503, clean_text(rng, "a", 150), None)]
    rows = texts + [(100 + i, t, "a") for i, t in enumerate(odd)] + junk + other
    docs = spark.createDataFrame(rows, DOCS)
    got = judge(docs.withColumns({c: F.lit("x") for c in ("n_words", "kept", "_quality_measures", "place", "word")})).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *(r[f] for f in fields)) for r in got) == Counter((i, *counts_brute(t)) for i, t, _ in rows)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i, _, _ in texts + other) and not kept[500] and not kept[501] and not any(r.kept for r in got if r.base_failed)
    # the divergences themselves
    words = {lang: Counter(w for _, t, l in rows if l == lang and t for w in t.split()) for lang in ("a", "b", None)}
    totals = {lang: c.total() for lang, c in words.items()}
    known = [lang for lang in totals if totals[lang] >= 1000]
    common = {w for lang in known for w, _ in sorted(((w, n) for w, n in words[lang].items() if re.fullmatch(r"[A-Za-z\x80-\U0010ffff]+", w)), key=lambda x: (-x[1], x[0]))[:30]}

    def shares(c):
        total = c.total()
        own = {w: n / total for w, n in c.items() if w in common}
        return own | {"": 1 - sum(own.values())}

    for r in got:
        if r.word_divergence is not None:
            near = [divergence_brute(shares(Counter(r.text.split())), shares(words[lang])) for lang in known]
            own = near[known.index(r.lang)] if r.lang in known else None
            assert r.word_divergence == pytest.approx(own if own is not None and own <= 0.115 else min(near), abs=1e-9)


def test_quality_rules_without_references(spark):
    from vocabmill.llm.quality_rules import judge

    assert judge(spark.createDataFrame([], DOCS)).count() == 0
    got = judge(spark.createDataFrame([(1, "a b c d e f g h i j", None), (2, None, "a")], DOCS)).collect()
    assert {(r.doc_id, r.kept, r.class_divergence) for r in got} == {(1, True, None), (2, False, None)}


def test_quality_references_count_all_rows(spark):
    from vocabmill.llm.quality_rules import references

    rng = random.Random(8)
    texts = [clean_text(rng, "a", 12) + (f" Zz{i % 7} É;" if i % 3 else "") for i in range(4500)]
    (found,) = references(spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], DOCS).repartition(6))
    words = Counter(w for t in texts for w in t.split())
    common = sorted(((w, n) for w, n in words.items() if re.fullmatch(r"[A-Za-z\x80-\U0010ffff]+", w)), key=lambda x: (-x[1], x[0]))[:30]
    assert found["words"] == {w: n / words.total() for w, n in common}
    whole = "".join(texts)
    counts = [len(re.findall(p, whole)) for p in ("[A-Z]", "[0-9]", r"\s", "[#*$%&|<>]", "[!-/:-@\\[-`{-~]")] + [len(whole.encode()) - len(whole)]
    counts[4] -= counts[3]
    assert found["classes"] == [n / len(whole.encode()) for n in [*counts, len(whole.encode()) - sum(counts)]]


def test_quality_rules_use_no_python(spark, tmp_path):
    from vocabmill.llm.queries import op12_quality_rules

    rng = random.Random(1)
    spark.createDataFrame([(i, clean_text(rng, "a", 100), "a") for i in range(20)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    plan = op12_quality_rules(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def search_brute(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked, out = {}, []
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    for item, query in asked.items():
        found = []
        for i, c in held:
            score = 0
            for w, times in query.items():
                if w in c:
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                    score += times * weight * (10**9 * c[w] // (1000 * c[w] + 12 * (75 + 25 * c.total() * n // total)))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [32 << 20, 100])
def test_lexical_search(spark, block_bytes):
    """One block of items and many; ties, rows that repeat an id, texts without terms, other scripts."""
    from vocabmill.llm.lexical_search import search

    rng = random.Random(8)
    words = ["Apple", "pear", "FIG", "ünï", "日本", "x1", "a", "b", "c", "ÀB"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    docs += [(i, "apple pear") for i in range(100, 130)] + [(7, "fig fig"), (None, "fig a"), (200, None), (201, ""), (202, " !? \n"), (203, "pear " * 20_000)]
    items = [(1, "apple, APPLE-pear"), (2, "日本 ünï"), (2, "x1"), (3, None), (4, "nothing"), (None, "fig"), (5, "fig's Àb")]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string").withColumns({c: F.lit(1) for c in ("term", "row", "n", "tf", "bucket", "score")})
    got = search(frame(docs, "doc_id").repartition(3), frame(items, "item_id"), 20, block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == search_brute(docs, items, 20)
    assert search(frame([], "doc_id"), frame(items, "item_id")).count() == 0 and search(frame(docs, "doc_id"), frame([], "item_id")).count() == 0
