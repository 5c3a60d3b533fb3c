"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    found = dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(rtrim(ltrim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
repeated AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.doc_id, l.i, l.line, r.k IS NOT NULL AND l.doc_id <> r.keeper AS gone FROM lines l LEFT JOIN repeated r ON l.k = r.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and the benchmark item that it covers."""
    from .decontamination import overlaps

    return overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out
    from .toxicity import learn, score

    docs = _table(spark, sf_dir, "documents")
    model = learn(docs, _table(spark, sf_dir, "labels"), ~held_out(5, 0))
    found = score(docs, model)
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import read_tokens, tokens_folder, write_tokens

    folder = tokens_folder(spark)
    write_tokens(_table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return read_tokens(spark, folder, digest_only=True)


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, weight): 2 for documents labelled as good, 0.5 for poor; others have no row."""
    labels = _table(spark, sf_dir, "labels")
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.when(F.max("quality") > 0, 2.0).otherwise(0.5).alias("weight"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents),
q AS (SELECT doc_id, CASE WHEN max(quality) > 0 THEN 2.0 ELSE 0.5 END::DOUBLE AS weight FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT d.doc_id, d.source, d.size, -ln(d.u) / coalesce(q.weight, 1.0) AS key FROM d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, source_size * 2.0::DOUBLE AS cap,
             ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
                  - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE cap / w >= level ORDER BY cap / w, source NULLS LAST LIMIT 1) * w, cap)) AS target FROM l),
o AS (SELECT k.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
             coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + CASE WHEN before + size / 2.0 <= target - epochs * source_size THEN size ELSE 0 END)::BIGINT AS taken
FROM o
"""


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    found = dedup_substrings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS phrase
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
marked AS (SELECT a.doc_id, a.i, a.word, g.i IS NOT NULL AS gone FROM words a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.i = g.i),
summed AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(s.n, 0)::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM d LEFT JOIN summed s ON d.doc_id = s.doc_id
"""


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import as_events, format_chats, read_back

    probe = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("x"))
    rows = rows.unionByName(own.select("conv_id", "x.turn", "x.role", F.lit(probe).alias("text")))
    back = read_back(format_chats(as_events(rows)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(role || text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) + 8 + 8 + 7 AS shown FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(shown)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_of, near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify, learn

    docs = _table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs, ~held_out(4, 2)))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damage, digests, repair

    rows = _table(spark, sf_dir, "conversations")
    report, turns = repair(damage(rows))
    # null ids meet as well: a join of equal keys loses them
    key = lambda df: df.withColumn("k", F.struct("conv_id"))
    found = key(rows.select("conv_id").distinct()).join(key(report).drop("conv_id"), "k", "left").join(key(digests(turns)).drop("conv_id"), "k", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _repair_sql() -> str:
    """The edit lattice as a recursion over rows; n, s, u, a are the best (c: cost, a: audit, o: output) of each last state."""

    def step(state: str, op: str, cost: str, shown: str | None = None) -> str:
        out = f"{state}.o" if shown is None else f"{state}.o || {shown} || chr(10)"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{op}', 'o': {out}}} END"

    def insert(state: str, role: str) -> str:
        return step(state, "I", "2", f"'{role}:'")

    def stay(state: str, op: str, role: str) -> str:
        cost, good = {"K": ("charge", f"goes AND initial = '{role[0]}'"), "R": ("charge + 2", "goes")}[op]
        return f"CASE WHEN {good} THEN {step(state, op, cost, "role || ':' || text" if op == 'K' else f"'{role}:' || text")} END"

    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    to_user = [stay(x, op, "user") for x in ("n", "s", "a") for op in "KR"]
    return rf"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
                         lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::INT]::BIGINT)), 4294967295::BIGINT) % 20 AS f
  FROM keyed, tab),
hurt AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE f <> 0),
numbered AS (
  SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 64), md5(text), copy) AS i,
         rtrim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS bare FROM hurt),
judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM numbered),
rows AS (SELECT *, fault NOT IN ('b', 'd') AS goes, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS charge FROM judged),
counted AS (
  SELECT conv_id, max(i) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
best AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'o': ''}} AS n, NULL::STRUCT(c INTEGER, a VARCHAR, o VARCHAR) AS s,
         NULL::STRUCT(c INTEGER, a VARCHAR, o VARCHAR) AS u, NULL::STRUCT(c INTEGER, a VARCHAR, o VARCHAR) AS a FROM counted
  UNION ALL
  SELECT conv_id, i, {step('n', 'D', '3')}, {least(step('s', 'D', '3'), stay('n', 'K', 'system'))},
         {least(step('u', 'D', '3'), *to_user)}, {least(step('a', 'D', '3'), stay('u', 'K', 'assistant'), stay('u', 'R', 'assistant'))}
  FROM (SELECT conv_id, i, n, s, u, {least('a', insert('u', 'assistant'))} AS a, role, text, initial, goes, charge
        FROM (SELECT b.conv_id, r.i, n, s, {least('u', *(insert(x, 'user') for x in ('n', 's', 'a')))} AS u, a, role, text, initial, goes, charge
              FROM best b JOIN rows r ON r.conv_id = b.conv_id AND r.i = b.i + 1))),
closed AS (SELECT conv_id, i, n, {least('u', insert('s', 'user'))} AS u, a FROM best),
last AS (SELECT x.conv_id, {least('n', 'a', insert('u', 'assistant'))} AS e FROM closed x JOIN counted c ON x.conv_id = c.conv_id AND x.i = c.n_rows)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit,
       sha256(coalesce(left(e.o, length(e.o) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id = c.conv_id LEFT JOIN last l ON o.conv_id = l.conv_id
"""


OP11_SQL = _repair_sql()


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    found = judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, text IS NOT NULL AS there, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT r, i, array_to_string(ws[i : i + 4], ' ') AS phrase FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, phrase) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i)::BIGINT AS n FROM (SELECT r, unnest(range(i, i + 5)) AS i FROM twice) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) > 0 GROUP BY r),
base AS (
  SELECT d.r, doc_id, lang, there, ws, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
         length(text) AS points, strlen(text) AS total, length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g')) AS upper_case,
         length(text) - length(regexp_replace(text, '[0-9]+', '', 'g')) AS digits, length(text) - length(regexp_replace(text, '[!-/:-@\[-`{-~]+', '', 'g')) AS signs
  FROM d LEFT JOIN lines l ON d.r = l.r LEFT JOIN repeated p ON d.r = p.r),
classed AS (SELECT *, [upper_case, digits, points - word_chars, n_symbols, signs - n_symbols, total - points, total - upper_case - digits - (points - word_chars) - signs - (total - points)] AS c FROM base),
held AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(ws) AS word FROM d) WHERE NOT regexp_matches(word, '[\x00-@\[-`{-\x7F]') GROUP BY lang, word),
sizes AS (SELECT lang, sum(n_words) AS total FROM classed WHERE there GROUP BY lang HAVING sum(n_words) >= 1000),
common AS (
  SELECT DISTINCT word FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM held) WHERE place <= 30 AND lang IN (SELECT lang FROM sizes)),
class_refs AS (
  SELECT lang, k, sum(x)::DOUBLE / sum(sum(x)) OVER (PARTITION BY lang) AS q
  FROM (SELECT lang, unnest(c) AS x, generate_subscripts(c, 1) AS k FROM classed WHERE there) WHERE lang IN (SELECT lang FROM sizes) GROUP BY lang, k),
class_p AS (SELECT r, k, x::DOUBLE / total AS p FROM (SELECT r, total, unnest(c) AS x, generate_subscripts(c, 1) AS k FROM classed WHERE n_words >= 50) WHERE x > 0),
class_d AS (
  SELECT r, min(v) AS v FROM (
    SELECT r, lang, sum(p / 2 * log2(p / ((p + q) / 2)) + CASE WHEN q > 0 THEN q / 2 * log2(q / ((p + q) / 2)) ELSE 0 END) + greatest(0, 1 - sum(q)) / 2 AS v
    FROM class_p JOIN class_refs ON class_p.k = class_refs.k GROUP BY r, lang) GROUP BY r),
word_refs AS (SELECT h.lang, word, n::DOUBLE / total AS q FROM held h JOIN sizes s ON h.lang = s.lang WHERE word IN (SELECT word FROM common)),
full_refs AS (SELECT * FROM word_refs UNION ALL SELECT s.lang, '', 1 - coalesce(sum(q), 0) FROM sizes s LEFT JOIN word_refs w ON s.lang = w.lang GROUP BY s.lang),
word_p AS (
  SELECT r, word, count(*)::DOUBLE / any_value(n) AS p
  FROM (SELECT r, n, CASE WHEN t IN (SELECT word FROM common) THEN t ELSE '' END AS word FROM (SELECT r, n_words AS n, unnest(ws) AS t FROM base WHERE n_words >= 150)) GROUP BY r, word),
word_d AS (
  SELECT r, min(v) AS v FROM (
    SELECT p.r, s.lang, sum(p / 2 * log2(p / ((p + coalesce(q, 0)) / 2)) + CASE WHEN q > 0 THEN q / 2 * log2(q / ((p + q) / 2)) ELSE 0 END) + greatest(0, 1 - sum(coalesce(q, 0))) / 2 AS v
    FROM word_p p CROSS JOIN sizes s LEFT JOIN full_refs f ON f.word = p.word AND f.lang = s.lang GROUP BY p.r, s.lang) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
       NOT failed AND coalesce(c.v, 0) <= 0.08 AND coalesce(w.v, 0) <= 0.115 AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed FROM base) b LEFT JOIN class_d c ON b.r = c.r LEFT JOIN word_d w ON b.r = w.r
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d),
q AS (SELECT item_id, term, count(*) AS times
      FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
      GROUP BY item_id, term),
p AS (SELECT doc_id, term, n, count(*) AS tf
      FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term, n),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS weight
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (SELECT p.doc_id, p.term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * n_docs) // n_terms)))) AS points FROM p JOIN w ON p.term = w.term, c),
t AS (SELECT item_id, doc_id, sum(points * times)::BIGINT AS score FROM s JOIN q ON s.term = q.term GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM t WHERE score > 0) WHERE rank <= 20
"""


def queries() -> dict:
    made = (op1_line_dedup, op2_decontamination, op3_toxicity, op4_token_output, op5_source_mix, op6_substring_dedup, op7_chat_format, op8_simhash, op9_language_id, op10_top_k, op11_conversation_repair, op12_quality_rules, op13_lexical_search)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op5_source_mix": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op7_chat_format": OP7_SQL, "op10_top_k": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op12_quality_rules": OP12_SQL, "op13_lexical_search": OP13_SQL}
