"""Quality rules: counts of a text, and its divergence from the languages of the corpus.

Only DataFrame functions are used.  A text fails the base rules if it has few
words or repeats itself; else its histograms of character classes and of common
words are compared with those of each language by Jensen-Shannon divergence
(base 2; its root is the distance), and it fails if even the nearest language
is far.  Short texts are not compared: below a number of words the divergence
of a clean text is mostly noise.

The references are counted over all rows of each language (a null lang is a
language of its own); every document is measured and judged whole.  Common
words are the most frequent words of each language without ASCII signs and
digits.  Only the finished references, some hundred numbers a language, go
through the driver; more than 1,000 languages raise an error.

Defined results: null texts are empty.  Rows are judged one by one, so rows
that repeat a doc_id or a text each get their result.  Languages of fewer than
1,000 words give no reference; without any, only the base rules
count.  Repeated windows are found by 64-bit hashes within a text.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import Scratch

WHITE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
SIGNS = r"[!-/:-@\[-`{-~]+"
#: Words with such a character are never common words.
UNWORDED = r"[\x00-@\[-`{-\x7F]"
#: The name of a column while rows are judged.
MEASURED = "_quality_measures"
REPEAT = 5
COMMON = 30
LANGUAGES = 1000
LEAST_REFERENCE = 1000
#: The least number of words and the largest divergence for character classes and for common words.
CLASS_WORDS, CLASS_LIMIT = 50, 0.08
COMMON_WORDS, COMMON_LIMIT = 150, 0.115


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def _covered(windows: Column) -> Column:
    """How many words the windows cover that occur more than once; windows are hashes by start."""

    def repeated(order: Column) -> Column:
        twice = lambda x, i: F.coalesce(x.h == F.get(order, i - 1).h, F.lit(False)) | F.coalesce(x.h == F.get(order, i + 1).h, F.lit(False))
        return F.sort_array(F.transform(F.filter(order, twice), lambda x: x.at))

    starts = _let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))), repeated)
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-REPEAT).alias("last"))
    add = lambda acc, at: F.struct((acc.n + F.least(F.lit(REPEAT), at - acc["last"])).alias("n"), at.alias("last"))
    return F.aggregate(starts, none, add)["n"]


def _repeated_words(words: Column) -> Column:
    """Words in windows of 5 that occur twice or more: hashes of 2, of 4 and of 5 words come from those before."""
    none, both = F.lit(0).cast("long"), lambda x, y: F.xxhash64(x, y)
    later = lambda a, k: F.slice(a, k + 1, F.size(words))

    def of(one: Column) -> Column:
        two = F.zip_with(one, later(one, 1), both)
        four = _let(two, lambda a: F.zip_with(a, later(a, 2), both))
        windows = F.slice(F.zip_with(four, later(one, 4), both), 1, F.size(words) - (REPEAT - 1))
        return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), none).otherwise(_covered(w)))

    return F.when(F.size(words) <= REPEAT, none).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), of))


def words_of(text: Column) -> Column:
    """The text's words; without any, one empty word."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE)), SPACES)


def _dup_lines(text: Column) -> Column:
    worded = lambda x: F.filter(x, lambda line: F.btrim(line, F.lit(WHITE)) != "")
    fewer = lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")
    return _let(F.split(text, "\n"), lambda x: F.when(F.size(x) == F.size(F.array_distinct(x)), F.lit(0).cast("long")).otherwise(_let(worded(x), fewer)))


def _n_words(words: Column) -> Column:
    return F.when(F.get(words, 0) == "", 0).otherwise(F.size(words)).cast("long")


def _word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def _signs(text: Column) -> Column:
    """Counts of the few characters that are neither a-z, space, newline nor beyond ASCII."""

    def counts(rare: Column) -> Column:
        count = lambda pattern: F.length(rare).cast("long") - _without(rare, pattern)
        return F.struct(*(count(p).alias(k) for k, p in (("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", SYMBOLS), ("sign", SIGNS))))

    return _let(F.regexp_replace(text, r"[a-z \n\u0080-\uFFFF]+", ""), counts)


def _classes(text: Column, word_chars: Column, s: Column) -> Column:
    """Octets of upper-case letters, digits, white space, symbols, other ASCII signs, of characters beyond ASCII after their first, and the rest."""
    white, beyond, total = F.length(text).cast("long") - word_chars, (F.octet_length(text) - F.length(text)).cast("long"), F.octet_length(text).cast("long")
    return F.array(s.upper, s.digit, white, s.symbol, s.sign - s.symbol, beyond, total - s.upper - s.digit - white - s.sign - beyond)


def measures(text: Column, common: list[str] = ()) -> Column:
    """A struct of a text's counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes and hits.

    hits: the words that are in ``common``, sorted, of texts long enough.
    """
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        hits = F.when(F.size(words) >= COMMON_WORDS, F.sort_array(F.filter(words, lambda w: w.isin(list(common))))) if common else F.lit(None).cast("array<string>")
        return F.struct(_n_words(words).alias("n_words"), _word_chars(words).alias("word_chars"), _repeated_words(words).alias("n_repeat_words"), hits.alias("hits"))

    def joined(w: Column, s: Column) -> Column:
        return F.struct(w.n_words, w.word_chars, s.symbol.alias("n_symbols"), _dup_lines(text).alias("n_dup_lines"), w.n_repeat_words, _classes(text, w.word_chars, s).alias("classes"), w.hits)

    return _let(_let(words_of(text), of), lambda w: _let(_signs(text), lambda s: joined(w, s)))


def references(docs: DataFrame) -> list[dict]:
    """For each language its shares of the classes, of the common words of all languages, and of other words.

    All rows are counted.
    """
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    text = F.col("text")
    counted = _let(words_of(text), lambda words: _let(_signs(text), lambda s: F.struct(_n_words(words).alias("n_words"), _classes(text, _word_chars(words), s).alias("classes"))))
    sums = own.select("lang", counted.alias("m")).groupBy("lang").agg(F.sum("m.n_words").alias("n"), *(F.sum(F.col("m.classes")[i]).alias(f"c{i}") for i in range(7))).limit(LANGUAGES + 1).collect()
    if len(sums) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    found = {r.lang: {"total": r.n, "classes": [r[f"c{i}"] / (sum(r[f"c{i}"] for i in range(7)) or 1) for i in range(7)], "words": {}} for r in sums if r.n >= LEAST_REFERENCE}
    held = Scratch(docs.sparkSession, "quality").table(
        own.select("lang", F.explode(words_of(text)).alias("word")).where(~F.col("word").rlike(UNWORDED) & (F.col("word") != "")).groupBy("lang", "word").agg(F.count("*").alias("n")).where(F.col("lang").isin(list(found))), "words"
    )
    first = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    common = held.withColumn("place", F.row_number().over(first)).where(f"place <= {COMMON}").select("word").distinct()
    for r in held.join(common, "word").collect():  # COMMON words a language at most, in each language
        found[r.lang]["words"][r.word] = r.n / found[r.lang]["total"]
    return [{"lang": lang, "classes": m["classes"], "words": m["words"], "other": 1 - sum(m["words"].values())} for lang, m in found.items()]


def _term(p: Column, q: Column) -> Column:
    """What a class that the text has adds to the divergence."""
    mean = (p + q) / 2
    return p / 2 * F.log2(p / mean) + F.when(q > 0, q / 2 * F.log2(q / mean)).otherwise(0.0)


def divergence(shares: Column, of: Callable[[Column], Column]) -> Column:
    """Jensen-Shannon divergence of a histogram, an array of (key, p > 0), from the reference shares of(key).

    Keys that the histogram lacks add half of their share of the reference.
    """
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q"))
    add = lambda acc, x: _let(of(x.key), lambda q: F.struct((acc.d + _term(x.p, q)).alias("d"), (acc.q + q).alias("q")))
    return F.aggregate(shares, zero, add, lambda acc: acc.d + F.greatest(F.lit(0.0), 1 - acc.q) / 2)


def _nearest(shares: Column, lang: Column, refs: Column, of: Callable[[Column, Column], Column], limit: float) -> Column:
    """The divergence from the text's own language if that is within the limit, else the least of all languages."""
    far = lambda r: divergence(shares, lambda key: of(r, key))
    own = F.array_min(F.transform(F.filter(refs, lambda r: r.lang == lang), far))
    return _let(own, lambda d: F.when(d <= limit, d).otherwise(F.array_min(F.transform(refs, far))))


def _class_shares(classes: Column) -> Column:
    total = F.aggregate(classes, F.lit(0).cast("long"), lambda a, x: a + x)
    shares = lambda n: F.transform(classes, lambda x, i: F.struct(i.alias("key"), (x / n).alias("p")))
    return F.filter(_let(total, shares), lambda s: s.p > 0)


def _word_shares(hits: Column, n_words: Column) -> Column:
    """Of sorted hits, where a word's count is the distance to the next word's first place, and of all other words."""

    def listed(starts: Column) -> Column:
        count = lambda x, i: F.coalesce(F.get(starts, i + 1)["at"], F.size(hits) + 1) - x["at"]
        return F.transform(starts, lambda x, i: F.struct(x.w.alias("key"), (count(x, i) / n_words).alias("p")))

    starts = F.transform(F.array_distinct(hits), lambda w: F.struct(w.alias("w"), F.array_position(hits, w).cast("int").alias("at")))
    other = F.struct(F.lit("").alias("key"), ((n_words - F.size(hits)) / n_words).alias("p"))
    return F.filter(F.concat(_let(starts, listed), F.array(other)), lambda s: s.p > 0)


def judge(docs: DataFrame) -> DataFrame:
    """The rows of docs with their counts, base_failed, class_divergence, word_divergence (null if not compared) and kept.

    Columns of docs named like these are replaced.
    """
    model = references(docs)
    common = sorted({w for m in model for w in m["words"]})
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_divergence", "word_divergence", "kept")
    base = docs.drop(*made, MEASURED).withColumn(MEASURED, measures(F.col("text").cast("string"), common))
    n, repeated = F.col(f"{MEASURED}.n_words"), F.col(f"{MEASURED}.n_repeat_words")
    base = base.withColumns({c: F.col(f"{MEASURED}.{c}") for c in made[:5]} | {"base_failed": (n < 10) | (100 * repeated > 20 * n)})
    if not model:
        none = F.lit(None).cast("double")
        return base.withColumns({"class_divergence": none, "word_divergence": none, "kept": ~F.col("base_failed")}).drop(MEASURED)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    refs = F.from_json(F.lit(json.dumps(model)), "array<struct<lang: string, classes: array<double>, words: map<string, double>, other: double>>")
    share = lambda r, key: F.when(key == "", r.other).otherwise(F.coalesce(F.try_element_at(r.words, key), F.lit(0.0)))
    by_class = _let(_class_shares(F.col(f"{MEASURED}.classes")), lambda s: _nearest(s, lang, refs, lambda r, key: F.get(r.classes, key), CLASS_LIMIT))
    by_word = _let(_word_shares(F.col(f"{MEASURED}.hits"), n), lambda s: _nearest(s, lang, refs, share, COMMON_LIMIT))
    judged = base.withColumns({"class_divergence": F.when(~F.col("base_failed") & (n >= CLASS_WORDS), by_class), "word_divergence": F.when(~F.col("base_failed") & (n >= COMMON_WORDS), by_word)})
    far = (F.coalesce("class_divergence", F.lit(0.0)) > CLASS_LIMIT) | (F.coalesce("word_divergence", F.lit(0.0)) > COMMON_LIMIT)
    return judged.withColumn("kept", ~F.col("base_failed") & ~far).drop(MEASURED)
