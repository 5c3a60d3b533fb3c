"""Fuzzy matching: variations, string scorers and TF-IDF cosine (FUZ01-FUZ10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv, normalize as nz, similarity as sim

#: Room for rounding where candidates are bounded.
EPSILON = 1e-5


def index(concepts: DataFrame) -> DataFrame:
    """SRC03: (variation, id, code, display); of equal variations the last concept's.

    Inactive concepts are indexed too; synonyms only widen the query's side.
    """
    last = concepts.groupBy(F.lower("term").alias("t")).agg(F.max(F.struct("id", "code", "display")).alias("m"))
    spread = last.select("m", F.explode(nz.variations(F.col("t"))).alias("variation"))
    return spread.groupBy("variation").agg(F.max("m").alias("m")).select("variation", "m.*")


def by_variation(terms: DataFrame, indexed: DataFrame, synonyms: Column | None = None) -> DataFrame:
    """FUZ01: (term_id, variation, code, display) with score 100: the term itself first, then by letters."""
    asked = terms.select("term_id", nz.clean(F.col("term")).alias("q"), (synonyms if synonyms is not None else F.lit(None).cast("array<string>")).alias("s"))
    spread = asked.select("q", "s").distinct().select("q", F.explode(nz.variations(F.col("q"), F.col("s"))).alias("variation"))
    hits = spread.join(indexed, "variation")
    best = hits.groupBy("q").agg(F.min(F.struct((F.col("variation") != F.col("q")).alias("other"), "variation", "code", "display")).alias("m"))
    return asked.join(best, "q").select("term_id", "m.variation", "m.code", "m.display", F.lit(100.0).alias("score"))


def _bigrams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(2))))


#: Queries of so many letters or fewer also meet keys on single letters.
SHORT = 3


def _letters(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1))))


def _single_tokens(text: Column) -> Column:
    """Tokens of one letter, marked so that they meet each other only."""
    return F.transform(F.filter(F.array_distinct(F.split(text, r"\s+")), lambda t: F.length(t) == 1), lambda t: F.concat(F.lit("\x02"), t))


def candidates(queries: DataFrame, keys: DataFrame, least: float = 0.0) -> DataFrame:
    """(q, key): distinct pairs that share two neighbouring letters, a letter if the query is short or the key is one, or a token of one letter.

    With ``least`` above 0, 2 * min(|q|, |key|) / (|q| + |key|), which bounds an
    indel or difflib ratio, must reach it.  No pair with such a ratio of 0.8 or
    more is missed: if no two neighbouring letters are shared, n matching
    letters need n - 1 others between them, so the ratio is at most
    2n / (3n - 1), which reaches 0.8 for n up to 2 alone.  Keys of one letter
    are part of any query that holds it; tokens of one letter have no two
    neighbouring letters to share.
    """
    marked = lambda letters: F.transform(letters, lambda x: F.concat(F.lit("\x01"), x))
    q, key = F.col("q"), F.col("key")
    long_query = F.concat(_bigrams(q), marked(_letters(q)), _single_tokens(q))
    grams = F.when(F.length("q") <= SHORT, F.array_union(F.array_union(_bigrams(q), _letters(q)), _single_tokens(q))).otherwise(long_query)
    a = queries.select("q").where("q <> ''").distinct().withColumn("gram", F.explode(grams))
    own = F.concat(F.array_union(_bigrams(key), _letters(key)), _single_tokens(key))
    b = keys.select("key").where("key <> ''").distinct().withColumn("gram", F.explode(F.when(F.length("key") == 1, F.concat(own, marked(_letters(key)))).otherwise(own)))
    shorter, both = F.least(F.length("q"), F.length("key")), F.length("q") + F.length("key")
    return a.join(b, "gram").where(2 * shorter / both >= least).select("q", "key").distinct()


def _numbered_letters(text: Column) -> Column:
    """The text's letters, each numbered among its equals; high numbers, which few texts have, first."""
    letters = F.array_sort(F.filter(F.split(text, ""), lambda x: x != ""))
    return F.sort_array(F.transform(letters, lambda x, i: F.struct((i + 2 - F.array_position(letters, x)).cast("int").alias("n"), x.alias("x"))), asc=False)


def jaro_winkler_candidates(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(q, key): distinct pairs of non-empty texts; none with a Jaro-Winkler similarity of 0.9 or more is missed.

    Of lengths a and b with m matching letters, Jaro is at most
    (m / a + m / b + 1) / 3.  0.9 takes a Jaro of 5/6 if the first four letters
    are equal, of 6/7 else; so m / a + m / b reaches 3/2 or 11/7 (a little less
    here, as similarities are rounded), and the texts share so many numbered
    letters.  Pairs meet on their first four letters, or on their lengths and a
    numbered letter of both prefixes: two sets that share t of a and b elements
    share one of the first a - t + 1 and b - t + 1 in a common order.
    """
    a = queries.select("q").where("q <> ''").distinct().select("q", F.length("q").alias("a"), _numbered_letters(F.col("q")).alias("x"))
    b = keys.select("key").where("key <> ''").distinct().select("key", F.length("key").alias("b"), _numbered_letters(F.col("key")).alias("y"))
    lengths = a.select("a").distinct().crossJoin(b.select("b").distinct())  # as many rows as pairs of lengths
    shares = lambda least: F.ceil(least * F.col("a") * F.col("b") / (F.col("a") + F.col("b"))).cast("int")
    near = lengths.withColumn("t", shares(1.57)).where("t <= least(a, b)")
    one = a.join(near, "a").select("q", "a", "b", "x", F.explode(F.expr("slice(x, 1, a - t + 1)")).alias("letter"))
    two = b.join(near, "b").select("key", "a", "b", "y", F.explode(F.expr("slice(y, 1, b - t + 1)")).alias("letter"))
    # a pair is kept where it meets first
    met = one.join(two, ["a", "b", "letter"]).where((F.size(F.array_intersect("x", "y")) >= shares(1.57)) & (F.element_at(F.array_intersect("x", "y"), 1) == F.col("letter"))).select("q", "key")
    start = lambda c: F.substring(c, 1, 4)
    alike = a.where("a >= 4").join(b.where("b >= 4"), start("q") == start("key")).where(F.size(F.array_intersect("x", "y")) >= shares(1.499)).select("q", "key")
    return met.union(alike).distinct()


def letter_candidates(queries: DataFrame, keys: DataFrame, least: Column) -> DataFrame:
    """(q, key): the distinct pairs of non-empty texts that share at least ``least`` letters, counted with repeats; none is missed.

    least: a Column of the lengths a (of q) and b (of key).  Two sets that
    share t of a and b elements share one of the first a - t + 1 and b - t + 1
    in a common order, so pairs meet on their lengths and a numbered letter of
    both prefixes, rare letters first.
    """
    a = queries.select("q").where("q <> ''").distinct().select("q", F.length("q").alias("a"), _numbered_letters(F.col("q")).alias("x"))
    b = keys.select("key").where("key <> ''").distinct().select("key", F.length("key").alias("b"), _numbered_letters(F.col("key")).alias("y"))
    lengths = a.select("a").distinct().crossJoin(b.select("b").distinct())  # as many rows as pairs of lengths
    near = lengths.withColumn("t", F.greatest(least.cast("int"), F.lit(1))).where("t <= least(a, b)")
    one = a.join(near, "a").select("q", "a", "b", "t", "x", F.explode(F.expr("slice(x, 1, a - t + 1)")).alias("letter"))
    two = b.join(near, "b").select("key", "a", "b", "y", F.explode(F.expr("slice(y, 1, b - t + 1)")).alias("letter"))
    both = F.array_intersect("x", "y")
    # a pair is kept where it meets first
    met = one.join(two, ["a", "b", "letter"]).where((F.size(both) >= F.col("t")) & (F.element_at(both, 1) == F.col("letter")))
    return met.select("q", "key")


#: The algorithms that a request may name, in the order that settles ties.
ALGORITHMS = ("levenshtein", "jaro_winkler", "token_sort_ratio", "token_set_ratio", "phonetic")
#: Scores of texts that sound alike by the consonant key, and by Soundex only.
SOUNDS_ALIKE, SOUNDEX_ALIKE = 0.9, 0.8
_ROUNDING = 1e-6


def _token_text(text: Column, distinct: bool) -> Column:
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.array_join(F.array_sort(F.array_distinct(tokens) if distinct else tokens), " ")


def _token_pairs(queries: DataFrame, keys: DataFrame, threshold: float, distinct: bool) -> DataFrame:
    """(q, key) whose sorted tokens, as texts, may have a ratio of the threshold or more: 2 m >= t (a + b) letters are shared."""
    q = queries.select("q", _token_text(F.col("q"), distinct).alias("s")).distinct()
    k = keys.select("key", _token_text(F.col("key"), distinct).alias("s")).distinct()
    least = F.ceil((threshold - _ROUNDING) * (F.col("a") + F.col("b")) / 2)
    met = letter_candidates(q.select(F.col("s").alias("q")), k.select(F.col("s").alias("key")), least).select(F.col("q").alias("s"), F.col("key").alias("s2"))
    return q.join(met, "s").join(k.withColumnRenamed("s", "s2"), "s2").select("q", "key")


def _similar(queries: DataFrame, keys: DataFrame, name: str, threshold: float) -> DataFrame:
    """(q, key, score): all pairs whose score, from 0 to 1, reaches the threshold, for one algorithm."""
    a, b = F.col("a"), F.col("b")
    if name == "phonetic":
        sounds = lambda c: F.array(F.concat(F.lit("1"), sim.phonetic(c)), F.concat(F.lit("2"), F.soundex(c)))
        spread = lambda df, c: df.select(c).distinct().select(c, F.explode(sounds(F.col(c))).alias("sound")).where("length(sound) > 1")
        score = F.when(F.startswith("sound", F.lit("1")), SOUNDS_ALIKE).otherwise(SOUNDEX_ALIKE)
        # Soundex gives texts back that begin with no letter; those are alike only if equal
        met = spread(queries, "q").join(spread(keys, "key"), "sound").groupBy("q", "key").agg(F.max(score).alias("score"))
        return met.where(F.col("score") >= threshold)
    if name == "levenshtein":
        longer = F.greatest(a, b)
        pairs = letter_candidates(queries, keys, longer - F.floor((1 - threshold) * longer + _ROUNDING))
        score = 1 - F.levenshtein("q", "key") / F.greatest(F.length("q"), F.length("key"))
    elif name == "jaro_winkler":
        # a prefix of p equal letters, up to 4, adds p / 10 of what Jaro lacks to 1
        jaro = lambda p: (threshold - p / 10) / (1 - p / 10)
        shares = lambda j: F.ceil((3 * j - 1 - _ROUNDING) * a * b / (a + b))
        start = lambda c: F.substring(c, 1, 4)
        pairs = letter_candidates(queries, keys, shares(jaro(3)))
        long = queries.where("length(q) >= 4").select("q").distinct().join(keys.where("length(key) >= 4").select("key").distinct(), start("q") == start("key"))
        pairs = pairs.union(long).distinct()
        score = sim.scorer("jaro_winkler")("q", "key")
    elif name == "token_sort_ratio":
        pairs, score = _token_pairs(queries, keys, threshold, False), sim.scorer(name)("q", "key") / 100
    else:
        tokens = lambda df, c: df.select(c).distinct().select(c, F.explode(F.array_distinct(F.filter(F.split(c, r"\s+"), lambda t: t != ""))).alias("token"))
        shared = tokens(queries, "q").join(tokens(keys, "key"), "token").select("q", "key")
        pairs, score = shared.union(_token_pairs(queries, keys, threshold, True)).distinct(), sim.scorer(name)("q", "key") / 100
    return pairs.select("q", "key", F.round(score, 6).alias("score")).where(F.col("score") >= threshold)


def by_algorithms(queries: DataFrame, keys: DataFrame, algorithms: tuple[str, ...] = ("all",), threshold: float = 0.7, most: int = 10) -> DataFrame:
    """FUZ10: (q, key, algorithm, score, rank): each query's best keys by the algorithms asked for, from the threshold on.

    Of a key that several algorithms find, the best score counts, ties by the
    order of ALGORITHMS; of keys with equal scores the first by letters ranks
    higher.  Candidates miss no pair at any threshold; lower ones only meet
    more of them.  Phonetic pairs sound alike and have fixed scores.
    """
    names = ALGORITHMS if "all" in algorithms else tuple(algorithms)
    wrong = set(names) - set(ALGORITHMS)
    if wrong or not names:
        raise ValueError(f"unsupported algorithms: {sorted(wrong)}")
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    found = None
    for place, name in enumerate(ALGORITHMS):
        if name in names:
            one = _similar(queries, keys, name, threshold).select("q", "key", F.struct((-F.col("score")).alias("s"), F.lit(place).alias("place"), F.lit(name).alias("algorithm")).alias("m"))
            found = one if found is None else found.unionByName(one)
    top = found.groupBy("q", "key").agg(F.min("m").alias("m")).select("q", "key", "m.algorithm", (-F.col("m.s")).alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    return top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def scored(queries: DataFrame, keys: DataFrame, scorers: dict[str, float], least: float = 0.0) -> DataFrame:
    """(q, key, method, score): pairs that reach their method's threshold, scores from 0 to 100.

    The difflib ratio counts letters that both texts have, so if nothing else
    is asked for, pairs meet on rare letters.
    """
    if set(scorers) == {"difflib_ratio"}:
        pairs = letter_candidates(queries, keys, F.ceil((max(least, scorers["difflib_ratio"]) - _ROUNDING) * (F.col("a") + F.col("b")) / 2))
    else:
        pairs = candidates(queries, keys, least)
    columns = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("method"), sim.scorer(n)("q", "key").alias("score"), F.lit(t).alias("least")) for i, (n, t) in enumerate(scorers.items())]
    return pairs.select("q", "key", F.explode(F.array(*columns)).alias("x")).select("q", "key", "x.*").where("score >= least")


def best_of(found: DataFrame) -> DataFrame:
    """FUZ02: one row a query: the best score, then the first method, then the key by letters."""
    return found.groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("s"), "place", "key", "method")).alias("m")).select("q", "m.key", "m.method", (-F.col("m.s")).alias("score"))


def library_scorers() -> dict[str, float]:
    t = fv.THRESHOLDS
    return {"ratio": t["ratio"], "partial_ratio": t["partial"], "token_sort_ratio": t["token_sort"], "token_set_ratio": t["token_sort"]}


def token_jaccard(queries: DataFrame, keys: DataFrame, least: float = fv.THRESHOLDS["jaccard"]) -> DataFrame:
    """FUZ03: (q, key, jaccard) of token sets of at least that Jaccard similarity.

    With tokens in one order, the keys' rarest first, two such sets share one
    of their first ``n - ceil(least * n) + 1`` tokens.  Pairs meet on those, so
    a token that many keys hold brings few of them together.
    """
    tokens = lambda c: F.array_distinct(F.filter(F.split(nz.collapse(F.lower(c)), " "), lambda t: t != ""))
    a = queries.select("q").distinct().withColumn("t", F.explode(tokens("q")))
    b = keys.select("key").distinct().withColumn("t", F.explode(tokens("key")))
    often = b.groupBy("t").agg(F.count("*").alias("df"))

    def ordered(rows: DataFrame, key: str, name: str) -> DataFrame:
        known = rows.join(often, "t", "left").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("o"))
        first = F.size("o") - F.ceil(F.size("o") * least - EPSILON) + 1
        return known.select(key, F.transform("o", lambda x: x.t).alias(name), F.explode(F.transform(F.slice("o", 1, F.greatest(first, F.lit(1)).cast("int")), lambda x: x.t)).alias("t"))

    pairs = ordered(a, "q", "qt").join(ordered(b, "key", "kt"), "t").where(F.least(F.size("qt"), F.size("kt")) >= F.greatest(F.size("qt"), F.size("kt")) * least - EPSILON)
    return pairs.select("q", "key", "qt", "kt").distinct().select("q", "key", sim.jaccard(F.col("qt"), F.col("kt")).alias("jaccard")).where(F.col("jaccard") >= least)


def _weights(texts: DataFrame, key: str, idf: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    tokens = nz.tokenize(F.col(key))
    two = F.when(F.size(tokens) > 1, F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1)))).otherwise(F.array().cast("array<string>"))
    tf = texts.select(key).distinct().select(key, F.explode(F.concat(tokens, two)).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))
    if idf is None:
        n = texts.select(key).distinct().agg(F.count("*").alias("n"))
        idf = tf.groupBy("gram").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("gram", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, "gram").withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "gram", (F.col("w") / F.col("norm")).alias("w")), idf


def tfidf(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FUZ04: ((key, gram, w), (gram, idf)) of one- and two-word grams: smooth idf, raw counts, unit length."""
    return _weights(keys, "key", None)


def _vectors(weights: DataFrame, key: str, idf: DataFrame, least: float) -> DataFrame:
    """(key, v, n): a text's (idf, gram, w), the commonest grams first, of which the first n are shorter than ``least`` together."""
    v = weights.join(idf, "gram").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idf", "gram", "w"))).alias("v"))
    none = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    add = lambda acc, x: F.struct((acc.s + x.w * x.w).alias("s"), (acc.n + (acc.s + x.w * x.w < max(least, 0.0) ** 2).cast("int")).alias("n"))
    return v.withColumn("n", F.aggregate("v", none, add, lambda acc: acc.n))


def _dot(a: Column, b: Column) -> Column:
    weights = F.map_from_entries(F.transform(b, lambda x: F.struct(x.gram, x.w)))
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.w * F.coalesce(F.try_element_at(weights, x.gram), F.lit(0.0)))


def cosine(queries: DataFrame, fitted: tuple[DataFrame, DataFrame], least: float = fv.THRESHOLDS["cosine"]) -> DataFrame:
    """FUZ05: (q, key, cosine): each query's nearest key, ties by letters, from ``least`` on.

    Vectors have length 1, so what two of them share among grams that are
    shorter than ``least`` together can't suffice.  Both leave out their
    commonest grams up to that length and meet on the others; the whole
    vectors decide.
    """
    weights, idf = fitted
    mine, _ = _weights(queries, "q", idf)
    a, b = _vectors(mine, "q", idf, least - EPSILON), _vectors(weights, "key", idf, least - EPSILON)
    rare = lambda df, key: df.select(key, F.explode(F.transform(F.slice("v", F.col("n") + 1, F.size("v")), lambda x: x.gram)).alias("gram"))
    pairs = rare(a, "q").join(rare(b, "key"), "gram").select("q", "key").distinct()
    met = pairs.join(a.select("q", F.col("v").alias("va")), "q").join(b.select("key", F.col("v").alias("vb")), "key")
    sums = met.select("q", "key", F.round(_dot(F.col("va"), F.col("vb")), 6).alias("cosine"))
    return sums.where(F.col("cosine") >= least).groupBy("q").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "key")).alias("m")).select("q", "m.key", (-F.col("m.c")).alias("cosine"))


def search(terms: DataFrame, concepts: DataFrame, per_variation: int = 20, limit: int = 10, least: float = fv.THRESHOLDS["difflib"]) -> DataFrame:
    """FUZ07: (term_id, code, score, rank): concepts containing a variation of three letters or more.

    Each distinct query is searched once.  Concepts of one term score alike, so
    of each term only the ``limit`` least codes can be among a query's first.
    """
    from .lookup import contains_pairs

    asked = terms.select("term_id", nz.clean(F.col("term")).alias("q"))
    spread = asked.select("q").distinct().select("q", F.explode(nz.variations(F.col("q"))).alias("v")).where("length(v) >= 3")
    pairs = contains_pairs(spread.select(F.col("v").alias("q")), concepts.select(F.lower("term").alias("key"), "id")).select(F.col("q").alias("v"), "key", F.col("id").alias("first"))
    kept = pairs.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("first"))).where(F.col("n") <= per_variation)
    hits = spread.join(kept, "v").select("q", "key").distinct()
    rated = hits.withColumn("score", F.round(sim.scorer("difflib_ratio")("q", "key"), 6)).where(F.col("score") >= least)
    first = Window.partitionBy("key").orderBy("code")
    coded = concepts.select(F.lower("term").alias("key"), "code").withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= limit).select("key", "code").distinct()
    best = rated.join(coded, "key").groupBy("q", "code").agg(F.max("score").alias("score"))
    of_query = best.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "code"))).where(F.col("n") <= limit).drop("n")
    found = asked.distinct().join(of_query, "q").groupBy("term_id", "code").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("term_id").orderBy(F.desc("score"), "code"))).where(F.col("rank") <= limit)


def levenshtein_within(queries: DataFrame, keys: DataFrame, most: int = 2) -> DataFrame:
    """FUZ10: (q, key, distance) within ``most`` edits; pairs meet on length and one of most + 1 pieces of the key.

    Of a key cut into most + 1 pieces, one is untouched by ``most`` edits and
    shifted by at most that many places.
    """
    length = F.length("key")
    pieces = F.array(*[F.struct(F.lit(i).alias("i"), F.substr("key", (length * i / (most + 1)).cast("int") + 1, (length * (i + 1) / (most + 1)).cast("int") - (length * i / (most + 1)).cast("int")).alias("piece"), (length * i / (most + 1)).cast("int").alias("at")) for i in range(most + 1)])
    b = keys.select("key").distinct().withColumn("n", length).select("key", "n", F.explode(pieces).alias("p")).select("key", "n", "p.*")
    a = queries.select("q").distinct()
    probe = a.withColumn("n", F.explode(F.sequence(F.greatest(F.length("q") - most, F.lit(0)), F.length("q") + most))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(most))))
    start, size = (F.col("n") * F.col("i") / (most + 1)).cast("int"), (F.col("n") * (F.col("i") + 1) / (most + 1)).cast("int") - (F.col("n") * F.col("i") / (most + 1)).cast("int")
    probe = probe.withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most)))).where(start + F.col("shift") >= 0).select("q", "n", "i", F.substr("q", start + F.col("shift") + 1, size).alias("piece")).distinct()
    pairs = probe.join(b, ["n", "i", "piece"]).select("q", "key").distinct()
    return pairs.withColumn("distance", F.levenshtein("q", "key", most)).where("distance >= 0")


def add_synonyms(sets: DataFrame, added: DataFrame) -> DataFrame:
    """FUZ09: sets (set_key, synonyms) with (term, synonyms) merged into the set that holds the term, else as sets of their own."""
    member = sets.select("set_key", F.explode("synonyms").alias("term")).groupBy("term").agg(F.min("set_key").alias("set_key"))
    named = added.join(member, "term", "left").select(F.coalesce("set_key", F.concat(F.lit("syn_set_"), "term")).alias("set_key"), F.concat(F.array("term"), "synonyms").alias("new"))
    merged = named.groupBy("set_key").agg(F.array_distinct(F.flatten(F.sort_array(F.collect_list("new")))).alias("new"))
    none = F.array().cast("array<string>")
    return sets.join(merged, "set_key", "full").select("set_key", F.array_distinct(F.concat(F.coalesce("synonyms", none), F.coalesce("new", none))).alias("synonyms"))
