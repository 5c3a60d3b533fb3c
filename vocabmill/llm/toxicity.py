"""Toxicity by weak supervision.

Voters look for terms of a lexicon or for a pattern and vote toxic, clean or
not at all.  Some lexicons are fixed, others are mined from labelled learning
rows: each is a greedy cover of the toxic ones by letter sequences that clean
ones don't hold, none of them used by another lexicon.  Half of the mined
voters look for a term at all, half for one that is frequent in the text.  A
generative label model, which sees no labels, estimates by expectation
maximisation how each voter votes in either class and
how voters depend on one another: given the class, each voter depends on one
other, along the tree of the strongest correlations (Chow and Liu, 1968).  Its
posterior labels train a logistic regression on the voters' hit counts; that
alone scores documents.

No row's own label takes part in its votes while these are fitted: lexicons
are mined from one half of the rows, the other half is voted on.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._shared import Scratch, slices, texts_as_bytes

#: About so many labelled rows, half of them toxic if there are enough, chosen by hash, are learned from.
LEARN_ROWS = 8000
MINED_VOTERS, TERM_LENGTHS = 4, (4, 5, 6)
#: A term is frequent in a text with at least two occurrences, and this share of its words.
FREQUENT = 0.007
MIN_SHARE, MAX_CLEAN = 0.01, 0.02

#: Fixed lexicons.
LEXICONS = {
    "insult_nouns": ("idiot", "moron", "loser", "clown", "scum", "trash", "fool", "jerk", "imbecile", "bastard", "freak", "vermin", "creep", "coward"),
    "insult_adjectives": ("stupid", "worthless", "pathetic", "disgusting", "dumb", "ugly", "useless", "filthy", "brainless", "repulsive"),
    "profanity": ("shit", "fuck", "fucking", "bitch", "asshole", "crap", "damn", "bullshit"),
    "threats": ("kill you", "kill yourself", "shut up", "go to hell", "hate you", "drop dead", "beat you up"),
}
PATTERNS = {
    "second_person_insult": re.compile(r"\byou(?:'re| are)? (?:an? |such an? )?(?:\w+ )?(?:idiot|moron|loser|clown|fool|freak|disgrace)\b"),
    "shouting": re.compile(r"!{3,}"),
}


def plain(text: str) -> str:
    """Lower-cased words of letters, one space around each."""
    return re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")


def least_count(n_words: int, frequent: bool) -> float:
    """How often a term must occur to count as held."""
    return max(2.0, FREQUENT * n_words) if frequent else 1.0


def terms_of(text: str, frequent: bool) -> list[str]:
    """The letter sequences held, inside words or at their start (with a space before)."""
    words = plain(text).split()
    found: Counter = Counter()
    for word, times in Counter(words).items():
        marked = f" {word}"
        for n in TERM_LENGTHS:
            for i in range(len(marked) - n + 1):
                found[marked[i : i + n]] += times
    least = least_count(len(words), frequent)
    return [t for t, n in found.items() if n >= least]


@dataclass
class Voters:
    """Lexicons by name, searched in one pass by an automaton, and patterns."""

    lexicons: dict[str, tuple[str, ...]]
    both_ways: set[str] = field(default_factory=set)  # these vote clean where they find nothing
    automaton: object = None

    @property
    def frequent(self) -> set[int]:
        return {j for j, n in enumerate(self.lexicons) if n.startswith("frequent")}

    @property
    def names(self) -> list[str]:
        return [*self.lexicons, *PATTERNS]

    def __getstate__(self):
        return {"lexicons": self.lexicons, "both_ways": self.both_ways, "automaton": None}

    def _search(self):
        if self.automaton is None:
            import ahocorasick

            places: dict[str, list[int]] = {}
            for j, terms in enumerate(self.lexicons.values()):
                for term in terms:
                    places.setdefault(term, []).append(j)
            self.automaton = ahocorasick.Automaton()
            for term, js in places.items():
                self.automaton.add_word(term, (term, tuple(js)))
            if places:
                self.automaton.make_automaton()
        return self.automaton

    def hits(self, text: str) -> np.ndarray:
        """What each voter finds, and the number of words at the end.

        That is how often terms or patterns occur; for voters on frequent
        terms, the count of the most frequent term if it is held.
        """
        out = np.zeros(len(self.names) + 1)
        shown = plain(text)
        out[-1] = words = shown.count(" ") - 1
        found = self._search()
        if len(found):
            least, frequent = least_count(words, True), self.frequent
            for (term, js), times in Counter(x for _, x in found.iter(shown)).items():
                for j in js:
                    if j not in frequent:
                        out[j] += times
                    elif times >= least:
                        out[j] = max(out[j], times)
        lower = text.lower()
        for j, pattern in enumerate(PATTERNS.values(), len(self.lexicons)):
            out[j] = sum(1 for _ in pattern.finditer(lower))
        return out

    def votes(self, hits: np.ndarray) -> np.ndarray:
        """1 toxic, 0 clean, -1 none, for rows of hits."""
        both = np.array([n in self.both_ways for n in self.names])
        found = hits[:, :-1] > 0
        return np.where(found, 1, np.where(both & (hits[:, -1:] > 0), 0, -1))


class LabelModel:
    """A latent class model of votes with a tree of dependencies, fitted by EM.

    rates[y, j, v]: how often voter j votes v (0 clean, 1 toxic, 2 not at all)
    in class y, so the accuracies.  parent[j]: the voter on which j depends
    given the class, or -1; tables[j][y, u, v]: how often j votes v where its
    parent votes u.  Correlations are part of the model: they are estimated
    anew with the rates in each round.
    """

    def __init__(self, prior: float, rounds: int = 60) -> None:
        self.prior, self.rounds = min(max(prior, 1e-3), 0.5), rounds

    @staticmethod
    def _coded(votes: np.ndarray) -> np.ndarray:
        return np.where(votes < 0, 2, votes)

    def _estimate(self, coded: np.ndarray, q: np.ndarray) -> None:
        n, m = coded.shape
        hot = np.zeros((n, 3 * m))
        hot[np.arange(n)[:, None], coded + 3 * np.arange(m)] = 1.0
        pairs = np.stack([(hot * w[:, None]).T @ hot for w in (1 - q, q)]).reshape(2, m, 3, m, 3)
        mass = np.array([1 - q, q]).sum(axis=1)
        own = pairs[:, np.arange(m), :, np.arange(m), :].diagonal(axis1=2, axis2=3).transpose(1, 0, 2)
        self.rates = (own + 1 / 3) / (mass[:, None, None] + 1)
        self.parent = self._tree(pairs, mass)
        self.tables = []
        for j, i in enumerate(self.parent):
            given = np.repeat(self.rates[:, j, None, :], 3, axis=1)
            if i >= 0:
                joint = pairs[:, i, :, j, :]
                given = (joint + given) / (joint.sum(axis=2, keepdims=True) + 1)
            self.tables.append(given)

    def _tree(self, pairs: np.ndarray, mass: np.ndarray) -> list[int]:
        """Each voter's parent in the spanning tree of most mutual information given the class; -1 where there is next to none."""
        m = pairs.shape[1]
        joint = (pairs + 1 / 9) / (mass[:, None, None, None, None] + 1)
        apart = joint.sum(axis=4, keepdims=True) * joint.sum(axis=2, keepdims=True)
        shared = (mass[:, None, None, None, None] / mass.sum() * joint * np.log(joint / apart)).sum(axis=(0, 2, 4))
        self.dependence = shared
        least = 4.0 / mass.sum()  # about what independent voters show by chance
        parent, best, outside = [-1] * m, np.full(m, -1), set(range(m))
        gain = np.full(m, -np.inf)
        while outside:
            j = max(outside, key=lambda x: (gain[x], -x))
            outside.remove(j)
            if gain[j] > least:
                parent[j] = int(best[j])
            for x in outside:
                if shared[j, x] > gain[x]:
                    gain[x], best[x] = shared[j, x], j
        return parent

    def _logit(self, coded: np.ndarray) -> np.ndarray:
        out = np.full(len(coded), np.log(self.prior / (1 - self.prior)))
        for j, i in enumerate(self.parent):
            under = coded[:, i] if i >= 0 else np.zeros(len(coded), np.int64)
            ratio = np.log(self.tables[j][1] / self.tables[j][0])
            out += ratio[under, coded[:, j]]
        return out

    def fit(self, votes: np.ndarray) -> "LabelModel":
        coded = self._coded(votes)
        # to start with, voters that vote alike share one vote
        signed = np.where(votes == 1, 1.0, np.where(votes == 0, -1.0, 0.0))
        centred = signed - signed.mean(axis=0)
        size = np.maximum(np.sqrt((centred**2).sum(axis=0)), 1e-9)
        share = 1 / np.maximum(1.0, ((centred.T @ centred / np.outer(size, size)) ** 2).sum(axis=1))
        voted = np.maximum((votes >= 0) @ share, 1e-9)
        q = np.clip((votes == 1) @ share / voted, 0.02, 0.98)
        for _ in range(self.rounds):
            self._estimate(coded, q)
            fresh = self.posterior(votes)
            moved, q = np.abs(fresh - q).max(), fresh
            if moved < 1e-6:
                break
        return self

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit(self._coded(votes)), -30, 30)))


def features(hits: np.ndarray) -> np.ndarray:
    """A constant; each voter's presence, log count and log rate."""
    found, words = hits[:, :-1], np.maximum(hits[:, -1:], 1)
    return np.concatenate([np.ones((len(hits), 1)), found > 0, np.log1p(found), np.log1p(1000 * found / words)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights by Newton's method; y may be soft."""
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _count_terms(frequent: bool):
    def run(batches):
        """(term, n): how many of a task's texts hold each term."""
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for raw in texts_as_bytes(part):
                    counts.update(terms_of(raw.decode("utf-8"), frequent))
        items = list(counts.items())
        for a in range(0, len(items), 100_000):
            terms, n = zip(*items[a : a + 100_000])
            yield pa.record_batch([pa.array(terms), pa.array(n, pa.int64())], ["term", "n"])

    return run


def _present(terms: list[str], frequent: bool):
    def run(batches):
        """(toxic, found): the places of the terms that a text holds."""
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(terms):
            automaton.add_word(t, i)
        automaton.make_automaton()
        for batch in batches:
            for part in slices(batch):
                found = []
                for raw in texts_as_bytes(part):
                    shown = plain(raw.decode("utf-8"))
                    least = least_count(shown.count(" ") - 1, frequent)
                    found.append(sorted(i for i, n in Counter(i for _, i in automaton.iter(shown)).items() if n >= least))
                yield pa.record_batch([part.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"])

    return run


def mine(sample: DataFrame, frequent: bool) -> dict[str, tuple[str, ...]]:
    """Lexicons from (text, toxic) rows: each covers as many toxic texts as it can with terms of its own.

    Terms of fewer toxic texts than MIN_SHARE are none of them, so there are at
    most 1 / MIN_SHARE times as many candidates as a toxic text holds terms.
    """
    n_toxic, n_clean = (r or 0 for r in sample.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first())
    least = max(3, int(MIN_SHARE * n_toxic))
    counted = sample.where("toxic > 0").select("text").mapInArrow(_count_terms(frequent), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    candidates = {r.term: r.n for r in counted.orderBy("term").collect()}
    if not candidates:
        return {}
    names = list(candidates)
    clean = sample.where("toxic <= 0").select("text", "toxic").mapInArrow(_present(names, frequent), "toxic int, found array<int>").select(F.explode("found").alias("i")).groupBy("i").count()
    in_clean = {names[r.i]: r["count"] for r in clean.collect()}
    allowed = lambda t: MAX_CLEAN * candidates[t] / max(1, n_toxic) * max(1, n_clean)
    good = [t for t in names if in_clean.get(t, 0) <= allowed(t)]
    if not good:
        return {}
    rows = sample.where("toxic > 0").select("text", "toxic").mapInArrow(_present(good, frequent), "toxic int, found array<int>").collect()
    terms = np.concatenate([np.array(r.found, np.int64) for r in rows])
    texts = np.repeat(np.arange(len(rows)), [len(r.found) for r in rows])[np.argsort(terms, kind="stable")]
    ends = np.cumsum(np.bincount(terms, minlength=len(good)))
    held = [texts[e - n : e] for e, n in zip(ends, np.diff(ends, prepend=0))]
    lexicons, used = {}, set()
    for v in range(MINED_VOTERS):
        left, chosen = np.ones(len(rows), bool), []
        queue = [(-len(held[i]), in_clean.get(t, 0), i) for i, t in enumerate(good) if i not in used]
        heapq.heapify(queue)
        while queue and left.any():  # gains only shrink, so a gain that still leads is the largest
            old, clean_texts, i = heapq.heappop(queue)
            gain = int(left[held[i]].sum())
            if gain < 2:
                continue
            if gain < -old and queue and (-gain, clean_texts, i) > queue[0]:
                heapq.heappush(queue, (-gain, clean_texts, i))
                continue
            used.add(i)
            chosen.append(good[i])
            left[held[i]] = False
        if chosen:
            lexicons[f"{'frequent' if frequent else 'mined'}_{v}"] = tuple(chosen)
    return lexicons


def _hits(voters):
    def run(batches):
        own = voters.value
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch([pa.array([own.hits(raw.decode("utf-8")).tolist() for raw in texts_as_bytes(part)], pa.list_(pa.float64()))], ["hits"])

    return run


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    label_model: LabelModel | None

    def score(self, hits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(hits) @ self.weights, -30, 30)))


def _sampled(docs: DataFrame, labels: DataFrame, learnable: Column, learn_rows: int) -> tuple[DataFrame, float]:
    """((doc_id, text, toxic, fits), share of toxic labels): of either class about learn_rows / 2 rows, the same in each run."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(learnable)
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    mask = (1 << 30) - 1
    most = F.coalesce(*[F.when(F.col("toxic") == c, int(min(1.0, learn_rows / 2 / n) * mask)) for c, n in counts.items()], F.lit(-1))
    place = F.xxhash64(F.lit("toxicity"), "doc_id").bitwiseAND(F.lit(mask))
    chosen = known.where(place <= most)  # about learn_rows rows
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    once = met.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"))
    fits = F.xxhash64(F.lit("half"), "doc_id").bitwiseAND(F.lit(1)) == 1
    return once.select("doc_id", "m.text", "toxic", fits.alias("fits")), counts.get(1, 0) / max(1, sum(counts.values()))


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, learn_rows: int = LEARN_ROWS) -> Model:
    """A model from docs' learnable rows with a label.

    labels: (doc_id, toxic).  About learn_rows of them are used, half of them
    toxic if there are so many; scores are set back to the classes' true
    shares.  Lexicons are mined with the labels of one half of the sample, the
    label model and the classifier are fitted on the other half without them.
    Repeated labels of a doc_id count as their largest; null labels and doc_ids
    as none; of texts that share a doc_id one is used.  Without labels the
    fixed lexicons decide alone.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    sample, natural = _sampled(docs, labels, learnable, learn_rows)
    sample = scratch.table(sample.repartition(24, "doc_id"), "sample")
    own = sample.where("fits")
    mined = mine(sample.where("NOT fits"), False) | mine(sample.where("NOT fits"), True)
    fixed = {k: tuple(f" {t} " for t in v) for k, v in LEXICONS.items()}
    voters = Voters({**mined, **fixed}, set(mined) or set(fixed))
    rows = own.orderBy("doc_id").select("text").mapInArrow(_hits(spark.sparkContext.broadcast(voters)), "hits array<double>").collect()
    m = len(voters.names)
    if not rows:
        return Model(voters, np.concatenate([[-2.0], np.full(m, 3.0), np.zeros(2 * m)]), None)
    hits = np.array([r.hits for r in rows])
    votes = voters.votes(hits)
    share = own.agg(F.avg("toxic")).first()[0]
    model = LabelModel(share).fit(votes)
    weights = fit_logistic(features(hits), model.posterior(votes))
    if 0 < share < 1 and 0 < natural < 1:
        weights[0] += np.log(natural / (1 - natural)) - np.log(share / (1 - share))
    return Model(voters, weights, model)


def _scores(model):
    def run(batches):
        own = model.value
        for batch in batches:
            for part in slices(batch):
                hits = np.array([own.voters.hits(raw.decode("utf-8")) for raw in texts_as_bytes(part)])
                yield pa.record_batch([part.column("doc_id"), pa.array(own.score(hits))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of docs, from its text alone; a null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_scores(shared), "doc_id long, score double")
