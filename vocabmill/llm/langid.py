"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  An n-gram's vector binds its
letters' vectors, each permuted (rotated) by its place in the n-gram, by
multiplication.  A text's vector bundles (adds up) its n-grams' vectors, and a
language's prototype bundles its texts' vectors.  A text gets the language
with the largest cosine.

Letters are lower-cased; runs of other characters are one space.  Letters
share ``SYMBOLS`` vectors by a hash of the code point, a-z having their own, so
any script works and the number of n-grams is bounded.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._shared import slices, texts_as_bytes, worker_state

DIMENSIONS, N, SEED = 512, 3, 7
SYMBOLS = 128
#: A prototype is bundled from about so many of its language's learning rows, chosen by hash.
LEARN_ROWS = 20_000
UNKNOWN = "und"
_MEMO_GRAMS = 60_000


def has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in set(text))


def symbols(points: np.ndarray) -> np.ndarray:
    """The symbol of each code point of a lower-cased text: 0 if it isn't a letter, 1 to 26 for a-z, others by hash."""
    state = worker_state()
    if "symbols" not in state:
        plane = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            if unicodedata.category(chr(i))[0] == "L":
                plane[i] = i - 96 if 97 <= i <= 122 else 27 + (i * 2654435761 >> 9) % (SYMBOLS - 27)
        state["symbols"] = plane
    return state["symbols"][points]


class Space:
    """n-gram vectors, made when first needed and kept for the worker's life."""

    def __init__(self, dimensions: int, n: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        letters = rng.integers(0, 2, (SYMBOLS, dimensions), np.int8) * 2 - 1
        self.placed = [np.roll(letters, n - 1 - i, axis=1) for i in range(n)]
        self.n, self.dimensions = n, dimensions
        self.row_of = np.full(SYMBOLS**n, -1, np.int32)
        self.rows = np.zeros((1024, dimensions), np.int8)
        self.made = 0

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(n-gram codes, counts) of a text; both empty if it has no letter."""
        ids = symbols(np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32))
        keep = ids > 0
        if not keep.any():
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        keep[1:] |= ids[:-1] > 0  # of a run of other characters, the first
        keep[0] = True
        ids = ids[keep].astype(np.int32)
        own = np.zeros(max(0, len(ids) - self.n + 1), np.int32)
        for i in range(self.n):
            own = own * SYMBOLS + ids[i : i + len(own)]
        return np.unique(own, return_counts=True)

    def _bind(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), self.dimensions), np.int8)
        for i in range(self.n):
            out *= self.placed[self.n - 1 - i][codes % SYMBOLS]
            codes = codes // SYMBOLS
        return out

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        new = codes[self.row_of[codes] < 0]
        if len(new) and self.made + len(new) > _MEMO_GRAMS:
            return self._bind(codes)
        if len(new):
            while len(self.rows) < self.made + len(new):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.made : self.made + len(new)] = self._bind(new)
            self.row_of[new] = np.arange(self.made, self.made + len(new))
            self.made += len(new)
        return self.rows[self.row_of[codes]]

    def bundle(self, text: str) -> np.ndarray:
        """The text's vector; zeros if it has no letter."""
        codes, counts = self.grams(text)
        out = np.zeros(self.dimensions)
        for a in range(0, len(codes), 1024):
            out += counts[a : a + 1024].astype(np.float32) @ self.vectors(codes[a : a + 1024]).astype(np.float32)
        return out


def _space(dimensions: int, n: int, seed: int) -> Space:
    state = worker_state()
    key = "hd", dimensions, n, seed
    if key not in state:
        state[key] = Space(dimensions, n, seed)
    return state[key]


def _bundles(dimensions: int, n: int, seed: int):
    def run(batches):
        """(lang, at, total): a task's sum of its texts' vectors in a language."""
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                space = _space(dimensions, n, seed)
                for lang, raw in zip(part.column("lang").to_pylist(), texts_as_bytes(part)):
                    v = space.bundle(raw.decode("utf-8"))
                    size = np.linalg.norm(v)
                    if size:
                        sums[lang] = sums.get(lang, 0) + v / size
        for lang, v in sums.items():
            yield pa.record_batch([pa.array([lang] * len(v)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["lang", "at", "total"])

    return run


def learn(docs: DataFrame, learnable: Column, learn_rows: int = LEARN_ROWS, dimensions: int = DIMENSIONS, n: int = N, seed: int = SEED) -> dict[str, np.ndarray]:
    """A unit prototype for each language of docs' learnable rows with a lang and a text.

    It is bundled from about ``learn_rows`` of the language's rows, or all if
    there are fewer, and from at least one.
    """
    place = F.xxhash64(F.lit("learn"), F.coalesce("doc_id", F.xxhash64("text"))).bitwiseAND(F.lit((1 << 30) - 1))
    own = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", place.alias("place"))
    most = F.greatest(F.min("place"), F.least(F.lit(1.0), learn_rows / F.count("*")) * (1 << 30))
    limits = own.groupBy("lang").agg(most.alias("most"))  # a row for each language
    chosen = own.join(F.broadcast(limits), "lang").where("place <= most")
    sums = chosen.select("lang", "text").mapInArrow(_bundles(dimensions, n, seed), "lang string, at int, total double")
    found: dict[str, np.ndarray] = {}
    for r in sums.groupBy("lang", "at").agg(F.sum("total").alias("total")).collect():  # dimensions x languages numbers
        found.setdefault(r.lang, np.zeros(dimensions))[r.at] = r.total
    return {lang: v / (np.linalg.norm(v) or 1.0) for lang, v in sorted(found.items())}


def _classify(names: list[str], prototypes: np.ndarray, dimensions: int, n: int, seed: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                space = _space(dimensions, n, seed)
                langs, scores = [], []
                for raw in texts_as_bytes(part):
                    text = raw.decode("utf-8")
                    lang, score = UNKNOWN, 0.0
                    v = space.bundle(text) if names and has_letter(text) else None
                    if v is not None:
                        cosines = prototypes @ (v / (np.linalg.norm(v) or 1.0))
                        best = int(np.argmax(cosines))
                        lang, score = names[best], float(np.clip(cosines[best], 0.0, 1.0))
                    langs.append(lang)
                    scores.append(score)
                kept = [i for i, name in enumerate(part.schema.names) if name != "text"]
                yield pa.record_batch([*(part.column(i) for i in kept), pa.array(langs), pa.array(scores)], [*(part.schema.names[i] for i in kept), "lang_pred", "score"])

    return run


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, n: int = N, seed: int = SEED) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of docs; only its text is looked at.

    lang_pred is ``und`` with score 0 if the text is null or has no letter, or if
    nothing was learned.  score: the cosine, at least 0.  Ties go to the first
    language by code point.
    """
    matrix = np.array(list(prototypes.values())).reshape(len(prototypes), dimensions)
    return docs.select("doc_id", "text").mapInArrow(_classify(list(prototypes), matrix, dimensions, n, seed), "doc_id long, lang_pred string, score double")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the doc_id as text has that remainder; a null doc_id as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def relabel(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, n: int = N, seed: int = SEED) -> DataFrame:
    """docs with lang as predicted from the text, without the rows that have no letter.

    If nothing was learned, lang stays as it is.
    """
    matrix = np.array(list(prototypes.values())).reshape(len(prototypes), dimensions)
    return docs.mapInArrow(_relabelled(list(prototypes), matrix, dimensions, n, seed), docs.schema)


def _relabelled(names: list[str], prototypes: np.ndarray, dimensions: int, n: int, seed: int):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("lang")
            for part in slices(batch):
                space, langs, keep = _space(dimensions, n, seed), [], []
                for raw in texts_as_bytes(part):
                    text, lang = raw.decode("utf-8"), None
                    keep.append(has_letter(text))
                    if names and keep[-1]:
                        v = space.bundle(text)
                        lang = names[int(np.argmax(prototypes @ (v / (np.linalg.norm(v) or 1.0))))]
                    langs.append(lang)
                found = pa.array(langs, pa.string())
                columns = [found if names and i == at else c for i, c in enumerate(part.columns)]
                yield pa.record_batch(columns, schema=part.schema).filter(pa.array(keep, pa.bool_()))

    return run
