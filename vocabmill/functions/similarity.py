"""String similarities as Arrow UDFs (FUZ02, FUZ03, FUZ10).

Pairs are scored a batch at a time; each distinct pair of a batch once.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, functions as F


def lcs(a: str, b: str) -> int:
    """The length of the longest common subsequence, 64 or more cells at a time (Hyyrö's bit-parallel rows)."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 * 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    return max(ratio(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    one, two = (f"{both} {' '.join(sorted(z))}".strip() for z in (x - y, y - x))
    return max(ratio(both, one), ratio(both, two), ratio(one, two)) if both else ratio(one, two)


def difflib_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(matched, (c for c, t in zip(b, taken) if t))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * scale * (1 - jaro) if jaro > 0.7 else jaro


_VOWELS = "AEIOU"
#: Letter groups whose sounds are alike, tried in order.
_SOUNDS = (("SCH", "SK"), ("TIA", "X"), ("TIO", "X"), ("CIA", "X"), ("CH", "X"), ("SH", "X"), ("PH", "F"), ("TH", "0"), ("CK", "K"), ("DGE", "J"), ("DGI", "J"), ("DGY", "J"), ("GH", ""), ("KN", "N"), ("WR", "R"), ("MB", "M"))


def phonetic_key(text: str) -> str:
    """A Metaphone-like key: consonant sounds, and a vowel only at the start of a word."""
    out = []
    for word in "".join(c if c.isalpha() else " " for c in text.upper()).split():
        i, key = 0, ""
        while i < len(word):
            for letters, sound in _SOUNDS:
                if word.startswith(letters, i):
                    key, i = key + sound, i + len(letters)
                    break
            else:
                c, after = word[i], word[i + 1 : i + 2]
                if i and c == word[i - 1] and c != "C":
                    c = ""
                elif c in _VOWELS:
                    c = c if not i else ""
                elif c == "C":
                    c = "S" if after and after in "EIY" else "K"
                elif c == "G":
                    c = "J" if after and after in "EIY" else "K"
                elif c == "X":
                    c = "KS"
                elif c in "HWY":
                    c = c if after and after in _VOWELS else ""
                else:
                    c = {"Q": "K", "V": "F", "Z": "S", "D": "T"}.get(c, c)
                key, i = key + c, i + 1
        out.append(key)
    return " ".join(out)


def _udf(score, kind: str):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        memo: dict = {}
        out = []
        for pair in zip(a.to_pylist(), b.to_pylist()):
            if None in pair:
                out.append(None)
            else:
                if pair not in memo:
                    memo[pair] = score(*pair)
                out.append(memo[pair])
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, kind)


def scorer(name: str):
    """A function of two string columns; null if either is null."""
    return _udf({"ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio, "difflib_ratio": difflib_ratio, "jaro_winkler": jaro_winkler}[name], "double")


def phonetic(text: Column) -> Column:
    return F.arrow_udf(lambda a: pa.array([None if x is None else phonetic_key(x) for x in a.to_pylist()], pa.string()), "string")(text)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of tokens, as sets; 0 if both are empty."""
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))
