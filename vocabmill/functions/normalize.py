"""Normalisers: pure Column functions (NRM01-NRM14, CTX06 text features).

Steps that repeat over a word list are folds over an array literal, so a
column's expression grows with the list, not with two to the power of it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv


def words(values) -> Column:
    return F.array(*map(F.lit, values))


def fold(values, start: Column, step) -> Column:
    return F.aggregate(words(values), start, step)


def strip_prefixes(text: Column, prefixes) -> Column:
    """Each prefix once, in list order."""
    return fold(prefixes, text, lambda acc, p: F.when(F.startswith(acc, p), F.substr(acc, F.length(p) + 1)).otherwise(acc))


def strip_suffixes(text: Column, suffixes) -> Column:
    return fold(suffixes, text, lambda acc, s: F.when(F.endswith(acc, s), F.substr(acc, F.lit(1), F.length(acc) - F.length(s))).otherwise(acc))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_term(term: Column) -> Column:
    """NRM01."""
    bare = strip_prefixes(F.trim(F.lower(term)), fv.TERM_PREFIXES)
    plain = collapse(F.regexp_replace(bare, r"[,.;:!?()]", " "))
    return F.replace(F.replace(plain, F.lit("%"), F.lit(" percent")), F.lit("&"), F.lit(" and "))


def normalize_lab(term: Column) -> Column:
    """NRM02."""
    bare = strip_prefixes(F.lower(term), [p + " " for p in fv.LAB_PREFIXES])
    bare = strip_suffixes(bare, [" " + s for s in fv.LAB_SUFFIXES])
    known = F.create_map(*[F.lit(x) for kv in fv.LAB_SHORT_NAMES.items() for x in kv])
    return collapse(F.coalesce(F.try_element_at(known, bare), bare))


def normalize_drug(term: Column) -> Column:
    """NRM03.  Dosage forms are deleted inside words too."""
    bare = F.regexp_replace(F.lower(term), r"\b\d+\s*(?:mg|g|mcg|ml|mEq)\b", "")
    bare = fold(fv.DOSAGE_FORMS, bare, lambda acc, f: F.replace(acc, f, F.lit("")))
    bare = strip_suffixes(F.regexp_replace(bare, r"\([^)]*\)", ""), fv.BRAND_SUFFIXES)
    return collapse(F.regexp_replace(bare, r"(?U)[^\w\s]", " "))


def clean(text: Column) -> Column:
    """NRM04."""
    return collapse(F.lower(text))


def tokenize(text: Column) -> Column:
    """NRM05: words without punctuation and stopwords, in order."""
    split = F.split(collapse(F.lower(F.regexp_replace(text, r"(?U)[^\w\s]", " "))), " ")
    return F.filter(split, lambda t: (t != "") & ~F.array_contains(words(fv.STOPWORDS), t))


def is_lab_term(term: Column) -> Column:
    """NRM09: a keyword occurs anywhere in the term, inside words too."""
    return F.exists(words(fv.LAB_KEYWORDS), lambda k: F.contains(F.lower(term), k))


def system_uri(system: Column) -> Column:
    """NRM10."""
    known = F.create_map(*[F.lit(x) for kv in fv.SYSTEM_URIS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(system)), F.lit("unknown"))


def clean_text(text: Column) -> Column:
    """NRM11."""
    return F.regexp_replace(text, r"(?U)[^\w\s\-\.\,\:\;\(\)\%\/]", "")


def context_slice(text: Column, start: Column, end: Column, window: int = 50) -> Column:
    """NRM12: the text from window characters before start to window after end (0-based)."""
    first = F.greatest(start - window, F.lit(0))
    last = F.least(end + window, F.length(text))
    return F.substring(text, first + 1, last - first)


def calibrate(score: Column, temperature: float = 1.5) -> Column:
    """NRM13: the logistic of the logit over a temperature."""
    return 1 / (1 + F.exp(-F.ln(score / (1 - score + 1e-8)) / temperature))


def confidence_band(confidence: Column) -> Column:
    """NRM14."""
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.6, "medium").when(confidence >= 0.4, "low").otherwise("very_low")


def percentage(confidence: Column) -> Column:
    return F.round(confidence * 100, 0).cast("long")


def variations(term: Column, synonyms: Column | None = None) -> Column:
    """NRM07: a sorted array of the distinct variations of a lower-cased term.

    synonyms: an array of the members of the synonym sets that hold the term.
    """
    no_prefix = F.transform(F.filter(words(fv.VARIATION_PREFIXES), lambda p: F.startswith(term, p)), lambda p: F.substr(term, F.length(p) + 1))
    bare = F.regexp_replace(term, r"(?U)[^\w\s]", " ")
    expand = F.create_map(*[x for k, v in fv.VARIATION_ABBREVIATIONS.items() for x in (F.lit(k.upper()), words([e.lower() for e in v]))])
    shorten: dict[str, list[str]] = {}
    for short, long in fv.VARIATION_ABBREVIATIONS.items():
        for e in long:
            shorten.setdefault(e.lower(), []).append(short.lower())
    shorter = F.create_map(*[x for k, v in shorten.items() for x in (F.lit(k), words(v))])
    swaps = F.create_map(*[x for k, v in fv.WORD_REPLACEMENTS.items() for x in (F.lit(k), words(v))])
    split = F.split(collapse(term), " ")
    none = F.array().cast("array<string>")
    swapped = F.flatten(
        F.transform(split, lambda w, i: F.transform(F.coalesce(F.try_element_at(swaps, F.lower(w)), none), lambda r: F.array_join(F.transform(split, lambda x, j: F.when(i == j, r).otherwise(x)), " ")))
    )
    meanings = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(m).alias("m")) for s, m in fv.SUFFIX_MEANINGS.items()])
    rewritten = F.transform(F.filter(meanings, lambda x: F.endswith(term, x.s)), lambda x: F.concat(F.substr(term, F.lit(1), F.length(term) - F.length(x.s)), F.lit(" "), x.m))
    found = F.concat(
        F.array(term, bare, collapse(bare)), no_prefix, F.coalesce(F.try_element_at(expand, F.upper(term)), none), F.coalesce(F.try_element_at(shorter, F.lower(term)), none), swapped, rewritten, F.coalesce(synonyms, none) if synonyms is not None else none
    )
    return F.array_sort(F.array_distinct(F.filter(found, lambda v: v != "")))
