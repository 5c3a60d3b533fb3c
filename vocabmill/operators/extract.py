"""Terms and entities in free text (EXT01-EXT05)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv

SPAN = "array<struct<kind:string,text:string,start:int,end:int,confidence:double>>"


def _finder(patterns: dict[str, tuple[str, ...]], confidence: float, once: bool):
    def run(texts: pa.Array) -> pa.Array:
        compiled = [(kind, re.compile(p, re.IGNORECASE)) for kind, own in patterns.items() for p in own]
        out = []
        for text in texts.to_pylist():
            spans, seen = [], set()
            for kind, pattern in compiled:
                for m in pattern.finditer(text or ""):
                    if not once or m.group() not in seen:
                        seen.add(m.group())
                        spans.append({"kind": kind, "text": m.group(), "start": m.start(), "end": m.end(), "confidence": confidence})
            out.append(spans)
        fields = [("kind", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]
        return pa.array(out, pa.list_(pa.struct(fields)))

    return F.arrow_udf(run, SPAN)


def term_spans(text: Column) -> Column:
    """EXT01: spans of known terms, each spelling once, in order of pattern and place."""
    return _finder({"PATTERN_MATCH": fv.TERM_PATTERNS}, 0.7, True)(text)


def entity_spans(text: Column) -> Column:
    """EXT02: every span of the entity patterns."""
    return _finder(fv.ENTITY_PATTERNS, 1.0, False)(text)


def has_entity(text: Column) -> dict[str, Column]:
    """EXT02 as booleans, without Python."""
    return {kind: F.regexp_like(text, F.lit("(?i)" + "|".join(p))) for kind, p in fv.ENTITY_PATTERNS.items()}


def merged(spans: Column) -> Column:
    """EXT03: of overlapping spans (structs start, end, confidence) those of most confidence."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(F.signum(b.confidence - a.confidence).cast("int")))
    none = F.slice(ordered, 1, 0)

    def step(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        overlap = last.isNotNull() & (x["start"] < last["end"])
        return F.when(~F.coalesce(overlap, F.lit(False)), F.concat(acc, F.array(x))).when(x.confidence > last.confidence, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(x))).otherwise(acc)

    return F.aggregate(ordered, none, step)


def windows(text: Column, size: int = 100, overlap: int = 20) -> Column:
    """EXT04: (start, end, text) of windows that overlap, the last ending with the text; none if it is empty."""
    step, n = size - overlap, F.length(text)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    found = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, n).alias("end"), F.substr(text, i * step + 1, F.lit(size)).alias("text")))
    return F.when(n > 0, found).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))


def extracted_terms(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """EXT01: (id, term, start, end, confidence), a row for each term found, ready to be mapped."""
    return docs.select(id_col, F.explode(term_spans(F.col("text"))).alias("s")).select(id_col, F.col("s.text").alias("term"), "s.start", "s.end", "s.confidence")


def ai_status(spark) -> DataFrame:
    """EXT05: extraction by a language model is not part of the engine."""
    return spark.createDataFrame([(False, "pattern extraction only")], "enabled boolean, message string")
