"""A corpus pipeline: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept.  All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vocabmill.llm import decontamination, langid, mixing, near_copies, token_output
from vocabmill.llm._shared import Scratch
from vocabmill.llm.queries import quality_weights, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without any letter go.

    The prototypes are learned from the documents' own lang; the kept rows
    carry the language that was found.
    """
    prototypes = langid.learn(docs, F.lit(True))
    return langid.relabel(docs, prototypes)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each component of near copies: 5-word shingles, Jaccard 0.8 or more.

    SimHash proposes pairs, a prefix filter those that SimHash misses, and
    whole sets of shingles decide.
    """
    return near_copies.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't cover a benchmark item."""
    return decontamination.without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.copies(docs, quality_weights(spark, sf_dir))


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents: doc_id, start, n_tokens, ids_crc32."""
    folder = token_output.tokens_folder(spark)
    token_output.write_tokens(docs, folder, tokenizer_path())
    return token_output.read_tokens(spark, folder, digest_only=True)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_token_ids),
]

#: SQL expresses neither language profiles nor tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage{i}")
    return docs
