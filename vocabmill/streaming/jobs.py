"""Terms as a stream: files arrive, each micro-batch is mapped and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

TERMS = "term_id long, term string, ts timestamp"


def term_stream(spark: SparkSession, path: str, files_per_batch: int = 10) -> DataFrame:
    """JSON files of terms as a stream, so many files at a time."""
    return spark.readStream.schema(TERMS).option("maxFilesPerTrigger", files_per_batch).json(path)


def first_seen(terms: DataFrame, within: str = "1 hour") -> DataFrame:
    """Terms not seen within the last hour of their own time: the response cache's hour as a watermark."""
    return terms.withColumn("key", F.lower(F.trim("term"))).withWatermark("ts", within).dropDuplicatesWithinWatermark(["key"])


def run(terms: DataFrame, mapper: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Map every micro-batch and append it to Parquet; a batch that runs twice replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        mapper(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return terms.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query) -> dict:
    """Rows and batches so far."""
    seen = query.recentProgress
    return {"batches": len(seen), "rows": sum(p["numInputRows"] for p in seen), "active": query.isActive}
