"""The document store as DataFrames (DOC01-DOC06, AGG07-AGG08, VAL05-VAL07, SNK06-SNK07).

Rows are appended; the state of a document is its latest row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fixed_values import MAX_MEGABYTES

#: First bytes of the types that can be told by them.
MAGIC = {"pdf": "25504446", "docx": "504B0304", "rtf": "7B5C727466"}
STEPS = {"pending": (0, "queued"), "processing": (50, "extracting"), "extracted": (80, "mapping"), "completed": (100, "done"), "failed": (100, "failed")}


def progress(status: Column) -> dict[str, Column]:
    """DOC01."""
    percent, step = F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), F.lit(""))
    for name, (p, s) in STEPS.items():
        percent, step = percent.when(status == name, p), step.when(status == name, s)
    return {"progress": percent.otherwise(0), "step": step.otherwise("unknown")}


def fits_type(content: Column, kind: Column) -> Column:
    """VAL05: binary content that starts as its type does; text types start as none of the others."""
    head = F.hex(F.substring(content, 1, 5))
    starts = {k: F.startswith(head, F.lit(m)) for k, m in MAGIC.items()}
    out = F.when(F.lit(False), F.lit(False))
    for k, ok in starts.items():
        out = out.when(kind == k, ok)
    any_other = starts["pdf"] | starts["docx"] | starts["rtf"]
    return out.when(kind.isin("txt", "hl7"), ~any_other).otherwise(F.lit(False))


def fits_size(size: Column, kind: Column) -> Column:
    """VAL06."""
    limits = F.create_map(*[x for k, mb in MAX_MEGABYTES.items() for x in (F.lit(k), F.lit(mb * 1024 * 1024))])
    return F.coalesce(size <= F.try_element_at(limits, kind), F.lit(False))


def checked_confidence(confidence: Column) -> Column:
    """VAL07: the confidence; an error if it is outside 0 to 1."""
    return F.when(F.assert_true((confidence >= 0) & (confidence <= 1), F.lit("confidence is outside 0 to 1")).isNull(), confidence)


def received(files: DataFrame, kind: Column) -> DataFrame:
    """SNK07: rows of a binaryFile scan as documents: checksum, size and a random id; wrong or large ones are marked failed."""
    ok = fits_type(F.col("content"), kind) & fits_size(F.col("length"), kind)
    return files.select(F.expr("uuid()").alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), kind.alias("document_type"), F.col("length").alias("file_size"), F.sha2("content", 256).alias("checksum"), F.when(ok, "pending").otherwise("failed").alias("status"), F.col("modificationTime").alias("upload_timestamp"))


def first_of_checksum(docs: DataFrame, text: Column, id_col: str = "doc_id") -> DataFrame:
    """DOC06: (id, checksum, duplicate_of): the smallest id of equal contents, null for itself.

    Ids alone are shuffled and combined by checksum.
    """
    own = docs.select(id_col, F.sha2(text, 256).alias("checksum"))
    first = own.groupBy("checksum").agg(F.min(id_col).alias("first"))
    return own.join(first, "checksum").select(id_col, "checksum", F.when(F.col("first") != F.col(id_col), F.col("first")).alias("duplicate_of"))


def latest(log: DataFrame, id_col: str = "document_id", at: str = "updated_at") -> DataFrame:
    """The last row of each document."""
    rest = [c for c in log.columns if c != id_col]
    return log.groupBy(id_col).agg(F.max_by(F.struct(*rest), at).alias("m")).select(id_col, "m.*")


def updated(docs: DataFrame, changes: DataFrame, id_col: str = "document_id") -> DataFrame:
    """DOC03: docs with the changes' values that aren't null."""
    new = changes.select(id_col, *[F.col(c).alias(f"__{c}") for c in changes.columns if c != id_col])
    joined = docs.join(new, id_col, "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in changes.columns and c != id_col else F.col(c) for c in docs.columns])


def created_batch(docs: DataFrame, batch_id: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    """DOC04: (batches, docs): a row for each new batch with its number of documents, and the documents marked with theirs, pending."""
    marked = docs.withColumn("batch_id", batch_id).withColumn("status", F.lit("pending"))
    batches = marked.groupBy("batch_id").agg(F.count("*").alias("total_documents")).select("batch_id", "total_documents", F.lit("pending").alias("status"), at.alias("created_at"))
    return batches, marked


def deleted(docs: DataFrame, ids: DataFrame, id_col: str = "document_id") -> DataFrame:
    """DOC05."""
    return docs.join(ids, id_col, "left_anti")


def metadata(docs: DataFrame, path: str) -> Column:
    """DOC02: a value of the metadata's JSON."""
    return F.get_json_object("metadata", path)


def batch_status(docs: DataFrame) -> DataFrame:
    """AGG07, AGG08: per batch of (batch_id, status, started, ended) rows."""
    done = ~F.col("status").isin("pending", "processing")
    seconds = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6
    return docs.groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if(done).alias("processed"), F.count_if(F.col("status") == "completed").alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(100.0 * F.count_if(done) / F.count("*"), 6).alias("progress"), F.round(F.avg(F.when(done, seconds)), 6).alias("avg_seconds"),
    )


def batch_summary(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """AGG08: batch_status of docs with what was found in each batch's completed documents.

    entities: (batch_id, document_id, kind, system, code), system and code of
    the mapping, null without one.  total_entities, entities_by_type and
    mappings_by_system (maps; empty without any).
    """
    completed = docs.where("status = 'completed'").select("batch_id", "document_id")
    own = entities.join(completed, ["batch_id", "document_id"], "left_semi")
    counts = lambda column, name: own.where(F.col(column).isNotNull()).groupBy("batch_id", column).agg(F.count("*").alias("n")).groupBy("batch_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias(name))
    found = own.groupBy("batch_id").agg(F.count("*").alias("total_entities"))
    mapped = own.where("code IS NOT NULL").groupBy("batch_id", "system").agg(F.count("*").alias("n")).groupBy("batch_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("system", "n")))).alias("mappings_by_system"))
    whole = batch_status(docs)
    for part in (found, counts("kind", "entities_by_type"), mapped):
        whole = whole.join(part, "batch_id", "left")
    none = F.create_map().cast("map<string,bigint>")
    return whole.na.fill(0, ["total_entities"]).withColumns({c: F.coalesce(c, none) for c in ("entities_by_type", "mappings_by_system")})


def exported(docs: DataFrame, include_failed: bool, raw_text: bool, max_chars: int = 1000) -> DataFrame:
    """SNK06: rows for CSV or JSON; texts are cut to max_chars unless raw_text."""
    kept = docs if include_failed else docs.where("status <> 'failed'")
    return kept.withColumn("text", F.col("text") if raw_text else F.substring("text", 1, max_chars))


def listed(docs: DataFrame, status: str | None = None) -> DataFrame:
    """SRT03's rows with the number of all, newest first."""
    kept = docs.where(F.col("status") == status) if status else docs
    return kept.withColumn("total", F.count("*").over(Window.partitionBy("status")))
