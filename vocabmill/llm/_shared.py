"""Helpers that several operators of this package share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor and the driver see.

    It is the session's ``spark.checkpoint.dir``.  Only a local master, where
    one machine is the whole cluster, may leave it unset; a temporary folder
    then stands in for it until the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="vocabmill-"))
        atexit.register(shutil.rmtree, _local_folder[0], ignore_errors=True)
    return "file://" + _local_folder[0]


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _delete_at_exit(spark: SparkSession, base: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        _delete(spark, base)


class Scratch:
    """Tables of one run of an operator, written to the shared folder.

    Writing a table cuts the lineage: a lost executor costs the tasks of the
    stage that runs, not the stages before it.  Results read the tables when
    they are asked for, so tables stay until the driver's process ends.
    """

    def __init__(self, spark: SparkSession, operator: str) -> None:
        self.spark = spark
        self.base = f"{shared_folder(spark)}/vocabmill-{operator}-{uuid.uuid4().hex}"
        atexit.register(_delete_at_exit, spark, self.base)

    def path(self, label: str) -> str:
        return f"{self.base}/{label}"

    def table(self, df: DataFrame, label: str, files: int | None = None) -> DataFrame:
        """df, written and read again; to that many files at most, for tables known to be small."""
        (df.coalesce(files) if files else df).write.parquet(self.path(label))
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def drop(self, label: str) -> None:
        _delete(self.spark, self.path(label))


def worker_state() -> dict:
    """A dict that lives in the Python worker across a stage's tasks.

    Functions are pickled by value, so their module's globals start anew in
    each task; tokenizers and memo tables are kept here instead.  ``slices``
    empties it when another stage begins, so what one operator remembers takes
    no memory from the next.
    """
    name = "_vocabmill_worker_state"
    module = sys.modules.get(name)
    if module is None:
        module = sys.modules[name] = types.ModuleType(name)
        module.state, module.stage = {}, None
    return module.state


def _forget_other_stages() -> None:
    context, state = TaskContext.get(), worker_state()
    module = sys.modules["_vocabmill_worker_state"]
    if context is not None and module.stage != context.stageId():
        state.clear()
        module.stage = context.stageId()


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 4 << 20):
    """Zero-copy slices of a batch with about max_bytes of text each.

    A longer text is a slice of its own, so memory follows the longest text,
    not the batch.
    """
    n = batch.num_rows
    if not n:
        return
    _forget_other_stages()
    array = batch.column(column)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + n + 1]
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
    pa.default_memory_pool().release_unused()  # idle workers keep no more than they use


def texts_as_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Actions inside send at most so many rows in an Arrow batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
