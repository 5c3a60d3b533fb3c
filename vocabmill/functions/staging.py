"""Cutting a plan between the steps of a cascade."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all machines see.

    Only a local master, where one machine is the whole cluster, may leave it
    unset; a temporary folder then stands in until the process ends.
    """
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp(prefix="vocabmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/vocabmill-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
