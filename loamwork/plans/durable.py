"""Cutting lineage in storage that every executor shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is local, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every node shares")
        named = tempfile.mkdtemp(prefix="loamwork-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    The rows are computed once and survive the loss of any executor, later plans see the table's true size, and
    what has no use for a column doesn't read it.
    """
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
