"""The shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local master may do without one and gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="sparrel-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh(spark: SparkSession, label: str) -> str:
    """A path in it that nobody has used."""
    return f"{ensure(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """The frame as a table in the folder: its lineage ends there, and the constraints that a checkpoint carries on.

    Those double with each step of a loop, until planning takes longer than the steps.
    """
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
