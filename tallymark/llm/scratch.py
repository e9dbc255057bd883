"""Cutting lineage and sharing files through the folder that the whole cluster sees."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one only where that is unset and the master is this machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return LOCAL


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def table(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cheaper to scan in part than a checkpoint."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
