"""Cutting the lineage of iterative plans by tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset a local session gets one of its own; a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.getCheckpointDir():
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cadenza-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def cut(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
