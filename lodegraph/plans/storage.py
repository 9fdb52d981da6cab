"""Where intermediate tables go: a shared folder, so that a lost executor costs no more than its tasks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = "/tmp/checkpoints/lodegraph"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a local one if driver and executors are one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        os.makedirs(LOCAL, exist_ok=True)
        found = f"file://{LOCAL}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and outlives lost executors. Unlike a checkpoint, it is computed once."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
