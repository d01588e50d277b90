"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a fresh local folder only where it is unset and Spark runs in this machine alone, as in
    tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framequery_"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet and read again: later steps see the same rows in the same partitions, whatever runs twice."""
    path = f"{shared_folder(df.sparkSession)}/{name}_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
